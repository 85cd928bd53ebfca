"""Gradient boosting on histograms (J5, J6, J8): second-order gains, leaf-wise growth, quantile loss.

Rows are binned once and packed into blocks of bounded size. A tree needs, for the nodes it may
split, the sums of gradients and Hessians per (node, feature, bin): one aggregation over the blocks a
level. Models over the same blocks (trials, boosters) grow side by side, and one job gives all of them
the sums of their next level. A node with no more rows than a block is not divided level by level: its
rows go to one task, which grows all that is below it. Up to ``WHOLE_ROWS`` rows are one block, and the same
loop runs in the task that holds it, since its sums are the sums; several such runs are then tasks of one job.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from collections import OrderedDict, defaultdict
from collections.abc import Generator, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clvforge.session import delete_table, durable_cut, ship_package, write_table

#: Rows of a block where there are several, and the most rows that are one block: with 16 features some 32 MB, and
#: about 150 MB in the task that grows from it (an estimate).
BLOCK_ROWS, WHOLE_ROWS = 50_000, 1_000_000


@dataclass(frozen=True)
class BoostParams:
    """``loss`` is ``squared`` or ``quantile`` (of ``alpha``); ``rows`` and ``columns`` are the shares a tree
    sees; ``min_child`` the least Hessian sum of a child; ``leaves`` > 0 grows best-first to that many."""

    loss: str = "squared"
    alpha: float = 0.5
    trees: int = 300
    depth: int = 6
    rate: float = 0.05
    rows: float = 1.0
    columns: float = 1.0
    min_child: float = 1.0
    l1: float = 0.0
    l2: float = 1.0
    leaves: int = 0
    seed: int = 42


@dataclass
class Tree:
    """Nodes in arrays; a node without feature is a leaf. Rows with bin <= ``bin`` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, at: int, gain: float) -> tuple[int, int]:
        kids = len(self.feature), len(self.feature) + 1
        self.feature[node], self.bin[node], self.gain[node] = feature, at, gain
        self.left[node], self.right[node] = kids
        for _ in kids:
            for column, empty in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0),
                                  (self.value, 0.0), (self.cover, 0.0), (self.gain, 0.0)):
                column.append(empty)
            self.depth.append(self.depth[node] + 1)
        return kids

    def arrays(self) -> tuple[np.ndarray, ...]:
        """(feature, bin, left, right, value): what tasks need of a tree."""
        return (np.array(self.feature, np.int16), np.array(self.bin, np.int16), np.array(self.left, np.int32),
                np.array(self.right, np.int32), np.array(self.value))

    def advance(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The leaf of each row of binned ``x`` (features x rows), from a node above it."""
        return advance(self.arrays(), x, node)


def whole(tree: Tree, below: dict[int, Tree], columns: np.ndarray) -> tuple[Tree, set[int]]:
    """A tree with subtrees (over some columns) in place of its nodes, numbered as if grown level by level, and
    which leaves are the subtrees'."""
    out, theirs, at = Tree(), set(), [(tree, 0)]
    for node, (t, n) in enumerate(at):  # grows on the way
        if t is tree and n in below:
            t, n = below[n], 0
            at[node] = t, n
        out.value[node], out.cover[node] = t.value[n], t.cover[n]
        if t.feature[n] >= 0:
            out.split(node, t.feature[n] if t is tree else int(columns[t.feature[n]]), t.bin[n], t.gain[n])
            at += [(t, t.left[n]), (t, t.right[n])]
        elif t is not tree:
            theirs.add(node)
    return out, theirs


def advance(tree: tuple[np.ndarray, ...], x: np.ndarray, node: np.ndarray) -> np.ndarray:
    """``Tree.advance`` of a tree's arrays. A right child's number is its sibling's and one; a leaf leads to itself."""
    feature, at, left, _, _ = tree
    leaf, flat, row = feature < 0, x.reshape(-1), np.arange(x.shape[1])
    first, cut, low = np.where(leaf, 0, feature) * np.int64(x.shape[1]), np.where(leaf, 255, at), np.where(leaf, np.arange(len(leaf)), left)
    node = node.astype(np.int64)
    while not leaf.take(node).all():
        node = low.take(node) + (flat.take(first.take(node) + row) > cut.take(node))
    return node


def _seen(key: np.ndarray, share: float, seed: int, number: int) -> np.ndarray:
    """Which rows a tree sees, by a hash of the row's key: however rows are dealt, the same."""
    if share >= 1:
        return np.ones(len(key), bool)
    with np.errstate(over="ignore"):
        x = (key ^ np.uint64((seed * 1_000_003 + number) & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)).astype(np.float64) < share * 2 ** 24


def gradients(p: BoostParams, y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """First derivatives of the loss; the second is taken as 1 for both losses."""
    return margin - y if p.loss == "squared" else np.where(y > margin, -p.alpha, 1 - p.alpha)


def histogram(p: BoostParams, x, y, margin, node, seen: np.ndarray, slot_of: np.ndarray, columns, bins: int) -> np.ndarray:
    """Sums (slot, column, bin, [gradient, Hessian]) over the seen rows of one block in the wanted nodes."""
    slot = slot_of.take(node)
    rows = np.flatnonzero((slot >= 0) & seen)
    g, first = gradients(p, y.take(rows), margin.take(rows)), slot.take(rows) * bins
    n = int(slot_of.max()) + 1
    out = np.zeros((n, len(columns), bins, 2))
    for c, f in enumerate(columns):
        at = first + x[f].take(rows)
        out[:, c, :, 0] = np.bincount(at, g, n * bins).reshape(n, bins)
        out[:, c, :, 1] = np.bincount(at, minlength=n * bins).reshape(n, bins)
    return out


def _shrunk(g, l1):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_splits(p: BoostParams, hists: list[np.ndarray], at_once: int = 64) -> list[tuple[float, int, int] | None]:
    """Of each histogram (gain, column, bin) of the regularised gain's maximum, ties to the first column and bin; None if
    none gains."""
    out: list[tuple[float, int, int] | None] = []
    score = lambda g, n: np.maximum(np.abs(g) - p.l1, 0.0) ** 2 / (n + p.l2 + 1e-12)
    for lo in range(0, len(hists), at_once):
        both = np.stack(hists[lo:lo + at_once])
        g, n = both[..., 0].cumsum(2), both[..., 1].cumsum(2)
        g_all, n_all = g[:, :1, -1:], n[:, :1, -1:]
        rest, whole_score = n_all - n, score(g_all, n_all)
        gain = 0.5 * (score(g, n) + score(g_all - g, rest) - whole_score)
        least = np.maximum(p.min_child, np.nextafter(0, 1))
        gain[(n < least) | (rest < least)] = -np.inf
        flat = gain.reshape(len(both), -1)
        for row, at, one in zip(flat, flat.argmax(1).tolist(), whole_score[:, 0, 0].tolist()):
            out.append((float(row[at]), *divmod(at, gain.shape[2])) if row[at] > 1e-9 * max(1.0, one) else None)
    return out


class LocalRows:
    """One block's rows and their margins; histograms are those of the block."""

    unit = 0

    def __init__(self, p: BoostParams, x, key, y):
        self.p, self.x, self.key, self.y = p, x, key, y

    def base(self) -> float:
        if self.p.loss == "squared":
            value = float(self.y.mean()) if len(self.y) else 0.0
        else:
            value = float(np.quantile(self.y, self.p.alpha, method="inverted_cdf")) if len(self.y) else 0.0
        self.margin = np.full(len(self.y), value)
        return value

    def start(self, number: int) -> None:
        self.node, self.seen = np.zeros(len(self.y), np.int64), _seen(self.key, self.p.rows, self.p.seed, number)

    def hist(self, tree: Tree, nodes: list[int], columns, bins: int) -> np.ndarray:
        slot_of = np.full(len(tree.feature), -1)
        slot_of[nodes] = np.arange(len(nodes))
        self.node = tree.advance(self.x, self.node)
        return histogram(self.p, self.x, self.y, self.margin, self.node, self.seen, slot_of, columns, bins)

    @staticmethod
    def together(asks: list[tuple["LocalRows", tuple]]) -> list[tuple["LocalRows", object]]:
        """What each asks for: ``hist`` or ``leaf_quantiles`` with their arguments."""
        return [(rows, getattr(rows, what)(*args)) for rows, (what, *args) in asks]

    def leaf_quantiles(self, tree: Tree, leaves: list[int]) -> dict[int, float]:
        """Residual quantiles of all leaves, those wanted included."""
        self.node = tree.advance(self.x, self.node)
        rest = pd.Series(self.y - self.margin).groupby(self.node)
        return {int(k): float(np.quantile(v, self.p.alpha, method="inverted_cdf")) for k, v in rest}

    def finish(self, tree: Tree) -> None:
        self.node = tree.advance(self.x, self.node)
        self.margin = self.margin + np.array(tree.value)[self.node]


#: Margins that a Python worker remembers, by (run, block, model), with the number of trees in them.
_HELD: OrderedDict[tuple, tuple[int, np.ndarray]] = OrderedDict()
_HELD_BYTES = 256 << 20


@dataclass
class _Part:
    """What a task needs of one model: its trees since the margins were written, and what is asked for."""

    model: int
    p: BoostParams
    value: float
    written: int
    recent: list[tuple[np.ndarray, ...]]
    tree: tuple[np.ndarray, ...] | None = None
    number: int = 0
    slot_of: np.ndarray | None = None
    columns: np.ndarray | None = None
    bins: int = 0
    depths: list[int] | None = None

    def margin(self, run: str, block: int, was: bytes | None, x: np.ndarray) -> np.ndarray:
        """The margins after all trees: those remembered or, failing that, written, and the trees since."""
        name, want = (run, block, self.model), self.written + len(self.recent)
        count, margin = _HELD.pop(name, (-1, None))
        if not self.written <= count <= want:
            count, margin = self.written, np.frombuffer(was, np.float64) if was else np.full(x.shape[1], self.value)
        for t in self.recent[count - self.written:]:
            margin = margin + t[4][advance(t, x, np.zeros(x.shape[1], np.int32))]
        _HELD[name] = want, margin
        while len(_HELD) > 1 and sum(m.nbytes for _, m in _HELD.values()) > _HELD_BYTES:
            _HELD.popitem(last=False)
        return margin


def _sums(run: str, features: int, parts: list[_Part], by_node: bool, blocks: Iterator[dict]) -> Iterator[tuple]:
    """Of a partition's blocks: (model, gradient sums, counts), or with ``by_node`` one such row a node."""
    total: dict[int, np.ndarray] = {}
    for r in blocks:
        x, key, y = unpack_block(r, features)
        for q in parts:
            margin = q.margin(run, r["id"], r["margins"][q.model] if r["margins"] else None, x)
            node = advance(q.tree, x, np.zeros(len(y), np.int32))
            h = histogram(q.p, x, y, margin, node, _seen(key, q.p.rows, q.p.seed, q.number), q.slot_of, q.columns, q.bins)
            total[q.model] = total[q.model] + h if q.model in total else h
    for model, h in total.items():
        if by_node:
            yield from (((model, slot), h[slot]) for slot in np.flatnonzero(h[..., 1].any((1, 2))).tolist())
        else:
            yield model, h[..., 0], h[..., 1].astype(np.int32)


def _rows_below(run: str, features: int, parts: list[_Part], blocks: Iterator[dict]) -> Iterator[tuple]:
    """Of a partition's blocks: ((model, slot), (block, bins, keys, residuals)) of the rows in the wanted nodes; rows that
    the tree does not see only where a quantile of all is wanted."""
    for r in blocks:
        x, key, y = unpack_block(r, features)
        for q in parts:
            rest = y - q.margin(run, r["id"], r["margins"][q.model] if r["margins"] else None, x)
            slot = q.slot_of[advance(q.tree, x, np.zeros(len(y), np.int32))]
            if q.p.loss == "squared":
                slot = np.where(_seen(key, q.p.rows, q.p.seed, q.number), slot, -1)
            order = np.argsort(slot, kind="stable")
            order = order[np.searchsorted(slot[order], 0):]
            ends = np.cumsum(np.bincount(slot[order], minlength=len(q.depths)))
            x_of, key_of, rest_of = x[np.ix_(q.columns, order)], key[order], rest[order]
            for s, (lo, hi) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                if hi > lo:
                    yield (q.model, s), (r["id"], x_of[:, lo:hi], key_of[lo:hi], rest_of[lo:hi])


def _grown(parts: list[_Part], rows: Iterator[tuple]) -> Iterator[tuple]:
    """((model, slot), subtree) of the nodes whose rows are here. Residuals stand for labels, and margins are zero."""
    of, held = {q.model: q for q in parts}, {}
    for name, chunk in rows:
        held.setdefault(name, []).append(chunk)
    for name in sorted(held):
        chunks, q = sorted(held.pop(name), key=lambda c: c[0]), of[name[0]]
        x, key, rest = (np.concatenate(c, -1) for c in list(zip(*chunks))[1:])
        p = replace(q.p, depth=q.p.depth - q.depths[name[1]], columns=1.0)
        local = LocalRows(p, x, key, rest)
        local.margin = np.zeros(len(rest))
        yield name, _finish({0: _tree(local, p, q.number, len(x), q.bins)}, {0: local})[0]


class Blocks:
    """Blocks in Spark, shared by several models: one job gives the sums that all who wait ask for.

    Margins are written again every ``every`` jobs, or when the trees since are many. Between, a Python worker
    remembers those it has worked out; one that has not starts from the written ones, with the same result.
    Nodes of up to ``unit`` seen rows are grown on in one task each (0: none are)."""

    def __init__(self, blocks: DataFrame, features: int, every: int = 64, most_nodes: int = 20_000, driver_bytes: int = 24 << 20,
                 unit: int = 0):
        self.features, self.every, self.most_nodes, self.driver_bytes, self.unit = features, every, most_nodes, driver_bytes, unit
        self.spark, self.run, self.models, self.path = blocks.sparkSession, uuid.uuid4().hex, [], None
        self.bases: dict[tuple[str, float], float] = {}
        self.rounds, self.waiting, self.running, self.pool = 0, defaultdict(list), {}, ThreadPoolExecutor(3)
        self.behind, self.patience = False, 3
        self._use(blocks.select(F.monotonically_increasing_id().alias("id"), "n", "key", "x", "y",
                                F.lit(None).cast("array<binary>").alias("margins")))

    def _use(self, blocks: DataFrame) -> None:
        self.blocks = blocks
        self.records = blocks.rdd.map(lambda r: r.asDict()).persist(StorageLevel.MEMORY_AND_DISK)
        self.tasks = self.records.getNumPartitions()

    def close(self) -> None:
        wait(self.running.values())
        self.pool.shutdown()
        self._drop()

    def _drop(self) -> None:
        self.records.unpersist()
        if self.path:
            delete_table(self.spark, self.path)
            self.path = None

    def base(self, p: BoostParams) -> float:
        what = p.loss, p.alpha if p.loss == "quantile" else 0.0
        if what not in self.bases:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for y in batch.column(0).to_pylist():
                        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(y, np.float64))], names=["y"])

            y = self.blocks.select("y").mapInArrow(run, "y double")
            how = F.avg("y") if p.loss == "squared" else F.percentile_approx("y", p.alpha, 1_000_000)
            self.bases[what] = float(y.agg(how).first()[0] or 0.0)
        return self.bases[what]

    def histograms(self, asks: list[tuple["SparkRows", tuple]]) -> list[np.ndarray]:
        """One job for all. Its tasks' sums are added here if they are small, else by a shuffle first."""
        parts = [rows.part(tree, nodes, columns, bins) for rows, (tree, nodes, columns, bins) in asks]
        shape = {rows.i: (len(nodes), len(columns), bins) for rows, (_, nodes, columns, bins) in asks}
        by_node = 12 * self.tasks * sum(a * b * c for a, b, c in shape.values()) > self.driver_bytes
        run, features = self.run, self.features
        got = self.records.mapPartitions(lambda blocks: _sums(run, features, parts, by_node, blocks))
        out = {i: np.zeros((*s, 2)) for i, s in shape.items()}
        if by_node:
            for (i, slot), h in got.reduceByKey(np.add, self.tasks).collect():  # nodes x features x bins at most
                out[i][slot] = h
        else:
            for i, g, h in got.collect():
                out[i][..., 0] += g
                out[i][..., 1] += h
        return [out[rows.i] for rows, _ in asks]

    def subtrees(self, asks: list[tuple["SparkRows", tuple]]) -> list[dict[int, Tree]]:
        """What grows below nodes of bounded size: one shuffle of their rows, a node's to one task. Nodes are dealt
        largest first, each to the task that has the fewest rows so far."""
        parts = [rows.part(tree, nodes, columns, bins) for rows, (tree, nodes, columns, bins) in asks]
        load, place = [(0.0, k) for k in range(self.tasks)], {}
        for rows_of, name in sorted(((tree.cover[n], (rows.i, s)) for rows, (tree, nodes, *_) in asks for s, n in enumerate(nodes)),
                                    key=lambda t: (-t[0], t[1])):
            has, place[name] = load[0]
            heapq.heapreplace(load, (has + rows_of, place[name]))
        run, features = self.run, self.features
        got = dict(self.records.mapPartitions(lambda blocks: _rows_below(run, features, parts, blocks))
                   .partitionBy(self.tasks, place.__getitem__).mapPartitions(lambda rows: _grown(parts, rows)).collect())
        return [{n: got[rows.i, s] for s, n in enumerate(nodes)} for rows, (_, nodes, *_) in asks]

    def leaf_quantiles(self, asks: list[tuple["SparkRows", tuple]]) -> list[dict[int, float]]:
        """Residual quantiles from Spark's mergeable quantile summaries, one a model and wanted leaf."""
        parts = [rows.part(tree, leaves) for rows, (tree, leaves) in asks]
        name, features = self.run, self.features

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    x, _, y = unpack_block(r, features)
                    for q in parts:
                        rest = y - q.margin(name, r["id"], r["margins"][q.model] if r["margins"] else None, x)
                        leaf = advance(q.tree, x, np.zeros(len(y), np.int32))
                        wanted = q.slot_of[leaf] >= 0
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(int(wanted.sum()), q.model)), pa.array(leaf[wanted], pa.int64()),
                                                          pa.array(rest[wanted])], names=["model", "leaf", "rest"])

        at = {a: F.percentile_approx("rest", a, 100_000) for a in {q.p.alpha for q in parts}}
        out: dict[int, dict[int, float]] = {q.model: {} for q in parts}
        of = {q.model: f"q{list(at).index(q.p.alpha)}" for q in parts}
        for r in (self.blocks.mapInArrow(run, "model long, leaf long, rest double").groupBy("model", "leaf")
                  .agg(*[q.alias(f"q{k}") for k, q in enumerate(at.values())]).collect()):
            out[r["model"]][r["leaf"]] = r[of[r["model"]]]
        return [out[rows.i] for rows, _ in asks]

    def answer(self, asks: list[tuple["SparkRows", tuple]]) -> list[tuple["SparkRows", object]]:
        """Some answers to these and earlier requests; none if none waits. All waiting requests of a kind share a job;
        jobs of different kinds run side by side. Subtrees wait for three jobs of sums at most, while models that may
        ask for subtrees too are about to."""
        for rows, (what, *args) in asks:
            self.waiting[what].append((rows, tuple(args)))
        if self.rounds >= self.every or sum(len(t[0]) for m in self.models for t in m.recent) > self.most_nodes:
            wait(self.running.values())
            self._write()
        for kind, give in (("hist", self.histograms), ("subtrees", self.subtrees), ("leaf_quantiles", self.leaf_quantiles)):
            if kind == "subtrees" and self.waiting[kind] and self.behind and self.patience > 0:
                continue
            if self.waiting[kind] and kind not in self.running:
                of = self.waiting.pop(kind)
                self.running[kind] = self.pool.submit(lambda give=give, of=of: [(rows, a) for (rows, _), a in zip(of, give(of))])
                self.rounds += 1
                if kind == "hist":
                    self.behind = any(not rows.p.leaves for rows, _ in of)
                    self.patience -= bool(self.waiting["subtrees"])
                elif kind == "subtrees":
                    self.patience = 3
        wait(self.running.values(), return_when=FIRST_COMPLETED)
        done = [kind for kind, job in self.running.items() if job.done()]
        out = [pair for kind in done for pair in self.running.pop(kind).result()]
        self.behind = self.behind and "hist" not in done
        for rows, _ in out:
            rows.jobs += 1
        return out

    def _write(self) -> None:
        """Margins with all trees so far, in place of those written before."""
        self.rounds = 0
        if not any(m.recent for m in self.models):
            return
        parts, name, features = [m.part() for m in self.models], self.run, self.features

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                margins = []
                for r in batch.to_pylist():
                    x = unpack_block(r, features)[0]
                    margins.append([q.margin(name, r["id"], r["margins"][q.model] if r["margins"] else None, x).tobytes() for q in parts])
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(margins, pa.list_(pa.binary()))], names=batch.schema.names)

        path = write_table(self.blocks.mapInArrow(run, self.blocks.schema))
        self._drop()
        self.path = path
        self._use(self.spark.read.parquet(path))
        for m in self.models:
            m.written, m.recent = m.written + len(m.recent), []


class SparkRows:
    """One model over blocks in Spark; with ``shared`` it shares them, and their jobs, with others."""

    def __init__(self, p: BoostParams, blocks: DataFrame, features: int, shared: Blocks | None = None):
        self.p, self.shared, self.jobs = p, shared or Blocks(blocks, features), 0
        self.written, self.recent, self.unit = 0, [], self.shared.unit
        self.i = len(self.shared.models)
        self.shared.models.append(self)

    def base(self) -> float:
        self.value = self.shared.base(self.p)
        return self.value

    def start(self, number: int) -> None:
        self.number = number

    def part(self, tree: Tree | None = None, nodes: list[int] | None = None, columns=None, bins: int = 0) -> _Part:
        part = _Part(self.i, self.p, self.value, self.written, list(self.recent), tree.arrays() if tree else None, self.number)
        if nodes is not None:
            part.slot_of, part.columns, part.bins = np.full(len(tree.feature), -1), columns, bins
            part.slot_of[nodes] = np.arange(len(nodes))
            part.depths = [tree.depth[n] for n in nodes]
        return part

    def together(self, asks: list[tuple["SparkRows", tuple]]) -> list[tuple["SparkRows", object]]:
        return self.shared.answer(asks)

    def finish(self, tree: Tree) -> None:
        self.recent.append(tree.arrays())


class _Open:
    """A leaf that may be split: its best split, and what its smaller child's histogram gives its children."""

    def __init__(self, node: int, hist: np.ndarray, best):
        self.node, self.hist, self.best = node, hist, best
        left = hist[best[1], :best[2] + 1].sum(0)
        self.sums = left, hist[0].sum(0) - left
        self.small = 0 if self.sums[0][1] <= self.sums[1][1] else 1


def _grow(rows, p: BoostParams, number: int, features: int, bins: int) -> Generator[tuple, object, tuple[Tree, set[int]]]:
    """One tree, and the leaves whose values are final; yields what it asks of the rows. Children's histograms are asked
    for together: one of each pair, its sibling by subtraction. Level by level, children of no more rows than the rows'
    ``unit`` are put aside, and what is below them is asked for at the end, where that saves a request."""
    draw = np.random.default_rng([p.seed, number])
    columns = np.sort(draw.choice(features, max(1, round(p.columns * features)), replace=False)) if p.columns < 1 else np.arange(features)
    tree = Tree()
    rows.start(number)
    root = (yield "hist", tree, [0], columns, bins)[0]
    tree.cover[0] = float(root[0, :, 1].sum())
    weight = lambda s: float(-_shrunk(s[0], p.l1) / (s[1] + p.l2 + 1e-12)) * p.rate
    tree.value[0] = weight(root[0].sum(0))
    most = p.leaves or 1 << p.depth
    heap: list = []

    def offer(found: list[tuple[int, np.ndarray]]) -> None:
        found = [(node, hist) for node, hist in found if tree.depth[node] < p.depth]
        for (node, hist), best in zip(found, best_splits(p, [hist for _, hist in found])):
            if best:
                heapq.heappush(heap, (-best[0], node, _Open(node, hist, best)))

    def divide(o: _Open) -> tuple[int, int]:
        kids = tree.split(o.node, int(columns[o.best[1]]), o.best[2], o.best[0])
        for kid, s in zip(kids, o.sums):
            tree.cover[kid], tree.value[kid] = float(s[1]), weight(s)
        return kids

    def both(o: _Open, small: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (small, o.hist - small) if o.small == 0 else (o.hist - small, small)

    offer([(0, root)])
    leaves = 1
    if not p.leaves:
        later: set[int] = set()
        while heap:  # level by level
            level = [heapq.heappop(heap)[2] for _ in range(len(heap))]
            level.sort(key=lambda o: o.node)
            kids = [divide(o) for o in level]
            left = p.depth - tree.depth[kids[0][0]]
            if left >= 2 or p.loss == "quantile":
                later.update(kid for pair in kids for kid in pair if tree.cover[kid] <= rows.unit)
            on = [(o, pair) for o, pair in zip(level, kids) if not later.issuperset(pair)]
            if left <= 0 or not on:
                break
            smalls = yield "hist", tree, [pair[o.small] for o, pair in on], columns, bins
            offer([(kid, hist) for (o, pair), small in zip(on, smalls) for kid, hist in zip(pair, both(o, small)) if kid not in later])
        return whole(tree, (yield "subtrees", tree, sorted(later), columns, bins), columns) if later else (tree, set())
    ahead: dict[int, np.ndarray] = {}
    while heap and leaves < most:
        if heap[0][2].node not in ahead:
            # The best leaves are likely to be split: histograms of one child of each in one aggregation,
            # through a copy of the tree in which they are.
            trial = pickle.loads(pickle.dumps(tree))
            likely = [o for _, _, o in heapq.nsmallest(most - leaves, heap)
                      if o.node not in ahead and tree.depth[o.node] + 1 < p.depth]
            if heap[0][2] in likely:
                kids = [trial.split(o.node, int(columns[o.best[1]]), o.best[2], o.best[0])[o.small] for o in likely]
                rows_before = getattr(rows, "node", None)
                smalls = yield "hist", trial, kids, columns, bins
                for o, small in zip(likely, smalls):
                    ahead[o.node] = small
                if rows_before is not None:
                    rows.node = np.zeros_like(rows_before)  # the copy numbered its nodes for itself
        o = heapq.heappop(heap)[2]
        pair = divide(o)
        leaves += 1
        if o.node in ahead:
            offer(list(zip(pair, both(o, ahead.pop(o.node)))))
    return tree, set()


def _tree(rows, p: BoostParams, number: int, features: int, bins: int) -> Generator[tuple, object, Tree]:
    """One tree with its leaves' values; yields what it asks of the rows."""
    tree, final = yield from _grow(rows, p, number, features, bins)
    leaves = [node for node, f in enumerate(tree.feature) if f < 0 and node not in final]
    if p.loss == "quantile" and leaves:
        found = yield "leaf_quantiles", tree, leaves
        for node in leaves:
            tree.value[node] = p.rate * found.get(node, 0.0)
    return tree


def _train(rows, p: BoostParams, features: int, bins: int) -> Generator[tuple, object, tuple[float, list[Tree]]]:
    """All trees of one model; yields what they ask of the rows."""
    base, trees = rows.base(), []
    for number in range(p.trees):
        tree = yield from _tree(rows, p, number, features, bins)
        rows.finish(tree)
        trees.append(tree)
    return base, trees


def train_together(many: list, features: int, bins: int) -> list[tuple[float, list[Tree]]]:
    """Models over rows that give histograms (all local, or in Spark and sharing their blocks), side by side."""
    return _finish({i: _train(rows, rows.p, features, bins) for i, rows in enumerate(many)}, dict(enumerate(many)))


def _finish(steps: dict[int, Generator], rows: dict[int, object]) -> list:
    """The results of all: each goes on to its next request, and the rows answer the requests."""
    name, out = {id(r): i for i, r in rows.items()}, dict.fromkeys(steps)
    answers = dict.fromkeys(steps)
    while answers:
        asks = []
        for i, answer in answers.items():
            try:
                asks.append((rows[i], steps[i].send(answer)))
            except StopIteration as done:
                out[i] = done.value
        answers = {name[id(r)]: answer for r, answer in rows[0].together(asks)}
    return list(out.values())


def train_rows(rows, p: BoostParams, features: int, bins: int) -> tuple[float, list[Tree]]:
    """All trees of one model."""
    return train_together([rows], features, bins)[0]


#: A node's columns: bounded numbers in few bytes, since a model may have a million nodes.
_NODE = {"tree": np.int32, "node": np.int32, "feature": np.int16, "bin": np.int16, "left": np.int32, "right": np.int32,
         "value": np.float64, "cover": np.float64, "gain": np.float64}


def node_table(trees: list[Tree]) -> dict[str, np.ndarray]:
    """All trees' nodes as columns, which take a fraction of the lists' memory."""
    own = {"tree": lambda i, t: np.full(len(t.feature), i), "node": lambda i, t: np.arange(len(t.feature))}
    of = lambda c, i, t: own[c](i, t) if c in own else getattr(t, c)
    return {c: np.concatenate([np.zeros(0, kind), *(np.asarray(of(c, i, t), kind) for i, t in enumerate(trees))])
            for c, kind in _NODE.items()}


class Scorer:
    """What a task needs to predict: rows are binned by the trees' thresholds and moved down one tree after the other."""

    def __init__(self, model: "BoostedModel"):
        inner, at = model.feature >= 0, np.arange(len(model.feature))
        self.base, self.value, self.feature = model.base, model.value, np.where(inner, model.feature, 0).astype(np.int16)
        self.edges = [np.unique(model.threshold[model.feature == f]) for f in range(len(model.names))]
        most = max(map(len, self.edges), default=0)
        self.kind = np.uint8 if most < 255 else np.int32
        self.cut = np.full(len(at), most, self.kind)  # a leaf leads to itself either way
        for f, e in enumerate(self.edges):
            own = model.feature == f
            self.cut[own] = np.searchsorted(e, model.threshold[own])
        ends = [*model.roots[1:].tolist(), len(at)]
        self.trees = list(zip(model.roots.tolist(), ends))
        root = np.repeat(model.roots, np.diff([*model.roots, len(at)]))
        self.kids = np.stack([model.right - root, model.left - root], 1).astype(np.int32)
        self.depth, now, tree = np.zeros(len(self.trees), np.int64), model.roots, np.arange(len(self.trees))
        while len(now):
            now, tree = now[inner[now]], tree[inner[now]]
            self.depth[np.unique(tree)] += 1
            now, tree = np.concatenate([model.left[now], model.right[now]]), np.concatenate([tree, tree])

    def predict(self, x: np.ndarray, step: int = 4096) -> np.ndarray:
        """Predictions of rows (rows x features); a value at the threshold goes left, NaN right."""
        out = np.full(len(x), self.base)
        for lo in range(0, len(x), step):
            part = x[lo:lo + step]
            n, row = len(part), np.arange(len(part))
            bins = np.stack([np.searchsorted(e, part[:, f]).astype(self.kind) for f, e in enumerate(self.edges)]).reshape(-1)
            found = np.zeros((len(self.trees), n))
            for t, ((first, end), depth) in enumerate(zip(self.trees, self.depth.tolist())):
                start, cut, kids = self.feature[first:end].astype(np.int64) * n, self.cut[first:end], self.kids[first:end].astype(np.int64).reshape(-1)
                node = np.zeros(n, np.int64)
                for _ in range(depth):
                    node = kids.take(2 * node + (bins.take(start.take(node) + row) <= cut.take(node)))
                found[t] = self.value[first:end].take(node)
            out[lo:lo + step] += np.ascontiguousarray(found.T).sum(1)
        return out


class BoostedModel:
    """Fitted trees with real thresholds; ``nodes`` has one row a node, as big as the model."""

    def __init__(self, names: list[str], base: float, nodes: pd.DataFrame):
        self.names, self.base = list(names), float(base)
        self.nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
        start = self.nodes.groupby("tree").size().cumsum().shift(fill_value=0)
        offset = self.nodes["tree"].map(start).to_numpy()
        self.roots = start.to_numpy(np.int64)
        self.feature = self.nodes["feature"].to_numpy(np.int16)
        self.threshold = self.nodes["threshold"].to_numpy(float)
        self.left, self.right = (np.where(self.feature >= 0, self.nodes[c].to_numpy() + offset, np.arange(len(offset))).astype(np.int32)
                                 for c in ("left", "right"))
        self.value, self.cover = self.nodes["value"].to_numpy(float), self.nodes["cover"].to_numpy(float)

    @staticmethod
    def of(names: list[str], edges: list[np.ndarray], base: float, trees: list[Tree]) -> "BoostedModel":
        return BoostedModel.of_table(names, edges, base, node_table(trees))

    @staticmethod
    def of_table(names: list[str], edges: list[np.ndarray], base: float, nodes: dict[str, np.ndarray]) -> "BoostedModel":
        """``of`` the trees' ``node_table``."""
        threshold = np.zeros(len(nodes["feature"]))
        for f, e in enumerate(edges):
            own = nodes["feature"] == f
            threshold[own] = e[nodes["bin"][own]]
        table = pd.DataFrame({**nodes, "bin": threshold}).rename(columns={"bin": "threshold"})
        return BoostedModel(names, base, table)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions of rows (rows x features); a value at the threshold goes left, NaN right."""
        return Scorer(self).predict(x)

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with a prediction from its columns ``names``, in Arrow batches."""
        ship_package(df.sparkSession)
        model = df.sparkSession.sparkContext.broadcast(Scorer(self))

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            m = model.value
            return pd.Series(m.predict(np.stack([c.to_numpy(float) for c in columns], 1)))

        return df.withColumn(out, score(*[F.col(c).cast("double") for c in self.names]))

    def importance(self) -> list[tuple[str, float]]:
        """Each feature's share of all splits' gain."""
        split = self.nodes[self.nodes["feature"] >= 0]
        gain = split.groupby("feature")["gain"].sum()
        total = float(gain.sum()) or 1.0
        return [(n, float(gain.get(i, 0.0)) / total) for i, n in enumerate(self.names)]

    def save(self, spark: SparkSession, path: str) -> None:
        whole = {c: np.int64 for c, kind in _NODE.items() if kind != np.float64 and c in self.nodes.columns}
        spark.createDataFrame(self.nodes.astype(whole)).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(self.base, self.names)], "base double, names array<string>").write.mode("overwrite").parquet(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "BoostedModel":
        r = spark.read.parquet(f"{path}/model").first()
        return BoostedModel(list(r["names"]), r["base"], spark.read.parquet(f"{path}/nodes").toPandas())


# --- blocks --------------------------------------------------------------------------------------

def bin_edges(df: DataFrame, names: list[str], bins: int = 64, error: float = 0.001) -> list[np.ndarray]:
    """Up to bins - 1 thresholds a feature, at about equal shares of the rows."""
    shares = [i / bins for i in range(1, bins)]
    found = df.approxQuantile(names, shares, error) or [[] for _ in names]
    return [np.unique(np.asarray(q, float)) if q else np.zeros(1) for q in found]


def pack_blocks(df: DataFrame, names: list[str], edges: list[np.ndarray], label: str, id_col: str, block_rows: int,
                whole_rows: int) -> DataFrame:
    """Rows (n, key, x, y, margin): one block of up to ``whole_rows`` binned rows; more are blocks of about ``block_rows``,
    and of fewer rows as long as cores have none."""
    ship_package(df.sparkSession)
    count = df.count()
    parts = 1
    if count > whole_rows:
        parts = max(-(-count // block_rows), min(df.sparkSession.sparkContext.defaultParallelism, count // 8192))
    most = 4 * block_rows if parts > 1 else count
    rows = df.select(F.xxhash64(id_col).alias("key"), F.col(label).cast("double").alias("y"),
                     *[F.col(c).cast("double") for c in names])
    if parts > 1:
        dealt = rows.repartition(parts, "key").sortWithinPartitions("key", "y")
    elif count > block_rows:
        dealt = rows.repartition(1).sortWithinPartitions("key", "y", *names)  # what comes before runs in many tasks
    else:
        dealt = rows.coalesce(1).sortWithinPartitions("key", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            key, x, y = (np.concatenate(c, -1) for c in zip(*held))
            return pa.RecordBatch.from_arrays(
                [pa.array([len(y)]), *(pa.array([c.tobytes()], pa.binary()) for c in (key, x, y)), pa.array([None], pa.binary())],
                names=["n", "key", "x", "y", "margin"])

        for batch in batches:
            if batch.num_rows:
                key, y, *values = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                held.append((key, np.stack([np.searchsorted(e, v).astype(np.uint8) for e, v in zip(edges, values)]), y))
            if sum(len(y) for _, _, y in held) >= most:
                if held:
                    yield block()
                held.clear()
        if held:
            yield block()

    return durable_cut(dealt.mapInArrow(run, "n long, key binary, x binary, y binary, margin binary"))


def unpack_block(r: dict, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.frombuffer(r["x"], np.uint8).reshape(features, r["n"]), np.frombuffer(r["key"], np.int64).view(np.uint64),
            np.frombuffer(r["y"], np.float64))


class TrainingSet:
    """Binned blocks of some rows, and the same for held-out rows if there are any. ``block_rows`` are those of every
    block; without it ``BLOCK_ROWS``, and up to ``WHOLE_ROWS`` rows are one block."""

    def __init__(self, df: DataFrame, names: list[str], label: str, id_col: str, valid: DataFrame | None = None,
                 bins: int = 64, block_rows: int | None = None):
        self.names, self.bins, self.block_rows = list(names), bins, block_rows or BLOCK_ROWS
        self.edges = bin_edges(df, self.names, bins)
        self.blocks, self.valid = (
            d if d is None else pack_blocks(d, self.names, self.edges, label, id_col, self.block_rows, block_rows or WHOLE_ROWS)
            for d in (df, valid))
        self.valid_rows, self.label = valid, label
        self.local = self.blocks.count() <= 1 and (valid is None or self.valid.count() <= 1)

    def fit(self, params: list[BoostParams]) -> list[BoostedModel]:
        """One model for each setting."""
        if self.local:
            return [BoostedModel.of_table(self.names, self.edges, *pickle.loads(m)) for m, _ in self._tasks(params, True)]
        shared = Blocks(self.blocks, len(self.names), unit=self.block_rows)
        try:
            found = train_together([SparkRows(p, self.blocks, len(self.names), shared) for p in params], len(self.names), self.bins)
        finally:
            shared.close()
        return [BoostedModel.of(self.names, self.edges, *f) for f in found]

    def errors(self, params: list[BoostParams], parallel: int = 4) -> list[float]:
        """Each setting's mean absolute error on the held-out rows."""
        if self.local:
            return [e for _, e in self._tasks(params, False)]
        with ThreadPoolExecutor(parallel) as pool:
            return list(pool.map(lambda m: m.transform(self.valid_rows, "_p").agg(F.avg(F.abs(F.col("_p") - F.col(self.label)))).first()[0],
                                 self.fit(params)))

    def _tasks(self, params: list[BoostParams], want_model: bool) -> list[tuple[bytes | None, float | None]]:
        """Whole runs over the one block, a task each, those of most work first."""
        spark, features, bins = self.blocks.sparkSession, len(self.names), self.bins
        got = [d.drop("margin").first() for d in (self.blocks, self.valid) if d is not None]  # a block at most
        shared = spark.sparkContext.broadcast([r.asDict() if r else None for r in got])
        n = len(params)
        work = lambda i: params[i].trees * params[i].depth * params[i].rows * params[i].columns
        want = pickle.dumps([(i, params[i]) for i in sorted(range(n), key=work, reverse=True)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for place in batch.column(0).to_pylist():
                    (i, p), (fit, *valid) = pickle.loads(want)[place], shared.value
                    empty = np.zeros((features, 0), np.uint8), np.zeros(0, np.uint64), np.zeros(0)
                    base, trees = train_rows(LocalRows(p, *(unpack_block(fit, features) if fit else empty)), p, features, bins)
                    error = None
                    if valid and valid[0]:
                        x, _, y = unpack_block(valid[0], features)
                        at = np.full(len(y), base)
                        for t in trees:
                            at += np.array(t.value)[t.advance(x, np.zeros(len(y), np.int64))]
                        error = float(np.abs(at - y).mean())
                    model = pickle.dumps((base, node_table(trees))) if want_model else None
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([model], pa.binary()), pa.array([error], pa.float64())],
                                                     names=["i", "model", "error"])

        rows = spark.range(0, n, 1, n).mapInArrow(run, "i long, model binary, error double").collect()
        shared.destroy()
        return [(r["model"], r["error"]) for r in sorted(rows, key=lambda r: r["i"])]


def with_params(p: BoostParams, **changes) -> BoostParams:
    return replace(p, **changes)
