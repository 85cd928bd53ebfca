"""Hard-negative mining by a secondary sort of packed pair keys."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clvforge.llm.common import cut, shuffle_partitions
from clvforge.llm.vectors import pack_vectors, products

_NONE = np.iinfo(np.int64).min
_SIGN = np.uint64(1 << 63)
#: Pairs that a task scores at once; it bounds the score matrix to some MB.
_AT_ONCE = 1 << 20


def _unpack(column: pa.Array, dim: int) -> np.ndarray:
    blob = b"".join(column.to_pylist())
    return np.frombuffer(blob, "<i8").reshape(len(column), dim) if dim else np.zeros((len(column), 0), np.int64)


_CELL = "dim int, cell long, kind int, vec_id long, label long, vec binary, scores binary"


def _deal(anchors: DataFrame, data: DataFrame, rows: int, columns: int, parts: int) -> DataFrame:
    """Anchors and data dealt to a grid of cells; each pair of an anchor and a row meets in one cell.

    An anchor goes to every column of its row of the grid, a data row to every row of its column.
    Rows of the grid hold a bounded number of anchors, so a task keeps these and streams the data;
    cells are dealt by a hash of the id, so no label or vector makes one hot.
    """
    r = F.pmod(F.xxhash64("vec_id", F.lit("row")), F.lit(rows))
    c = F.pmod(F.xxhash64("vec_id", "vec", F.lit("column")), F.lit(columns))
    asking = anchors.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))).select(
        "dim", (r * columns + F.col("to")).alias("cell"), F.lit(0).alias("kind"), "vec_id", "label", "vec", "scores")
    offered = data.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).select(
        "dim", (F.col("to") * columns + c).alias("cell"), F.lit(1).alias("kind"), "vec_id", "label", "vec",
        F.lit(None).cast("binary").alias("scores"))
    return asking.union(offered).repartition(parts, "dim", "cell").sortWithinPartitions("dim", "cell", "kind", "vec_id")


class _Best:
    """The k best (score, id) of each of n lists, ties to the smaller id; ``row`` tells equal ones apart."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), _NONE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.row = np.full((n, k), -1, np.int64)

    def offer(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        score = np.concatenate([self.score[at], score], 1)
        ids = np.concatenate([self.id[at], ids], 1)
        row = np.concatenate([self.row[at], row], 1)
        order = np.lexsort((row, ids, ~score), axis=1)[:, :self.k]
        self.score[at], self.id[at], self.row[at] = (np.take_along_axis(x, order, 1) for x in (score, ids, row))


class _Positives:
    """Best rows with the anchor's label that a cell has shown so far."""

    def __init__(self, anchors: pa.Table, dim: int, k: int, _: int):
        self.ids, self.vecs = anchors["vec_id"].to_numpy(), _unpack(anchors["vec"].combine_chunks(), dim)
        label = anchors["label"].to_numpy()
        self.of = {x: np.flatnonzero(label == x) for x in np.unique(label)}
        self.k, self.best = k, _Best(len(label), k)

    def show(self, ids: np.ndarray, label: np.ndarray, vecs: np.ndarray, row: np.ndarray) -> None:
        for x in np.unique(label):
            at, on = self.of.get(x), np.flatnonzero(label == x)
            if at is None:
                continue
            for lo in range(0, len(at), max(1, _AT_ONCE // len(on))):
                some = at[lo:lo + max(1, _AT_ONCE // len(on))]
                score = products(self.vecs[some], vecs[on])
                score[self.ids[some][:, None] == ids[on][None, :]] = _NONE
                order = np.argsort(~score, axis=1, kind="stable")[:, :self.k]  # ids ascend, so ties keep their order
                self.best.offer(some, np.take_along_axis(score, order, 1), ids[on][order], row[on][order])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, j = np.nonzero(self.best.score > _NONE)
        return self.ids[a], self.best.score[a, j], self.best.id[a, j]


class _Negatives:
    """Per positive window of an anchor, the first rows of other labels that a cell has shown so far.

    No list needs more than its first ``k``: the others of this cell come after them in every
    order of the whole table.
    """

    def __init__(self, anchors: pa.Table, dim: int, k: int, low: int):
        self.ids, self.vecs = anchors["vec_id"].to_numpy(), _unpack(anchors["vec"].combine_chunks(), dim)
        self.label = anchors["label"].to_numpy()
        tops = [np.frombuffer(x, "<i8") for x in anchors["scores"].to_pylist()]
        n, self.k = max(map(len, tops), default=0), k
        self.high, self.low = np.full((len(tops), n), _NONE), np.full((len(tops), n), np.iinfo(np.int64).max)
        for i, top in enumerate(tops):
            self.high[i, :len(top)] = top
            self.low[i, :len(top)] = [-(-low * int(p) // 100) for p in top]
        self.best = [_Best(len(tops), k) for _ in range(n)]

    def show(self, ids: np.ndarray, label: np.ndarray, vecs: np.ndarray, row: np.ndarray) -> None:
        for lo in range(0, len(self.ids), max(1, _AT_ONCE // len(ids))):
            at = np.arange(lo, min(lo + max(1, _AT_ONCE // len(ids)), len(self.ids)))
            score = products(self.vecs[at], vecs)
            score[(self.label[at][:, None] == label[None, :]) | (self.ids[at][:, None] == ids[None, :])] = _NONE
            order = np.argsort(~score, axis=1, kind="stable")
            ranked = np.take_along_axis(score, order, 1)
            for w, best in enumerate(self.best):
                high, least = self.high[at, w], self.low[at, w]
                place = (score > high[:, None]).sum(1)[:, None] + np.arange(self.k)
                inside = np.minimum(place, len(ids) - 1)
                got = np.take_along_axis(ranked, inside, 1)
                got = np.where((place < len(ids)) & (got >= least[:, None]), got, _NONE)
                some = np.flatnonzero((got > _NONE).any(1))
                if len(some):
                    which = np.take_along_axis(order, inside, 1)[some]
                    best.offer(at[some], got[some], ids[which], row[which])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kept: list[np.ndarray] = [np.zeros((0, 4), np.int64)]
        for best in self.best:
            a, j = np.nonzero(best.score > _NONE)
            kept.append(np.stack([a, best.row[a, j], best.score[a, j], best.id[a, j]], 1))
        a, _, score, ids = np.unique(np.concatenate(kept), axis=0).T  # a row may stand in several windows
        return self.ids[a], score, ids


def pack_keys(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, kind: int) -> pa.Array:
    """25-byte keys whose byte order is anchor, descending score, kind, id."""
    key = np.zeros(len(anchor), np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")]))
    key["anchor"] = anchor.astype(np.int64).view(np.uint64) ^ _SIGN
    key["score"] = ~(score.astype(np.int64).view(np.uint64) ^ _SIGN)
    key["kind"] = kind
    key["id"] = ids.astype(np.int64).view(np.uint64) ^ _SIGN
    offsets = np.arange(len(key) + 1, dtype=np.int32) * key.itemsize
    return pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(key.tobytes())])


def unpack_keys(keys: list[bytes]) -> tuple[list[int], list[int], list[int], list[int]]:
    """(anchor, score, kind, id) of packed keys."""
    key = np.frombuffer(b"".join(keys), np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")]))
    back = lambda x: (x.astype(np.uint64) ^ _SIGN).view(np.int64).tolist()
    return back(key["anchor"]), back(~key["score"].astype(np.uint64)), key["kind"].tolist(), back(key["id"])


def _score_cells(dealt: DataFrame, keep: type, kind: int, k: int, low: int) -> DataFrame:
    """Streams each cell's data past its anchors; packed keys of the pairs that ``keep`` has kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchors, state, row = None, [], None, 0

        def done() -> Iterator[pa.RecordBatch]:
            if state is not None:
                yield pa.RecordBatch.from_arrays([pack_keys(*state.found(), kind)], names=["key"])

        for batch in batches:
            dim, cell, is_data = (batch.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero((np.diff(dim) != 0) | (np.diff(cell) != 0) | (np.diff(is_data) != 0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(dim)]):
                if lo == hi:
                    continue
                if now != (dim[lo], cell[lo]):
                    yield from done()
                    now, anchors, state, row = (dim[lo], cell[lo]), [], None, 0
                if not is_data[lo]:
                    anchors.append(batch.slice(lo, hi - lo))
                    continue
                if not anchors:
                    continue
                if state is None:
                    state = keep(pa.Table.from_batches(anchors), int(dim[lo]), k, low)
                for at in range(lo, hi, 2048):
                    part = batch.slice(at, min(2048, hi - at))
                    state.show(part.column(3).to_numpy(), part.column(4).to_numpy(), _unpack(part.column(5), int(dim[lo])),
                               np.arange(row, row + part.num_rows))
                    row += part.num_rows
        yield from done()

    return dealt.mapInArrow(run, "key binary")


def secondary_sort(pairs: DataFrame, parts: int) -> DataFrame:
    """Packed keys, all of an anchor in one partition, each partition in key order."""
    return pairs.repartition(parts, F.substring("key", 1, 8)).sortWithinPartitions("key")


def _first(keys: DataFrame, k: int) -> DataFrame:
    """(vec_id, scores, key): of each anchor the first k keys of the stream and their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken = None, []

        def done() -> pa.RecordBatch:
            _, score, _, _ = unpack_keys(taken)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.array(score, "<i8").tobytes()], pa.binary()),
                                               pa.array([taken], pa.list_(pa.binary()))], names=["vec_id", "scores", "keys"])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for anchor, key in zip(unpack_keys(keys)[0], keys):
                if anchor != now:
                    if taken:
                        yield done()
                    now, taken = anchor, []
                if len(taken) < k:
                    taken.append(key)
        if taken:
            yield done()

    return keys.mapInArrow(run, "vec_id long, scores binary, keys array<binary>")


_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _open_windows(keys: DataFrame, negatives: int, low: int) -> DataFrame:
    """Streams each anchor's pairs by descending score: a positive opens a window, negatives fill the open ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, windows = None, []
        for batch in batches:
            out = []
            for anchor, score, kind, other in zip(*unpack_keys(batch.column(0).to_pylist())):
                if anchor != now:
                    now, windows = anchor, []
                if kind == 0:
                    windows.append([other, score, 0])
                    continue
                windows = [w for w in windows if w[2] < negatives and low * w[1] <= 100 * score]  # later scores are no higher
                for w in windows:
                    w[2] += 1
                    out.append((anchor, w[0], w[2], other, w[1], score))
            if out:
                a, p, r, n, ps, ns = map(list, zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(p, pa.int64()), pa.array(r, pa.int32()), pa.array(n, pa.int64()),
                     pa.array(ps, pa.int64()), pa.array(ns, pa.int64())],
                    names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return keys.mapInArrow(run, _OUT)


def mine_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, every: int = 100,
                   scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                   asks: int = 4096) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``. A row's score is its integer inner
    product with the anchor, components being floor(scale * x); the order is by descending score,
    then ascending id. An anchor's positives are its first rows of the same label with another id.
    For each positive, the result has the first rows of other labels whose score is at most the
    positive's and at least ``low`` percent of it (0 <= low <= 100); a positive with a negative
    score therefore has none, and positives without any give no row.

    Rows with a null id, label or vector, or a null or non-finite component take no part; only
    vectors of equal length are compared, those of length 0 with score 0. A repeated row is
    several candidates; rows that share an anchor's id are one anchor, the one with the smallest
    label, then vector. Scores beyond 62 bits are an error. Other columns, whatever their names, stay
    out. An empty table gives no rows.

    Anchors and rows meet in a grid of cells: a cell keeps a bounded number of anchors and streams
    its rows in blocks. Positives come first: each cell returns its best few an anchor. Their scores
    then go with the anchors through the grid again, so that of each window a cell returns only the
    first few negatives, the others being behind them everywhere. The pairs left are packed into
    keys (anchor, descending score, id), a positive before the negatives of its score, and go
    through one shuffle that sorts them within partitions; a streaming pass opens a window at each
    positive, and emits negatives until it is full or the score has left it. An anchor's pairs are
    never held at once.
    """
    spark = vectors.sparkSession
    rows = cut(pack_vectors(vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        F.col(vec_col).cast("array<double>").alias("v")), scale))
    anchors = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(
        F.min(F.struct("label", "dim", "vec")).alias("a")).select("vec_id", "a.label", "a.dim", "a.vec")
    n, asked = rows.count(), anchors.count()
    parts = shuffle_partitions(spark)
    high = max(1, math.ceil(asked / asks))
    wide = max(1, math.ceil(min(parts, n / 1024) / high), math.ceil(n / (1 << 18)))
    cells = lambda a: _deal(a, rows, high, wide, max(parts, high * wide))
    nothing = F.lit(None).cast("binary").alias("scores")
    best = _score_cells(cells(anchors.select("*", nothing)), _Positives, 0, positives, low)
    first = cut(_first(secondary_sort(best, parts), positives))
    asking = anchors.join(first.select("vec_id", "scores"), "vec_id")
    near = _score_cells(cells(asking), _Negatives, 1, negatives, low)
    pairs = first.select(F.explode("keys").alias("key")).union(near)
    return _open_windows(secondary_sort(pairs, parts), negatives, low)
