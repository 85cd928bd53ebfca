"""Exact top-k inner products by dual-tree search over cover trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clvforge.llm.common import cut
from clvforge.llm.vectors import pack_vectors, products

_NONE = np.iinfo(np.int64).min
_SLACK = 1e-6


class CoverTree:
    """Points covered by balls whose radii shrink from level to level.

    A node holds a centre and the radius that covers all its points. Its children form a greedy
    cover: their seeds are points of the node, each the one farthest from those before it, until
    every point is within ``shrink`` times the radius of a seed or there are ``fan`` of them (with
    many dimensions nearly every point is far from all others); each point goes to its nearest seed,
    and the child's radius is what then covers it. Equal points share a leaf.
    """

    def __init__(self, points: np.ndarray, members: np.ndarray | None = None, shrink: float = 0.6, leaf: int = 128,
                 fan: int = 8):
        members = np.arange(len(points)) if members is None else members
        own = points[members]
        self.centre = own[0] if (own == own[0]).all() else own.mean(0)  # rounding must not part equal points
        away = np.sqrt(((own - self.centre) ** 2).sum(1))
        self.radius = float(away.max(initial=0.0))
        self.norm = float(np.sqrt(self.centre @ self.centre))
        self.members, self.children = members, []
        if len(members) <= leaf or self.radius == 0:
            return
        near = np.full(len(members), np.inf)
        owner = np.zeros(len(members), np.int64)
        at, n = int(away.argmin()), 0
        while n < 2 or n < fan and near.max() > shrink * self.radius:
            d = np.sqrt(((own - own[at]) ** 2).sum(1))
            owner[d < near] = n
            near = np.minimum(near, d)
            at, n = int(near.argmax()), n + 1
        self.children = [CoverTree(points, members[owner == c], shrink, leaf, fan) for c in range(n) if (owner == c).any()]


def upper_bound(c1, n1, r1, c2, n2, r2):
    """No pair of points of the two balls has a greater inner product."""
    dot = np.dot(c1, c2)
    return dot + r1 * n2 + r2 * n1 + r1 * r2 + _SLACK * (1 + n1 * n2 + r1 * n2 + r2 * n1 + r1 * r2)


class DualSearch:
    """Best k candidates of each query, over any number of data trees."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.tree = CoverTree(vectors.astype(float), leaf=64)
        self.score = np.full((len(ids), k), _NONE)
        self.found = np.full((len(ids), k), -1, np.int64)
        self.floor = np.full(len(ids), _NONE) if floor is None else floor

    def worst(self, members: np.ndarray) -> int:
        """The worst kth score of a query group."""
        return int(np.maximum(self.score[members, -1], self.floor[members]).min())

    def search(self, ids: np.ndarray, vectors: np.ndarray, tree: CoverTree) -> None:
        stack = [(0.0, self.tree, tree)]
        while stack:
            _, q, x = stack.pop()
            if upper_bound(q.centre, q.norm, q.radius, x.centre, x.norm, x.radius) < self.worst(q.members):
                continue
            if not q.children and not x.children:
                self._leaf(q.members, ids[x.members], vectors[x.members])
                continue
            if x.children and (not q.children or x.radius >= q.radius):
                pairs = [(q, c) for c in x.children]
            else:
                pairs = [(c, x) for c in q.children]
            stack += sorted(((upper_bound(a.centre, a.norm, a.radius, b.centre, b.norm, b.radius), a, b)
                             for a, b in pairs), key=lambda p: p[0])  # the most promising pair is next

    def _leaf(self, q: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        score = products(self.vectors[q], vectors)
        reach = score >= np.maximum(self.score[q, -1], self.floor[q])[:, None]
        asks, some = reach.any(1), reach.any(0)  # the rest changes no query's best k
        if not some.any():
            return
        q, ids, score = q[asks], ids[some], score[np.ix_(asks, some)]
        own = self.ids[q][:, None] == ids[None, :]
        score = np.concatenate([self.score[q], np.where(own, _NONE, score)], 1)
        found = np.concatenate([self.found[q], np.where(own, -1, np.broadcast_to(ids, own.shape))], 1)
        order = np.lexsort((np.where(found < 0, np.iinfo(np.int64).max, found), ~score), axis=1)[:, :self.k]
        self.score[q] = np.take_along_axis(score, order, 1)
        self.found[q] = np.take_along_axis(found, order, 1)


def _unpack(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, "<i8").reshape(-1, dim)


class Router:
    """A cover tree over a bounded sample of the vectors of one length: its leaves say which vectors lie together.

    Arrays over nodes, the root first: centre, parent, children. ``path`` gives a leaf's nodes from the root.
    """

    def __init__(self, points: np.ndarray, leaf: int):
        self.centre, self.children, self.paths = [], [], {}
        stack = [(CoverTree(points, leaf=leaf), [])]
        while stack:
            tree, above = stack.pop()
            number = len(self.centre)
            self.centre.append(tree.centre)
            self.children.append([])
            if above:
                self.children[above[-1]].append(number)
            if tree.children:
                stack += [(c, [*above, number]) for c in tree.children]
            else:
                self.paths[number] = [*above, number]
        self.centre = np.array(self.centre)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: from the root, always to the child of the nearest centre."""
        out = np.zeros(len(x), np.int32)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            kids = self.children[node]
            if not kids or not len(rows):
                out[rows] = node
                continue
            c = self.centre[kids]
            near = ((c * c).sum(1) - 2 * x[rows] @ c.T).argmin(1)
            stack += [(kid, rows[near == k]) for k, kid in enumerate(kids)]
        return out


class Nodes:
    """Covering radii of a router's nodes over the data, and over the queries with their worst kth score."""

    def __init__(self, router: Router, data: dict[int, float], asks: dict[int, tuple[float, int]]):
        n = len(router.centre)
        self.router, self.norm = router, np.sqrt((router.centre ** 2).sum(1))
        self.data = np.array([data.get(i, -1.0) for i in range(n)])  # -1: nothing lies there
        self.asks = np.array([asks.get(i, (-1.0, 0))[0] for i in range(n)])
        self.worst = [asks.get(i, (-1.0, 0))[1] for i in range(n)]

    def leaf_pairs(self, start: int) -> Iterator[tuple[int, int]]:
        """Pairs of a query leaf under ``start`` and a data leaf that the radii leave, descending both trees."""
        kids, stack = self.router.children, [(start, 0)]
        while stack:
            q, d = stack.pop()
            if self.asks[q] < 0 or self.data[d] < 0 or upper_bound(
                    self.router.centre[q], self.norm[q], self.asks[q], self.router.centre[d], self.norm[d], self.data[d]) < self.worst[q]:
                continue
            if not kids[q] and not kids[d]:
                yield q, d
            elif kids[d] and (not kids[q] or self.data[d] >= self.asks[q]):
                stack += [(q, c) for c in kids[d]]
            else:
                stack += [(c, d) for c in kids[q]]


def _routers(rows: DataFrame, block: int, sample: int) -> dict[int, Router]:
    """A router for each vector length; a leaf's expected share of the rows is a block."""
    total = rows.count()
    pick = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < max(1, (sample << 20) // max(1, total)))
    by_dim: dict[int, list[bytes]] = {}
    for r in pick.orderBy(F.xxhash64("vec_id"), "vec").limit(2 * sample).collect():
        by_dim.setdefault(r["dim"], []).append(bytes(r["vec"]))
    taken = sum(map(len, by_dim.values()))
    leaf = max(4, -(-taken * block // max(1, total)))
    return {dim: Router(_unpack(b"".join(blobs), dim).astype(float), leaf) for dim, blobs in by_dim.items() if dim}


def _assign(rows: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            leaf = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                at, router = np.flatnonzero(dims == dim), shared.value.get(int(dim))
                if router is not None:
                    leaf[at] = router.leaf(_unpack(b"".join(batch.column(2)[i].as_py() for i in at.tolist()), int(dim)).astype(float))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["vec_id", "dim", "vec", "leaf"])

    return rows.mapInArrow(run, "vec_id long, dim int, vec binary, leaf int")


_BLOCK = ("dim int, leaf int, part long, ids binary, vecs binary, centre array<double>, norm double, radius double, "
          "nodes array<int>, reach array<double>")


def _pack(shared):
    def run(rows: pa.Table) -> pa.Table:
        """One row for a block of vectors: the ball that holds them, and how far they reach from the nodes above."""
        dim, leaf = rows.column("dim")[0].as_py(), rows.column("leaf")[0].as_py()
        blob = b"".join(rows.column("vec").to_pylist())
        x = _unpack(blob, dim).astype(float) if dim else np.zeros((rows.num_rows, 0))
        centre = x.mean(0)
        away = lambda c: float(np.sqrt(((x - c) ** 2).sum(1)).max(initial=0.0))
        router = shared.value.get(dim)
        nodes = router.paths[leaf] if router else [0]
        reach = [away(router.centre[n]) for n in nodes] if router else [0.0]
        ids = rows.column("vec_id").to_numpy().astype("<i8").tobytes()
        return pa.table({"dim": pa.array([dim], pa.int32()), "leaf": pa.array([leaf], pa.int32()),
                         "part": rows.column("part").slice(0, 1), "ids": pa.array([ids], pa.binary()),
                         "vecs": pa.array([blob], pa.binary()), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())),
                         "norm": [float(np.sqrt(centre @ centre))], "radius": [away(centre)],
                         "nodes": pa.array([nodes], pa.list_(pa.int32())), "reach": pa.array([reach], pa.list_(pa.float64()))})
    return run


def _blocks(rows: DataFrame, size: int, shared) -> DataFrame:
    """Blocks of about ``size`` vectors of one leaf; a hot leaf has many blocks."""
    many = rows.groupBy("dim", "leaf").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    dealt = rows.join(many, ["dim", "leaf"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "vec"), "parts"))
    return cut(dealt.select("dim", "leaf", "part", "vec_id", "vec").groupBy("dim", "leaf", "part").applyInArrow(_pack(shared), _BLOCK))


def _leaf_pairs(routers: dict[int, Router], data: DataFrame, queries: DataFrame, spark, salts: int) -> DataFrame:
    """(dim, ask_leaf, leaf, salt): pairs of leaves that neither their radii nor those of the nodes above rule out, once for
    each of the data leaf's salts (a block's part modulo ``salts``).

    Radii and worst scores are summed up per node in Spark; there are fewer nodes than sampled vectors.
    """
    reach = lambda df, c, how: df.select("dim", c, F.explode(F.arrays_zip("nodes", "reach")).alias("n")).groupBy(
        "dim", F.col("n.nodes").alias("node")).agg(F.max("n.reach").alias("radius"), how(c).alias(c)).collect()
    far: dict[int, dict] = {}
    ask: dict[int, dict] = {}
    last: dict[tuple[int, int], int] = {}
    for r in reach(data, "part", F.max):
        far.setdefault(r["dim"], {})[r["node"]] = r["radius"]
        last[r["dim"], r["node"]] = min(salts - 1, r["part"])
    for r in reach(queries, "worst", F.min):
        ask.setdefault(r["dim"], {})[r["node"]] = (r["radius"], r["worst"])
    nodes = {dim: Nodes(router, far.get(dim, {}), ask.get(dim, {})) for dim, router in routers.items()}
    shared = spark.sparkContext.broadcast((nodes, last))
    starts = [(dim, n) for dim, r in routers.items() for n in _level(r, 2)] + [(dim, -1) for dim in far if dim not in routers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, last = shared.value
        for batch in batches:
            for dim, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = nodes[dim].leaf_pairs(start) if start >= 0 else [(0, 0)]
                pairs = np.array([(q, d, s) for q, d in found for s in range(last.get((dim, d), -1) + 1)], np.int32).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), dim, np.int32)), *map(pa.array, np.ascontiguousarray(pairs.T))],
                                                 names=["dim", "ask_leaf", "leaf", "salt"])

    frame = spark.createDataFrame(starts or [(0, -1)], "dim int, start int").repartition(max(1, min(len(starts), 64)), "dim", "start")
    return frame.mapInArrow(run, "dim int, ask_leaf int, leaf int, salt int")


def _level(router: Router, depth: int) -> list[int]:
    """Nodes ``depth`` levels down, or leaves above."""
    now = [0]
    for _ in range(depth):
        now = [k for n in now for k in (router.children[n] or [n])]
    return now


def _visit(visits: DataFrame, k: int) -> DataFrame:
    """Streams each data block and the query blocks that visit it, and searches tree against tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = None
        for batch in batches:
            for i in range(batch.num_rows):  # one row's vectors at a time leave the batch
                r = {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}
                ids, dim = np.frombuffer(r["ids"], "<i8"), r["dim"]
                vecs = _unpack(r["vecs"], dim) if dim else np.zeros((len(ids), 0), np.int64)
                if r["asks"] is None:
                    data = (ids, vecs, CoverTree(vecs.astype(float)))
                    continue
                search = DualSearch(ids, vecs, k, np.frombuffer(r["floor"], "<i8") if r["floor"] else None)
                search.search(*data)
                q, c = np.nonzero((search.score > _NONE) & (search.score >= search.floor[:, None]))  # the rest is not among the best k
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["asks"]] * len(q), pa.string()), pa.array(q.astype(np.int32)), pa.array(ids[q]),
                     pa.array(search.found[q, c]), pa.array(search.score[q, c])],
                    names=["asks", "place", "query_id", "vec_id", "score"])

    return visits.mapInArrow(run, "asks string, place int, query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("asks", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cover_tree_topk(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id",
                    vec_col: str = "embedding", block: int = 2048, asks: int = 256, sample: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest integer inner products of each query.

    Queries are the rows whose id is divisible by ``every``, candidates all rows with another id;
    components are floor(scale * x); ties go to the smaller id, fewer candidates give fewer rows.
    Null ids, null vectors and vectors with null or non-finite components take no part; only vectors
    of equal length are compared, those of length 0 with score 0. A repeated row is one query and
    several candidates. Components or scores beyond 62 bits are an error. An empty table gives no rows.

    Queries and data are indexed together by a cover tree whose upper levels, with centres from a
    sample of about ``sample`` vectors, the driver holds. Vectors go to its leaves and there form blocks
    of bounded size, each with a covering ball and a cover tree of its own. Query blocks first search
    a block of their own leaf. Then both trees are descended with the covering radii that the blocks
    report for each node, and with the worst kth score under a query node: pairs of nodes, then of a
    query block and a data block, then of nodes within these go where their radii cannot reach that
    score. Blocks meet by the pair of leaves that is left, so no key holds all blocks. Per query, each
    data block returns k rows at most.
    """
    spark = vectors.sparkSession
    rows = cut(pack_vectors(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")), scale))
    routers = _routers(rows, block, sample)
    shared = spark.sparkContext.broadcast(routers)
    placed = cut(_assign(rows, shared))
    data = _blocks(placed, block, shared)
    queries = _blocks(placed.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vec"]), asks, shared)
    name = F.concat_ws("/", "dim", "leaf", "part")
    data = data.withColumn("block", name).withColumn("asks", F.lit(None).cast("string")).withColumn("floor", F.lit(None).cast("binary"))
    queries = queries.withColumn("asks", name).withColumn("floor", F.lit(None).cast("binary"))
    fields = ["block", "asks", "dim", "ids", "vecs", "floor"]

    def visit(pairs: DataFrame, asking: DataFrame) -> DataFrame:
        visited = data.join(pairs.select("block").distinct(), "block", "left_semi").select(*fields)
        # Pairs repeat few names, so that their file says little about their size in memory: never broadcast.
        asked = asking.join(pairs.hint("merge"), "asks").select(*fields)
        both = visited.union(asked).repartition("block").sortWithinPartitions("block", F.asc_nulls_first("asks"))
        return cut(_visit(both, k))

    home = queries.select("asks", F.concat_ws("/", "dim", "leaf", F.lit(0)).alias("block"))
    first = visit(home, queries.drop("block"))
    kth = _best(first, k).groupBy("asks", "place").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    worst = kth.groupBy("asks").agg(F.map_from_entries(F.collect_list(F.struct("place", "kth"))).alias("known"))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, least = [], []
            for known, ids in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                floor = np.full(len(ids) // 8, _NONE)
                for place, score in known or []:
                    if score is not None:
                        floor[place] = score
                out.append(floor.astype("<i8").tobytes())
                least.append(int(floor.min()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(least, pa.int64())],
                                             names=["asks", "floor", "worst"])

    asked = queries.select("asks", "ids").join(worst, "asks", "left").select("asks", "known", "ids")
    group = cut(asked.mapInArrow(floors, "asks string, floor binary, worst long"))
    asking = queries.drop("floor").join(group, "asks")
    salts = 16  # a hot leaf's blocks are spread over as many keys
    dot = F.aggregate(F.zip_with("q.centre", "d.centre", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    spread = (F.col("q.radius") * F.col("d.norm") + F.col("d.radius") * F.col("q.norm") + F.col("q.radius") * F.col("d.radius"))
    bound = dot + spread + F.lit(_SLACK) * (1 + F.col("q.norm") * F.col("d.norm") + spread)
    ball = ["dim", "leaf", "part", "centre", "norm", "radius"]
    d = data.select(*ball, "block", F.pmod("part", F.lit(salts)).alias("salt")).alias("d")
    q = asking.select(*ball, "asks", "worst").alias("q")
    # Spark takes the pairs to be as few as the nodes they start from, so says the hint: they are not to be broadcast.
    p = _leaf_pairs(routers, data, asking, spark, salts).hint("merge").alias("p")
    rest = (p.join(d, F.expr("p.dim = d.dim AND p.leaf = d.leaf AND p.salt = d.salt"))
            .join(q, F.expr("p.dim = q.dim AND p.ask_leaf = q.leaf"))
            .filter(F.expr("NOT (q.leaf = d.leaf AND d.part = 0)")).filter(bound >= F.col("q.worst")).select("q.asks", "d.block"))
    second = visit(cut(rest), asking)
    return _best(first.union(second), k).select("query_id", "rank", "vec_id", "score")
