"""Prefix trie of conversations by truncation peeling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clvforge.llm.common import cut

#: Bytes of a turn in a path: 16 of its digest, 4 of its text's length.
_TURN = 20
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_STATE = ["conv_id", "n_convs", "n_children", "n_leaves", "saved"]


def _upto(path, turns) -> Column:
    """The first turns of a path."""
    path = F.col(path) if isinstance(path, str) else path
    return F.substr(path, F.lit(1), F.lit(turns) * _TURN if isinstance(turns, int) else turns * _TURN)


def turn_paths(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """(conv_id, path): a conversation's turns in order, 20 bytes each, equal where role and text are.

    Turns are ordered by ``turn``, null first, ties by role, then by the text's digest. Null role and
    text are empty; rows with a null id belong to no conversation. Whole texts are read where they
    are and never shuffled; one conversation's path is one value.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    name = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    entry = F.concat(name, F.lpad(F.hex(F.length(text)), 8, "0"))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), role.alias("role"), entry.alias("entry")).alias("t")).filter("conv_id IS NOT NULL")
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return ordered.select("conv_id", F.unhex(F.array_join(F.transform("ts", lambda t: t["entry"]), "")).alias("path"))


def share_heads(paths: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """Each conversation c rebuilt: the first h turns of conversation c - c % every, then its own after its first h.

    h is the unsigned crc32 of c in decimal, modulo ``most`` + 1.
    """
    heads = paths.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), _upto("path", most).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    rest = F.substr("path", (h * _TURN + 1).cast("int"), F.lit(2 ** 31 - 1))
    own = paths.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.cast("int").alias("h"), rest.alias("rest"))
    return own.join(heads, "base", "left").select(
        "conv_id", F.concat(_upto(F.coalesce("head", F.lit(b"")), F.col("h")), F.col("rest")).alias("path"))


def merge_copies(paths: DataFrame) -> DataFrame:
    """Conversations with equal paths merged: depth, path, state and ends_sha256.

    Ids are joined in blocks of 4,096 consecutive numbers, so that many copies are spread over
    tasks; only the digest, whose bytes have one order, is then continued block by block.
    """
    block = F.shiftright("conv_id", 12)
    blocks = paths.groupBy("path", block.alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids")).select(
        "path", "block", F.col("ids")[0].alias("conv_id"), F.size("ids").cast("long").alias("n"), F.array_join("ids", ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, n, sha = None, 0, 0, None
        out: list[tuple] = []
        for batch in batches:
            for path, least, size, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if path == now:
                    n += size
                    sha.update(("," + ids).encode())
                    continue
                if sha is not None:
                    out.append((now, first, n, sha.hexdigest()))
                now, first, n, sha = path, least, size, hashlib.sha256(ids.encode())
            if out:
                yield as_batch(out)
                out = []
        if sha is not None:
            yield as_batch([(now, first, n, sha.hexdigest())])

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*rows)), kinds)],
                                          names=["path", "conv_id", "n_convs", "ends_sha256"])

    merged = (blocks.repartition("path").sortWithinPartitions("path", "block").select("path", "conv_id", "n", "ids")
              .mapInArrow(run, "path binary, conv_id long, n_convs long, ends_sha256 string"))
    zero = F.lit(0).cast("long")
    return merged.select((F.octet_length("path") / _TURN).cast("int").alias("depth"), "path", "conv_id", "n_convs",
                         zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved"), "ends_sha256")


def _regroup(items: DataFrame) -> DataFrame:
    """Nodes of one depth from the conversations that end there and the survivors of the next; summed before the shuffle."""
    sums = [F.sum(c).alias(c) for c in _STATE[1:]]
    nodes = items.groupBy("depth", "path").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    chars = F.when(F.col("depth") == 0, F.lit(0)).otherwise(
        F.conv(F.hex(F.substr("path", F.octet_length("path") - 3, F.lit(4))), 16, 10).cast("long"))
    parent = F.when(F.col("depth") > 0, F.md5(_upto("path", F.col("depth") - 1)))
    return nodes.select(
        "depth", "path", F.md5("path").alias("node"), parent.alias("parent"), "conv_id", "n_convs", "n_children",
        F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves")).alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * chars).alias("saved"), "ends_sha256")


def _strip(nodes: DataFrame) -> DataFrame:
    """Nodes without their last turn: survivors, one child each, of the depth above."""
    return nodes.select((F.col("depth") - 1).alias("depth"), _upto("path", F.col("depth") - 1).alias("path"), "conv_id", "n_convs",
                        F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved", F.lit(None).cast("string").alias("ends_sha256"))


_NODE = ("depth int, path binary, node string, parent string, conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved long, ends_sha256 string")


def _peel_homes(items: DataFrame, bottom: int) -> DataFrame:
    """All nodes deeper than ``bottom``, each group of items with one prefix of that depth peeled in its task.

    Only nodes just below the bottom have a path in the result.
    """

    def peel(group: pa.Table) -> pa.Table:
        levels: dict[int, list[tuple]] = {}
        for item in group.to_pylist():
            path, depth = item["path"], item["depth"]
            digest = hashlib.md5(path[:_TURN * bottom])
            chain = [digest.hexdigest()]
            for at in range(_TURN * bottom, len(path), _TURN):
                digest.update(path[at:at + _TURN])
                chain.append(digest.hexdigest())
            levels.setdefault(depth, []).append((chain, path, [item[c] for c in _STATE], item["ends_sha256"]))
        out, survivors = [], {}
        for depth in range(max(levels), bottom, -1):
            nodes, survivors = survivors, {}
            for chain, path, state, ends in levels.pop(depth, ()):
                has = nodes.get(chain[depth - bottom])
                if has is None:
                    nodes[chain[depth - bottom]] = [chain, path, state, ends]
                    continue
                has[2] = [min(has[2][0], state[0]), *(a + b for a, b in zip(has[2][1:], state[1:]))]
                has[3] = has[3] or ends
            for name, (chain, path, (conv, n, children, leaves, saved), ends) in nodes.items():
                leaves = leaves if children else 1
                saved += (n - 1) * int.from_bytes(path[_TURN * depth - 4:_TURN * depth], "big")
                above = chain[depth - 1 - bottom]
                out.append((depth, path[:_TURN * depth] if depth == bottom + 1 else None, name, above, conv, n, children, leaves, saved, ends))
                has = survivors.get(above)
                if has is None:
                    survivors[above] = [chain, path, [conv, n, 1, leaves, saved], None]
                else:
                    has[2] = [min(has[2][0], conv), has[2][1] + n, has[2][2] + 1, has[2][3] + leaves, has[2][4] + saved]
        kinds = (pa.int32(), pa.binary(), pa.string(), pa.string(), *[pa.int64()] * 5, pa.string())
        return pa.table([pa.array(c, k) for c, k in zip(map(list, zip(*out)), kinds)],
                        names=[f.strip().split(" ")[0] for f in _NODE.split(",")])

    return items.groupBy("home").applyInArrow(peel, _NODE)


def prefix_trie(paths: DataFrame, group: int = 100_000) -> DataFrame:
    """One row for each distinct prefix (node) of the conversations (conv_id, path), the root with no turn included.

    Columns: conv_id (smallest member; members are the conversations that start with the prefix),
    depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens (code
    points that sharing the turns of the subtree saves), ends_sha256 (SHA-256 of the ids that end
    here, ascending, joined by commas), and the names ``node`` and ``parent``. A table without
    conversations has no node.

    Peeling starts at the greatest depth: conversations that end there and survivors from below are
    grouped by path, each group is a node, and nodes without their last turn survive to the depth
    above, where they are grouped again with what ends there. State is summed before each shuffle, so
    a prefix that most conversations share costs a row a task. Depths above 8 are taken in a few
    steps (to 8, 32, 128, ...): items with one prefix of that depth are peeled in one task if they
    have at most ``group`` turns below it or there is one only; the others go depth by depth, as the
    topmost depths do. Any input is peeled whole.
    """
    ended = cut(merge_copies(paths))
    deepest = ended.agg(F.max("depth")).first()[0]
    if deepest is None:
        return _with_parents(ended.select(*[F.lit(None).cast(f.split(" ")[-1]).alias(f.strip().split(" ")[0])
                                            for f in _NODE.split(",")]).limit(0))
    bottoms = [0]
    while max(8, bottoms[0] * 4) < deepest:
        bottoms.insert(0, max(8, bottoms[0] * 4))
    done, waiting, top = [], ended, deepest
    for bottom in bottoms:
        deep = waiting.filter(F.col("depth") > bottom).withColumn("home", F.md5(_upto("path", bottom)))
        size = deep.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("depth") - bottom).alias("turns"))
        hot = cut(size.filter((F.col("n") > 1) & (F.col("turns") > group)).select("home"))
        many = hot.count()
        side = F.broadcast(hot) if many <= 10_000 else hot
        kept = [waiting.filter(F.col("depth") <= bottom)]
        if not (many and bottom == 0):
            nodes = cut(_peel_homes(deep.join(side, "home", "left_anti"), bottom))
            done.append(nodes)
            kept.append(_strip(nodes.filter(F.col("depth") == bottom + 1)))
        if many:
            large = cut(deep.join(side, "home", "left_semi").drop("home")) if bottom else deep.drop("home")
            above = None
            for depth in range(top, bottom, -1):
                now = large.filter(F.col("depth") == depth)
                nodes = cut(_regroup(now if above is None else now.unionByName(above)))
                done.append(nodes)
                above = _strip(nodes)
            kept.append(above)
        waiting, top = kept[0], bottom
        for more in kept[1:]:
            waiting = waiting.unionByName(more)
    done.append(_regroup(waiting))
    nodes = done[0]
    for more in done[1:]:
        nodes = nodes.unionByName(more)
    return _with_parents(cut(nodes.drop("path")))


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with their parent's conv_id; at most 1,000 parents, those with the most children, are broadcast."""
    least = max(1, nodes.count() // 1000)
    parents = nodes.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    many = F.broadcast(parents.filter(F.col("n_children") > least).drop("n_children"))
    few = parents.filter(F.col("n_children") <= least).drop("n_children")
    joined = nodes.join(many, "parent").unionByName(nodes.join(many, "parent", "left_anti").join(few, "parent", "left"))
    return joined.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
                         F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
                         "node", "parent")
