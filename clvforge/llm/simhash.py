"""SimHash near-dedup: byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clvforge.llm.common import cut, id_and_text
from clvforge.llm.components import connected_components

#: The 14 four-byte position sets of the Steiner system S(3,4,8). Any five of the eight
#: byte positions contain at least one of them.
POSITION_SETS = [(0, 1, 2, 3), (4, 5, 6, 7), (0, 1, 4, 5), (0, 1, 6, 7), (2, 3, 4, 5), (2, 3, 6, 7), (0, 2, 4, 6),
                 (0, 2, 5, 7), (1, 3, 4, 6), (1, 3, 5, 7), (0, 3, 4, 7), (0, 3, 5, 6), (1, 2, 4, 7), (1, 2, 5, 6)]


def simhash(text: str, words: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint: a bit is set where over half of the shingles' XXH64 have it."""
    from xxhash import xxh64_intdigest
    tokens = text.encode().translate(_LOWER).split()
    if not tokens:
        return 0
    shingles = list(map(b" ".join, zip(*[tokens[i:] for i in range(words)]))) or [b" ".join(tokens)]
    n, ones = len(shingles), np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        hashes = np.fromiter((xxh64_intdigest(s, seed) for s in shingles[lo:lo + (1 << 16)]), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


#: bytes.lower() by name: only A-Z change.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer, computed where the text lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _linked(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that share enough positional bytes (count filter) and differ in few enough bits (verified)."""
    x = a[:, None] ^ b[None, :]
    tally = np.zeros(x.shape, np.uint8)
    for k in range(8):
        tally += (x >> np.uint64(8 * k)) & np.uint64(255) == 0
    i, j = np.nonzero(tally >= 8 - most)
    ok = np.bitwise_count(x[i, j]) <= most
    return i[ok], j[ok]


def _spanning(a: np.ndarray, b: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the postings of two blocks, or inside one (a is b)."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := parent.setdefault(v, v)) != v:
            parent[v] = up = parent[up]
            v = up
        return v

    out = []
    for lo in range(0, len(a), 256):
        for at in range(0, len(b), 4096):
            i, j = _linked(a[lo:lo + 256], b[at:at + 4096], most)
            for u, v in zip(a[lo + i].tolist(), b[at + j].tolist()):
                ru, rv = root(u), root(v)
                if ru != rv:
                    parent[ru] = rv
                    out.append((u, v))
    return out


def simhash_links(distinct: DataFrame, most: int = 3, block: int = 2048) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect all within ``most`` differing bits.

    With at most three differing bits, at least five of the eight positional bytes match. Lists for
    single positional bytes would each hold a 256th of all fingerprints, so the index intersects
    them by fours: postings are keyed by a position set and its four bytes, and any five matching
    positions contain one of the 14 sets. Within a posting list the shared positional bytes of each
    pair are tallied, pairs with fewer than five go, and the rest are verified by bit count. A list
    returns a spanning forest of its links, not all its pairs. Lists longer than ``block`` are dealt
    out as pairs of blocks, so that no task holds a whole list.
    """
    if not 0 <= most <= 3:
        raise ValueError("the position sets guarantee a match for at most three differing bits")
    byte = [F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(255)) for k in range(8)]

    def key(n: int, places: tuple[int, ...]) -> F.Column:
        value = F.lit(n).cast("long")
        for p in places:
            value = F.shiftleft(value, 8).bitwiseOR(byte[p])
        return value

    postings = distinct.select("fp", F.explode(F.array(*[key(n, s) for n, s in enumerate(POSITION_SETS)])).alias("key"))
    lists = cut(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                .withColumn("blocks", F.ceil(F.col("n") / block)))
    found = postings.join(lists, "key").select("key", "fp", "blocks", F.pmod(F.xxhash64("fp"), "blocks").alias("own"))
    dealt = found.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    grouped = dealt.groupBy("key", "i", "j").agg(
        F.sort_array(F.collect_list(F.when(F.col("own") == F.col("i"), F.col("fp")))).alias("left"),
        F.sort_array(F.collect_list(F.when(F.col("own") != F.col("i"), F.col("fp")))).alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = []
            for i, j, left, right in zip(*[batch.column(k).to_pylist() for k in range(1, 5)]):
                a = np.array(left, np.int64).view(np.uint64)
                edges += _spanning(a, a if i == j else np.array(right, np.int64).view(np.uint64), most)
            ab = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

    return grouped.mapInArrow(run, "a long, b long").distinct()


def simhash_dedup(docs: DataFrame, words: int = 3, most: int = 3, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row per document.

    Texts lower-case A-Z, words split at ASCII white space, shingles of ``words`` words with
    repeats. Documents whose fingerprints differ in at most ``most`` bits are linked; component_id
    is the smallest doc_id reachable. Equal fingerprints are one node, so copies cost nothing. Null
    and empty texts have fingerprint zero and link like any other; shorter texts than a shingle are
    one shingle. Rows without an id get a null component unless others share their fingerprint's
    component. Repeated rows give a row each; an empty table gives none.
    """
    fps = cut(fingerprints(docs, words, id_col, text_col))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    edges = cut(simhash_links(classes.select("fp"), most))
    parts = connected_components(edges)
    firsts = parts.join(classes.withColumnRenamed("fp", "node"), "node")
    smallest = firsts.groupBy("component").agg(F.min("first").alias("smallest"))
    named = cut(firsts.join(smallest, "component").select(F.col("node").alias("fp"), "smallest"))
    final = classes.join(named, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("component_id"))
    return fps.join(final, "fp").select("doc_id", "fp", "component_id")


def first_documents(docs: DataFrame, words: int = 3, most: int = 3) -> DataFrame:
    """One document of each component, the one with the smallest id, with the columns of ``docs``."""
    stay = (simhash_dedup(docs, words, most).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.col("doc_id").alias("_stay")).distinct())
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("_stay")), "left_semi")


def hex_fingerprint(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
