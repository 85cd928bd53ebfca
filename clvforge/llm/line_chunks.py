"""Line dedup by content-defined chunks of lines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clvforge.llm.common import cut, id_and_text

_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def content_cuts(h: np.ndarray, mean: int) -> np.ndarray:
    """Whether a chunk may end after each line: where the rolling hash of its and the line before's hash is a multiple of ``mean``."""
    rolling = h * np.uint64(_MIX[0])
    rolling[1:] += h[:-1] * np.uint64(_MIX[1])
    rolling ^= rolling >> np.uint64(33)
    return (rolling * np.uint64(_MIX[2]) >> np.uint64(40)) % np.uint64(mean) == 0


def line_chunks(h: np.ndarray, shared: np.ndarray, least: int = 2, mean: int = 4) -> list[tuple[int, int]]:
    """(first line, line after the last) of the chunks of a text with line hashes ``h``.

    ``shared`` tells of each line but the last whether it and the next one stand together elsewhere
    too; a chunk ends where they do not. So a passage that several texts share is cut at its edges,
    whatever stands around it. Within such a run of lines, chunks also end by their content, so that
    runs which overlap in part have chunks in common, with ``least`` lines on either side at the least.
    """
    if not len(h):
        return []
    content = content_cuts(h, mean)
    out, a = [], 0
    edges = [*(np.flatnonzero(~shared[:len(h) - 1]) + 1).tolist(), len(h)]
    for b in edges:
        for at in (np.flatnonzero(content[a:b]) + a + 1).tolist():
            if at - a >= least and b - at >= least:
                out.append((a, at))
                a = at
        out.append((a, b))
        a = b
    return out


def _line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, print, lines, blank): a text's lines as 16-byte digests laid end to end, and which are blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                digests, blanks = [], []
                for text in part.column(2).cast(pa.binary()):
                    lines = text.as_py().split(b"\n")
                    digests.append(b"".join(map(xxh3_128_digest, lines)))
                    blanks.append(np.packbits([not x.strip() for x in lines]).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digests, pa.binary()), pa.array(blanks, pa.binary())],
                                                 names=["doc_id", "print", "lines", "blank"])

    return docs.mapInArrow(run, "doc_id long, print long, lines binary, blank binary")


def _pair_rows(lines: DataFrame) -> DataFrame:
    """A row for each two lines that follow one another: (doc_id, print, place, name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out: list[list] = [[] for _ in range(4)]
                for doc, mark, digests in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns[:3])):
                    n = len(digests) // 16 - 1
                    out[0] += [doc] * n
                    out[1] += [mark] * n
                    out[2] += range(n)
                    out[3] += [xxh3_128_digest(digests[16 * k:16 * k + 32]) for k in range(n)]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "print", "place", "name"])

    return lines.mapInArrow(run, "doc_id long, print long, place int, name binary")


def _chunk_rows(shared: DataFrame, least: int, mean: int) -> DataFrame:
    """A row for each chunk of ``least`` lines or more that are not all blank: (doc_id, print, place, size, name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out: list[list] = [[] for _ in range(5)]
                for doc, mark, digests, blank, places in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns)):
                    for a, b in _chunks(digests, places, least, mean):
                        empty = np.unpackbits(np.frombuffer(blank, np.uint8))[a:b]
                        if b - a >= least and not empty.all():
                            name = xxh3_128_digest(digests[16 * a:16 * b]) + (b - a).to_bytes(8, "little")
                            for col, v in zip(out, (doc, mark, a, b - a, name)):
                                col.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                                 names=["doc_id", "print", "place", "size", "name"])

    return shared.mapInArrow(run, "doc_id long, print long, place int, size int, name binary")


def _chunks(digests: bytes, places: list[int], least: int, mean: int) -> list[tuple[int, int]]:
    h = np.frombuffer(digests, np.uint64)[::2]
    together = np.zeros(len(h), bool)
    together[places] = True
    return line_chunks(h, together, least, mean)


def _clashing(joined: DataFrame) -> DataFrame:
    """Names of chunks that are not equal byte for byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out: list[list] = [[], []]
                for text, runs in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns)):
                    lines = text.encode().split(b"\n")
                    for r in runs:
                        out[0].append(r["name"])
                        out[1].append(b"\n".join(lines[r["place"]:r["place"] + r["size"]]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in out], names=["name", "body"])

    bodies = joined.filter("runs IS NOT NULL").select("text", "runs").mapInArrow(run, "name binary, body binary")
    return bodies.distinct().groupBy("name").count().filter("count > 1").select("name")


def drop_repeated_chunks(docs: DataFrame, least: int = 2, mean: int = 4, id_col: str = "doc_id", text_col: str = "text",
                         keep_text: bool = True) -> DataFrame:
    """(doc_id, n_lines, removed_chunks, removed_lines, kept_sha256[, text]) for each document.

    Texts are cut into chunks of lines (``line_chunks``): where two lines that follow one another do so
    in no other place of the corpus, and by their content. A chunk of at least ``least`` lines that are
    not all blank and that stands in several places is removed from all but the first one (smallest
    doc_id, null last, then smallest line). Chunks are named by their lines' digests; what is removed is
    compared byte for byte first, and a name with two bodies is no repeat. Lines alone stay. Null text is
    empty, which is one line; rows with the same id and text are one document and have the same result; a
    very long text is one value in its task. An empty table gives no rows.

    Only digests are shuffled until the last join brings the runs to the texts.
    """
    base = id_and_text(docs, id_col, text_col).withColumn("print", F.xxhash64("text")).select("doc_id", "print", "text")
    where = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print", "place")
    same = F.expr("d.doc_id <=> g.doc_id AND d.print = g.print")

    def repeated(rows: DataFrame) -> DataFrame:
        """(name, first place) of what stands in several places."""
        return rows.groupBy("name").agg(F.min(where).alias("first"), F.max(where).alias("last")).filter(
            ~F.col("first").eqNullSafe(F.col("last"))).select("name", "first")

    lines = cut(_line_rows(base))
    together = _pair_rows(lines).join(cut(repeated(_pair_rows(lines)).select("name")), "name", "left_semi")
    places = together.groupBy("doc_id", "print").agg(F.collect_set("place").alias("places"))
    chunks = cut(_chunk_rows(lines.alias("d").join(places.alias("g"), same).select(
        "d.doc_id", "d.print", "lines", "blank", "places"), least, mean))
    found = chunks.join(cut(repeated(chunks)), "name").withColumn("later", ~where.eqNullSafe(F.col("first")))

    def with_runs(found: DataFrame) -> DataFrame:
        runs = found.groupBy("doc_id", "print").agg(F.collect_set(F.struct("place", "size", "name", "later")).alias("runs"))
        return base.alias("d").join(runs.alias("g"), same, "left").select("d.doc_id", "d.print", "text", "runs")

    joined = cut(with_runs(found))
    clashing = cut(_clashing(joined))
    if not clashing.isEmpty():
        joined = with_runs(found.join(clashing, "name", "left_anti"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out: list[list] = [[] for _ in range(5)]
                for text, runs in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    raw = text.encode()
                    lines = raw.split(b"\n")
                    gone = np.zeros(len(lines), bool)
                    for r in runs or ():
                        gone[r["place"]:r["place"] + r["size"]] = True
                    kept = b"\n".join(x for x, g in zip(lines, gone) if not g) if gone.any() else raw
                    row = (len(lines), len(runs or ()), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept)
                    for col, v in zip(out, row):
                        col.append(v)
                kinds = [pa.int32()] * 3 + [pa.string(), pa.binary()]
                arrays = [part.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))]
                if keep_text:
                    arrays[-1] = arrays[-1].cast(pa.string())
                names = ["doc_id", "n_lines", "removed_chunks", "removed_lines", "kept_sha256", "text"]
                n = 6 if keep_text else 5
                yield pa.RecordBatch.from_arrays(arrays[:n], names=names[:n])

    schema = "doc_id long, n_lines int, removed_chunks int, removed_lines int, kept_sha256 string"
    return joined.select("doc_id", "text", F.filter("runs", lambda r: r["later"]).alias("runs")).mapInArrow(
        run, schema + (", text string" if keep_text else ""))
