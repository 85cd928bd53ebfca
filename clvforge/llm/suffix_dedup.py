"""Removal of repeated byte strings by a distributed difference-cover algorithm.

A string of ``length`` bytes counts as repeated when it also starts anywhere else. Two positions
always have a common offset below the period at which both are in the difference cover's sample, so
only sampled positions are named, sorted and compared:

1. Sampled tuples get names (fingerprints of the tuple's bytes); sorting the names puts equal tuples
   side by side, and tuples that occur once drop out.
2. The recursion works on the names that are left, each with the name of its whole surroundings, as
   far as any string through the tuple reaches. It is one level deep: surroundings that occur twice
   settle all strings through the tuple.
3. The positions between samples are merged in where the surroundings of equal tuples differ: their
   strings are named, sorted and compared with their neighbours.

Text is shuffled once by chunk and the exchange is reused by all steps; chunks send sorted, distinct
names, packed, and get bits back, so a string that a third of all documents share is one name a chunk.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clvforge.llm.common import id_and_text, shuffle_partitions

#: A perfect difference set modulo 133; each residue other than 0 is one difference of two of them.
COVER = (1, 2, 4, 13, 21, 35, 39, 82, 89, 95, 105, 110)
PERIOD = 133
_BLOCK = 1 << 20
#: Text of a chunk, and for each bucket of names.
_CHUNK = 8 << 20


@functools.lru_cache(maxsize=1)
def _hash_tables(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two rows of random codes of the bytes, and powers of an odd base and of its inverse modulo 2**64."""
    code = np.random.default_rng(20).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
    base, n = 0xD6E8FEB86659FD93, _BLOCK + 4 * length
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return code, np.multiply.accumulate(up), np.multiply.accumulate(down)


def span_names(data: np.ndarray, start: np.ndarray, end: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """64-bit names of data[start:end], ``which`` choosing one of two; starts ascend, no span is longer than twice ``length``."""
    codes, up, down = _hash_tables(length)
    code = codes[which]
    out = np.empty(len(start), np.uint64)
    for lo in range(0, len(data), _BLOCK):
        a, b = np.searchsorted(start, [lo, lo + _BLOCK])
        if a == b:
            continue
        piece = data[lo:lo + _BLOCK + 2 * length]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(code[piece] * up[:len(piece)], out=total[1:])
        s, e = start[a:b] - lo, end[a:b] - lo
        out[a:b] = (total[e] - total[s]) * down[s]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


class _Chunk:
    """The documents of a chunk, laid end to end, and what each step finds in them."""

    def __init__(self, texts: pa.ChunkedArray, length: int, buckets: int):
        self.texts = [t.as_py() or b"" for t in texts]
        self.length, self.buckets, self.width = length, buckets, length - PERIOD + 1
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.at = np.cumsum(self.size) - self.size
        most = int(self.size.max(initial=0))
        pattern = np.flatnonzero(np.isin(np.arange(most) % PERIOD, COVER))
        n = np.where(self.size >= length, np.searchsorted(pattern, self.size - self.width, "right"), 0)
        self.doc = np.repeat(np.arange(len(n)), n)
        self.local = pattern[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] if n.sum() else np.zeros(0, np.int64)
        self.start = self.at[self.doc] + self.local
        self.name = span_names(self.data, self.start, self.start + self.width, length)

    def tuples(self) -> _Sent:
        return _Sent(self.name, self.buckets, 5)

    def keep(self, repeated: np.ndarray) -> None:
        """Only samples whose tuple is repeated go on, with the names of their surroundings."""
        self.doc, self.local, self.start, self.name = (x[repeated] for x in (self.doc, self.local, self.start, self.name))
        self.low = np.maximum(self.local - (PERIOD - 1), 0) + self.at[self.doc]
        self.high = np.minimum(self.local + self.length, self.size[self.doc]) + self.at[self.doc]
        around = span_names(self.data, self.low, self.high, self.length)
        place = (self.start - self.low).astype(np.uint64) << np.uint64(32) | (self.high - self.start).astype(np.uint64)
        place = (place + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        self.around = around ^ place ^ (place >> np.uint64(31))

    def surroundings(self) -> _Sent:
        return _Sent(self.name, self.buckets, 5, self.around)

    def strings(self, open_: np.ndarray) -> tuple[np.ndarray, _Sent]:
        """Starts of all strings through open samples, and their names: 32 bits of the first, all of the second."""
        grow = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(grow, self.low[open_], 1)
        np.add.at(grow, np.maximum(self.high[open_] - self.length, self.low[open_] - 1) + 1, -1)
        start = np.flatnonzero(np.cumsum(grow[:-1]) > 0)
        one, two = (span_names(self.data, start, start + self.length, self.length, which) for which in (0, 1))
        return start, _Sent(one, self.buckets, 4, two)

    def covered(self, full: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which bytes lie in repeated strings."""
        grow = np.zeros(len(self.data) + 1, np.int32)
        for lo, hi in ((self.low[full], self.high[full]), (start, start + self.length)):
            np.add.at(grow, lo, 1)
            np.add.at(grow, hi, -1)
        return np.cumsum(grow[:-1]) > 0


class _Sent:
    """Distinct names in the order in which they are sent, by bucket; ``back`` reads the bits of the answer."""

    def __init__(self, name: np.ndarray, buckets: int, width: int, second: np.ndarray | None = None):
        bucket = (name >> np.uint64(40)) % np.uint64(buckets)
        keys = [name, bucket] if second is None else [second, name, bucket]
        order = np.lexsort(keys)
        n = len(name)
        new = np.ones(n, bool)
        if n:
            new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        self.group = np.empty(n, np.int64)
        self.group[order] = np.cumsum(new) - 1
        first = order[new]
        self.many = np.bincount(self.group, minlength=len(first)) > 1 if n else np.zeros(0, bool)
        self.name, self.bucket, self.width = name[first], bucket[first].astype(np.int64), width
        self.second = None if second is None else second[first]
        self.cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1)) if n else np.zeros(0, np.int64)

    def rows(self, chunk: int) -> dict[str, list]:
        out: dict[str, list] = {"bucket": [], "chunk": [], "names": [], "many": [], "second": []}
        raw = self.name.view(np.uint8).reshape(-1, 8)[:, :self.width]
        for a, b in zip(self.cuts, [*self.cuts[1:], len(self.name)]):
            out["bucket"].append(int(self.bucket[a]))
            out["chunk"].append(chunk)
            out["names"].append(raw[a:b].tobytes())
            out["many"].append(np.packbits(self.many[a:b]).tobytes())
            out["second"].append(b"" if self.second is None else self.second[a:b].tobytes())
        return out

    def back(self, answers: dict[int, tuple[bytes, bytes]], which: int) -> np.ndarray:
        """The answer's bits, one for each name given to the constructor."""
        bits = np.zeros(len(self.name), bool)
        for a, b in zip(self.cuts, [*self.cuts[1:], len(self.name)]):
            got = answers[int(self.bucket[a])][which]
            bits[a:b] = np.unpackbits(np.frombuffer(got, np.uint8), count=b - a).astype(bool)
        return bits[self.group]


_SENT = "bucket int, chunk int, names binary, many binary, second binary"
_ANSWER = "step int, bucket int, chunk int, bits binary, more binary"


def _answer(step: int, width: int):
    """Reducer of one bucket: sorts the names of all chunks and tells which occur elsewhere too."""

    def run(rows: pa.Table) -> pa.Table:
        blobs = rows.column("names").to_pylist()
        sizes = [len(b) // width for b in blobs]
        raw = np.zeros((sum(sizes), 8), np.uint8)
        raw[:, :width] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)
        name = raw.view(np.uint64).ravel()
        many = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in
                               zip(rows.column("many").to_pylist(), sizes)]).astype(np.int64)
        second = np.frombuffer(b"".join(rows.column("second").to_pylist()), np.uint64)
        keys = [second, name] if len(second) else [name]
        order = np.lexsort(keys)
        new = np.ones(len(name), bool)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        group = np.cumsum(new) - 1
        twice = (np.bincount(group, 1 + many[order]) > 1)[group]
        bits, more = np.empty(len(name), bool), np.zeros(len(name), bool)
        bits[order] = twice
        if len(second):  # open: names with surroundings that occur once
            new[1:] = name[order][1:] != name[order][:-1]
            group = np.cumsum(new) - 1
            more[order] = (np.bincount(group, ~twice) > 0)[group]
        ends = np.cumsum(sizes)
        pack = lambda x: [np.packbits(x[e - n:e]).tobytes() for e, n in zip(ends, sizes)]
        return pa.table({"step": pa.array([step] * len(sizes), pa.int32()), "bucket": rows.column("bucket"),
                         "chunk": rows.column("chunk"), "bits": pa.array(pack(bits), pa.binary()),
                         "more": pa.array(pack(more), pa.binary())})

    return run


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text",
                   chunk_bytes: int = _CHUNK, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, spans, kept]) for each document.

    Removes each byte covered by a string of ``length`` bytes that also starts anywhere else, in the
    same document too; strings are judged on the input and never cross documents. ``spans`` are the
    removed runs as (start, end) pairs of byte offsets, ``kept`` the remaining bytes. Null text is
    empty; texts shorter than ``length`` keep all bytes; copies (repeated rows too) lose all. An
    empty table gives no rows. What counts as repeated is decided by fingerprints of whole strings: 96
    bits for strings, 104 for surroundings, and the bucket's number besides.

    Chunks of texts and buckets of names are numbered by the volume of text (``chunk_bytes`` each), so
    a task's memory does not grow with it; a text longer than that is a chunk of its own size.
    """
    if length < 2 * PERIOD:
        raise ValueError(f"the cover needs strings of {2 * PERIOD} bytes or more")
    base = id_and_text(docs, id_col, text_col)
    volume = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-volume // chunk_bytes))  # a chunk sends at most a row to each, and at most a row a name
    parts = max(shuffle_partitions(docs.sparkSession), buckets)
    dealt = (base.select("doc_id", F.col("text").cast("binary").alias("text"),
                         F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(2 * buckets, 2))).cast("int").alias("chunk"))
             .repartition(parts, "chunk"))

    def read(rows: pa.Table, answers: pa.Table | None, steps: int):
        chunk = _Chunk(rows.column("text"), length, buckets)
        got: dict[int, dict[int, tuple[bytes, bytes]]] = {1: {}, 2: {}, 3: {}}
        if answers is not None:
            for s, b, bits, more in zip(*(answers.column(c).to_pylist() for c in ("step", "bucket", "bits", "more"))):
                got[s][b] = (bits, more)
        if steps == 0:
            return chunk, chunk.tuples()
        chunk.keep(chunk.tuples().back(got[1], 0))
        sent = chunk.surroundings()
        if steps == 1:
            return chunk, sent
        start, strings = chunk.strings(sent.back(got[2], 1))
        if steps == 2:
            return chunk, strings
        return chunk, chunk.covered(sent.back(got[2], 0), start[strings.back(got[3], 0)])

    def send(rows: pa.Table, answers: pa.Table | None, steps: int) -> pa.Table:
        number = rows.column("chunk")[0].as_py() if rows.num_rows else 0
        out = read(rows, answers, steps)[1].rows(number) if rows.num_rows else _Sent(np.zeros(0, np.uint64), 1, 5).rows(0)
        return pa.table({k: pa.array(v, pa.int32() if k in ("bucket", "chunk") else pa.binary()) for k, v in out.items()})

    def first_names(rows: pa.Table) -> pa.Table:
        return send(rows, None, 0)

    def sender(steps: int):
        return lambda rows, answers: send(rows, answers, steps)

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        chunk, gone = read(rows, answers, 3)
        out: list[list] = [[] for _ in range(6)]
        for text, at, n in zip(chunk.texts, chunk.at.tolist(), chunk.size.tolist()):
            cut = gone[at:at + n]
            edge = np.flatnonzero(np.diff(cut.astype(np.int8), prepend=0, append=0))
            kept = chunk.data[at:at + n][~cut].tobytes() if len(edge) else text
            row = (n, int(cut.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), edge.tolist(), kept)
            for col, v in zip(out, row if keep_text else row[:4]):
                col.append(v)
        cols = {"doc_id": rows.column("doc_id")}
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()]
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][:6 if keep_text else 4]
        return pa.table(cols | {k: pa.array(v, kind) for k, v, kind in zip(names, out, kinds)})

    by_chunk = dealt.groupBy("chunk")
    first = by_chunk.applyInArrow(first_names, _SENT)
    told = first.groupBy("bucket").applyInArrow(_answer(1, 5), _ANSWER).repartition(parts, "chunk")
    for steps, width in ((1, 5), (2, 4)):
        sent = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(sender(steps), _SENT)
        answer = sent.groupBy("bucket").applyInArrow(_answer(steps + 1, width), _ANSWER).repartition(parts, "chunk")
        told = told.union(answer)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(
        finish, schema + (", spans array<long>, kept binary" if keep_text else ""))
