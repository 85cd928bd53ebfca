"""Quality classifier: naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clvforge.llm.common import cut, id_and_text
from clvforge.llm.words import KeyLookup, Part, in_pieces, utf8

_PIECE = 1 << 18
_ODD = 0x9E3779B97F4A7C15


def _make_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0xD6E8FEB86659FD93
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@functools.lru_cache(maxsize=1)
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _make_powers(2 * _PIECE)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64; those for a run longer than a piece are not kept."""
    return _usual_powers() if n <= 2 * _PIECE else _make_powers(n)


@functools.lru_cache(maxsize=1)
def _byte_tables() -> dict[str, np.ndarray]:
    b = np.arange(256)
    space = np.isin(b, [32, 9, 10, 11, 12, 13])
    upper, lower, digit = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57)
    return {"space": space, "upper": upper, "digit": digit, "wide": b >= 128,
            "mark": ~(space | upper | lower | digit | (b >= 128)) & (b > 32),
            "code": (b.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD)}


def _key(x: np.ndarray, kind: int) -> np.ndarray:
    """A 64-bit key whose last two bits are the kind of n-gram."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_ODD)
    return (x ^ (x >> np.uint64(29))) & ~np.uint64(3) | np.uint64(kind)


def _grams(parts: list[Part]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, key) of word 1-grams, word 2-grams and 3-grams of word shapes, repeats included.

    Parts of one text overlap by three words; n-grams that lean on words beyond a part are left to its neighbour.
    """
    t = _byte_tables()
    data = np.frombuffer(b"\n".join(p.text for p in parts) + b"\n", np.uint8)
    ends_of_parts = np.cumsum([len(p.text) + 1 for p in parts])
    space = t["space"][data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return
    up, down = _powers(len(data))
    total = np.concatenate(([np.uint64(0)], np.cumsum(t["code"][data] * up[:len(data)])))
    word = (total[end] - total[start]) * down[start]
    del total
    last = np.searchsorted(start, ends_of_parts)  # the first word after each part
    part = np.repeat(np.arange(len(parts)), np.diff(last, prepend=0))
    doc = np.array([p.doc for p in parts])[part]
    count = {}
    for kind in ("upper", "digit", "wide", "mark"):
        c = np.concatenate(([0], np.cumsum(t[kind][data], dtype=np.int32)))
        count[kind] = c[end] - c[start]
    size = end - start
    again = np.concatenate(([False], (word[1:] == word[:-1]) & (part[1:] == part[:-1])))
    shape = np.minimum(count["mark"], 3) | (count["upper"] == size - count["mark"]) * 4 | (
        count["upper"] > 0) * 8 | (count["digit"] > 0) * 16 | (count["wide"] > 0) * 32 | (
        ((size > 2) + (size > 6).astype(np.int64) + (size > 12)) * 64) | again * 256
    yield doc, _key(word, 0)
    two = part[1:] == part[:-1]
    pair = word[:-1] * np.uint64(0xA24BAED4963EE407) + word[1:]
    yield doc[1:][two], _key(pair[two], 1)
    shape = np.concatenate((shape, [511, 511])).astype(np.uint64)  # past the end of a text
    near = np.concatenate((part, [-1, -1]))
    after = [np.where(near[k:len(part) + k] == part, shape[k:len(part) + k], np.uint64(511)) for k in (1, 2)]
    triple = (shape[:-2] << np.uint64(18)) | (after[0] << np.uint64(9)) | after[1]
    whole = np.ones(len(part), bool)
    for p, (lo, hi) in enumerate(zip([0, *last.tolist()], last.tolist())):
        if parts[p].more_before:
            whole[lo:min(lo + 1, hi)] = False
        if parts[p].more_after:
            whole[max(lo, hi - 2):hi] = False
    yield doc[whole], _key(triple[whole] + np.uint64(1), 2)


def features(texts: list[bytes], known: KeyLookup) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of each known n-gram that a text holds, once a text, sorted; the constant has the last place."""
    n = len(known) + 1
    found = [np.arange(len(texts), dtype=np.int64) * n + n - 1]
    for parts in in_pieces(texts, _PIECE, 3):
        for doc, key in _grams(parts):
            place = known.find(key)
            has = place >= 0
            found.append(np.unique(doc[has] * n + place[has]))
    both = np.unique(np.concatenate(found))
    return both // n, both % n


def gram_counts(rows: DataFrame) -> DataFrame:
    """(key, n): how many texts hold each n-gram, summed in the task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)

        for batch in batches:
            for text in utf8(batch.column(0)):
                own = np.unique(np.concatenate([np.zeros(0, np.uint64), *(k for p in in_pieces([text], _PIECE, 3) for _, k in _grams(p))]))
                keys.append(own)
                counts.append(np.ones(len(own)))
                held += len(own)
                if held > 2_000_000:
                    key, n = summed()
                    if len(key) > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])
                        key, n = key[:0], n[:0]
                    keys, counts, held = [key], [n], len(key)
        if keys:
            key, n = summed()
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    return rows.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def class_counts(rows: DataFrame, shared) -> tuple[np.ndarray, np.ndarray]:
    """How many texts of label 1 and of label 0 hold each known n-gram; rows: text, label. Summed in Spark."""
    size = len(shared.value) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, size), np.int64)
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            doc, place = features(utf8(batch.column(0)), shared.value)
            n += np.bincount(label[doc] * size + place, minlength=2 * size).reshape(2, size)
        has = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(n[1, has]), pa.array(n[0, has])],
                                         names=["feature", "ones", "zeros"])

    counted = rows.select("text", "label").mapInArrow(run, "feature long, ones long, zeros long")
    got = counted.groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).toArrow()
    out = np.zeros((2, size))
    at = got["feature"].to_numpy()
    out[0, at], out[1, at] = got["ones"].to_numpy(), got["zeros"].to_numpy()
    return out[0], out[1]


def log_count_ratio(ones: np.ndarray, zeros: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log of the smoothed, normalised counts' ratio; the constant feature keeps 1."""
    p, q = smooth + ones, smooth + zeros
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    r[-1] = 1.0
    return r


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = 1.0, epochs: int = 12,
                 seed: int = 7) -> np.ndarray:
    """Linear hinge-loss weights by dual coordinate descent; classes weigh alike."""
    size = 1 + max((int(f.max()) for f, _ in rows if len(f)), default=0)
    w, alpha = np.zeros(size), np.zeros(len(y))
    weight = np.where(y > 0, 0.5 / max(1e-9, np.mean(y > 0)), 0.5 / max(1e-9, np.mean(y < 0)))
    upper, norm = cost * weight, np.array([v @ v for _, v in rows])
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in draw.permutation(len(y)):
            f, v = rows[i]
            g = y[i] * (w[f] @ v) - 1.0
            new = min(max(alpha[i] - g / norm[i], 0.0), upper[i])
            if new != alpha[i]:
                most = max(most, abs(new - alpha[i]) / upper[i])
                w[f] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
        if most < 1e-3:
            break
    return w


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the label's probability in the margin, by Newton steps with Platt's targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        hess = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (p - target))
        ab = ab - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return max(float(ab[0]), 1e-6), float(ab[1])


class Model:
    """Known n-grams, their weights (the constant's last), slope and offset of the probability."""

    def __init__(self, known: KeyLookup, weights: np.ndarray, slope: float, offset: float):
        self.known, self.weights, self.slope, self.offset = known, weights, slope, offset


def fit(labelled: DataFrame, max_rows: int = 16_000, cost: float = 1.0, least: int = 3, max_grams: int = 1 << 20) -> Model:
    """A model from rows (doc_id, text, label).

    Support vectors are fitted in one task on about ``max_rows`` rows, drawn by a hash of the id; a
    fifth of these sets the slope and offset of the probability. The n-grams that can have a weight
    are those that ``least`` texts of the sample hold (one or two texts' n-grams tell of those texts
    only), the ``max_grams`` most frequent if there are more; each is known by its own 64-bit key, and
    the class counts behind its log-count ratio cover all labelled rows. With one class only, the
    score is constant.
    """
    context = labelled.sparkSession.sparkContext
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(KeyLookup(np.zeros(0, np.uint64)), np.zeros(1, np.float32), 1e-6, 0.0 if n1 == n0 else (4.0 if n1 else -4.0))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("draw")), F.lit(1_000_000))
    sample = labelled.filter(draw < int(1_000_000 * min(1.0, max_rows / (n1 + n0))))
    keys = gram_counts(sample).filter(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(max_grams).toArrow()["key"]
    known = KeyLookup(keys.to_numpy().astype(np.int64).view(np.uint64))
    table = context.broadcast(known)
    ratio = log_count_ratio(*class_counts(labelled, table))
    shared = context.broadcast(ratio.astype(np.float32))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, place = features(utf8(batch.column(1)), table.value)
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            out = [place[a:b].astype(np.int32).tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())],
                                             names=["doc_id", "label", "features"])

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "label"])
        y = np.where(pdf["label"].to_numpy() > 0, 1.0, -1.0)
        rows = [scaled(np.frombuffer(b, np.int32), shared.value) for b in pdf["features"]]
        aside = np.random.default_rng(3).random(len(y)) < 0.2
        if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
            aside = np.zeros(len(y), bool)
        use = np.flatnonzero(~aside)
        w = dual_descent([rows[i] for i in use], y[use], cost)
        w = np.concatenate([w, np.zeros(len(shared.value) - len(w))])
        check = np.flatnonzero(aside) if aside.any() else use
        slope, offset = _logistic(np.array([w[f] @ v for f, v in (rows[i] for i in check)]), y[check])
        return pd.DataFrame({"weights": [(w * shared.value).astype(np.float32).tobytes()], "slope": [slope], "offset": [offset]})

    got = (sample.select("doc_id", "text", "label").mapInArrow(extract, "doc_id long, label int, features binary")
           .groupBy().applyInPandas(train, "weights binary, slope double, offset double").first())
    table.destroy()
    shared.destroy()
    return Model(known, np.frombuffer(bytes(got["weights"]), np.float32), got["slope"], got["offset"])


def scaled(feature: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's indicators scaled by the ratios; long and short texts count alike."""
    return feature, ratio[feature].astype(np.float64) / np.sqrt(len(feature))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text; empty and null texts have only the constant feature."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            margins = []
            for lo in range(0, batch.num_rows, 1024):
                texts = utf8(batch.column(place).slice(lo, 1024))
                doc, gram = features(texts, m.known)
                margins.append(np.bincount(doc, m.weights[gram], len(texts)) / np.sqrt(np.bincount(doc, minlength=len(texts))))
            z = np.concatenate(margins) if margins else np.zeros(0)
            p = 1 / (1 + np.exp(-np.clip(m.slope * z + m.offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str = "quality", broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, text, label) of the rows to learn from: labelled, and not held out.

    Null ids and labels take no part; a document labelled more than once has its labels' majority,
    ties 0. The label table is broadcast only where its rows are counted and few enough.
    """
    train = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("v"))
             .filter("doc_id IS NOT NULL AND v IS NOT NULL").filter(~held_out("doc_id"))
             .groupBy("doc_id").agg((F.avg("v") > 0.5).cast("int").alias("label")))
    train = cut(train)
    side = F.broadcast(train) if train.count() <= broadcast_rows else train
    return id_and_text(docs, "doc_id", "text").join(side, "doc_id")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 16_000,
             label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document, one row per input row.

    Texts are split at ASCII white space; indicators of word 1-grams and 2-grams and of 3-grams of
    word shapes (case, marks, digits, length, repetition) are scaled by class log-count ratios and
    fitted by dual coordinate descent. Only texts are inputs of a score. Empty tables give no rows;
    without labels of both classes the score is constant.
    """
    model = fit(labelled_rows(docs, labels, label_col), max_rows)
    return score(id_and_text(docs, "doc_id", "text"), model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 16_000) -> DataFrame:
    """The documents that the classifier predicts good, with the columns of ``docs``."""
    model = fit(labelled_rows(docs, labels), max_rows)
    name = "_score"
    while name in docs.columns:
        name += "_"
    return score(docs, model, score_col=name).filter(F.col(name) >= threshold).drop(name)
