"""Work that the operators need not do twice, or at all."""
import numpy as np

from clvforge.llm.catalog import model_path
from clvforge.llm.pieces import PieceCodec
from clvforge.llm.topk import CoverTree, DualSearch, _visit


def test_segments_of_a_large_vocabulary_are_encoded_once():
    codec, calls = PieceCodec(model_path()), []
    encode = codec.segment
    codec.segment = lambda s: calls.append(s) or encode(s)
    texts = [" ".join(f"{n:x}" for n in range(lo, lo + 1000)) for lo in range(0, 230_000, 1000)]
    first = [codec.encode_bytes(t) for t in texts]
    assert [codec.encode_bytes(t) for t in texts] == first
    assert len(calls) == len(set(calls))


def test_a_visit_gives_no_row_below_the_floor(spark):
    draw = np.random.default_rng(3)
    data, asks = draw.integers(-50, 50, (300, 6)), draw.integers(-50, 50, (20, 6))
    scores = np.sort(asks @ data.T, axis=1)[:, ::-1]
    floor = scores[:, 3].copy()  # from elsewhere: only the four best of each query, and ties, can matter
    bytes_of = lambda a: np.ascontiguousarray(a, "<i8").tobytes()
    rows = [("b", None, 6, bytes_of(np.arange(300)), bytes_of(data), None),
            ("b", "q", 6, bytes_of(np.arange(1000, 1020)), bytes_of(asks), bytes_of(floor))]
    visits = spark.createDataFrame(rows, "block string, asks string, dim int, ids binary, vecs binary, floor binary").coalesce(1)
    got = {(r["place"], r["vec_id"], r["score"]) for r in _visit(visits.sortWithinPartitions("block", "asks"), 10).collect()}
    assert got == {(i, j, int(s)) for i, row in enumerate(asks @ data.T) for j, s in enumerate(row) if s >= floor[i]}


def test_search_with_and_without_a_floor_agree_above_it():
    draw = np.random.default_rng(4)
    data, asks = draw.integers(-9, 9, (500, 4)), draw.integers(-9, 9, (70, 4))  # many ties
    data[::50] = data[1]
    ids, names = np.arange(500), np.concatenate([np.arange(0, 30), np.arange(900, 940)])
    free = DualSearch(names, asks, 10)
    free.search(ids, data, CoverTree(data.astype(float)))
    for q, (name, a) in enumerate(zip(names, asks)):
        best = sorted((-int(s), int(i)) for i, s in zip(ids, data @ a) if i != name)[:10]
        assert [(-int(s), int(i)) for s, i in zip(free.score[q], free.found[q])] == best
    bound = DualSearch(names, asks, 10, free.score[:, 5].copy())
    bound.search(ids, data, CoverTree(data.astype(float)))
    keep = free.score >= free.score[:, 5:6]
    assert (bound.score[keep] == free.score[keep]).all() and (bound.found[keep] == free.found[keep]).all()
