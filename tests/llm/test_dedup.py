"""Exact, near, byte-string and line dedup against brute force."""
import collections
import hashlib
import itertools
import re

import numpy as np
import pytest

from clvforge.llm.components import connected_components
from clvforge.llm.exact_dedup import content_sort_dedup, kept_documents
from clvforge.llm.line_chunks import drop_repeated_chunks, line_chunks
from clvforge.llm.simhash import POSITION_SETS, first_documents, simhash, simhash_dedup, simhash_links
from clvforge.llm.suffix_dedup import COVER, PERIOD, remove_repeats


def brute_exact(plain):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for i, t in plain:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0))
    out = []
    for n, g in groups.items():
        best = min(g)
        for _, none, i in g:
            out.append((None if none else i, None if best[1] else best[2], len(g), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr), len(groups)


@pytest.mark.parametrize("parts", [1, 8, 40])
def test_exact_dedup_matches_brute_force(docs, plain, parts):
    rows = content_sort_dedup(docs, partitions=parts).select("_row.doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    want, groups = brute_exact(plain)
    assert sorted(((r[0], r[1], r[2], r[4]) for r in rows), key=repr) == want
    assert sum(r["kept"] for r in rows) == groups
    assert all(r["keep_id"] == r["doc_id"] for r in rows if r["kept"])


def test_exact_dedup_merges_the_cells_of_hot_texts(spark):
    rows = [(i, "hot text" + " " * (i % 3)) for i in range(500)] + [(1000 + i, f"own {i}") for i in range(100)]
    got = content_sort_dedup(spark.createDataFrame(rows, "doc_id long, text string"), partitions=6)
    out = got.select("_row.doc_id", "keep_id", "group_size", "kept").collect()
    hot = [r for r in out if r["doc_id"] < 500]
    assert {(r["keep_id"], r["group_size"]) for r in hot} == {(2, 500)} and [r["doc_id"] for r in hot if r["kept"]] == [2]
    assert all(r["kept"] and r["group_size"] == 1 for r in out if r["doc_id"] >= 1000)


def test_kept_documents_have_the_columns_of_the_input(docs, no_docs, plain):
    assert kept_documents(docs).columns == docs.columns
    assert kept_documents(docs).count() == brute_exact(plain)[1]
    assert kept_documents(no_docs).count() == 0


def test_position_sets_meet_every_five_positions():
    assert all(any(set(s) <= set(five) for s in POSITION_SETS) for five in itertools.combinations(range(8), 5))


def brute_components(pairs):
    parent = {}

    def root(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v
    for a, b in pairs:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {v: root(v) for v in parent}


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(-5, 200), (200, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in brute_components(edges).items() if k != 7 or v == 0}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [2048, 3])
def test_simhash_links_connect_what_brute_force_links(spark, block):
    draw = np.random.default_rng(4)
    base = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base[:20]:
        for _ in range(6):
            v = int(b)
            for bit in draw.choice(64, draw.integers(1, 4), replace=False):
                v ^= 1 << int(bit)
            fps.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in fps]
    links = simhash_links(spark.createDataFrame([(v,) for v in signed], "fp long"), block=block).collect()
    mask = (1 << 64) - 1
    brute = [(a, b) for a, b in itertools.combinations(sorted(signed), 2) if ((a ^ b) & mask).bit_count() <= 3]
    assert all(((r["a"] ^ r["b"]) & mask).bit_count() <= 3 for r in links)
    assert brute_components([(r["a"], r["b"]) for r in links]) == brute_components(brute)


def test_simhash_dedup_matches_brute_force(docs, plain, no_docs):
    import xxhash
    got = simhash_dedup(docs).collect()

    def brute(text):
        t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    fps = [(i, brute(t)) for i, t in plain]
    comps = {}
    for i, f in fps:
        near, todo = {f}, [f]
        while todo:
            a = todo.pop()
            for _, b in fps:
                if b not in near and (a ^ b).bit_count() <= 3:
                    near.add(b)
                    todo.append(b)
        comps[f] = min((j for j, g in fps if g in near and j is not None), default=None)
    want = sorted(((i, f, comps[f]) for i, f in fps), key=repr)
    assert sorted(((r[0], r[1] & ((1 << 64) - 1), r[2]) for r in got), key=repr) == want
    assert simhash_dedup(no_docs).count() == 0 and simhash("", 3) == 0
    kept = first_documents(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(comps.values())


def test_cover_is_a_perfect_difference_set():
    assert {(a - b) % PERIOD for a in COVER for b in COVER if a != b} == set(range(1, PERIOD))


def brute_removed(texts, length):
    count = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = True
        yield gone


def test_remove_repeats_matches_brute_force(spark, docs, plain, no_docs):
    draw = np.random.default_rng(2)
    shared = bytes(draw.integers(97, 123, 700, dtype=np.uint8)).decode()
    rows = list(plain)
    for i in range(12):
        own = bytes(draw.integers(97, 123, int(draw.integers(0, 900)), dtype=np.uint8)).decode()
        a, n = int(draw.integers(0, 300)), int(draw.integers(390, 420))
        rows.append((500 + i, own + shared[a:a + n] + own[::-1] + ("é" * 300 if i % 3 == 0 else "")))
    rows.append((600, "ab" * 500))
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=9000).collect()
    texts = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), t, gone in zip(rows, texts, brute_removed(texts, 400)):
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        edge = np.flatnonzero(np.diff(gone.astype(int), prepend=0, append=0)).tolist()
        want.append((i, len(t), int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), edge, kept))
    assert sorted(((*r[:6], bytes(r[6])) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(w[2] for w in want) > 0 and remove_repeats(no_docs).count() == 0


def test_repeats_at_the_edges_of_blocks_of_a_long_text(spark):
    draw = np.random.default_rng(9)
    long = bytes(draw.integers(97, 123, (1 << 20) + 60_000, dtype=np.uint8))
    shared = bytes(draw.integers(97, 123, 900, dtype=np.uint8))
    for n, at in enumerate(((1 << 20) - 450, 5000, 700_000)):  # with other neighbours on both sides
        long = long[:at - 1] + b"%d" % n + shared + b"%d" % n + long[at + 901:]
    rows = [(1, long.decode()), (2, "x" * 30 + shared[100:600].decode()), (3, shared[:399].decode())]
    got = {r["doc_id"]: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["spans"] == [5000, 5900, 700_000, 700_900, (1 << 20) - 450, (1 << 20) + 450]
    assert got[2]["spans"] == [30, 530] and got[3]["spans"] == []


def digest(line):
    import xxhash
    return np.frombuffer(xxhash.xxh3_128_digest(line.encode()), np.uint64)[0]


def test_chunks_end_where_lines_do_not_go_together_and_by_content():
    h = np.array([digest(f"line {i}") for i in range(60)], np.uint64)
    alone = line_chunks(h, np.ones(60, bool))
    assert len(alone) > 5 and all(b - a >= 2 for a, b in alone) and [b for _, b in alone[:-1]] == [a for a, _ in alone[1:]]
    moved = line_chunks(np.concatenate([h[40:42], h]), np.ones(62, bool))
    assert len({c for c in alone if c[0] >= 6} & {(a - 2, b - 2) for a, b in moved}) >= len(alone) - 4
    cut = np.ones(60, bool)
    cut[[9, 29]] = False
    edges = {b for _, b in line_chunks(h, cut)}
    assert {10, 30} <= edges and line_chunks(h[:1], np.ones(1, bool)) == [(0, 1)] and line_chunks(h[:0], cut[:0]) == []


def brute_chunks(rows):
    """The rule in plain words over whole lines: pairs of lines that stand in two places, chunks, first places."""
    unique = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    lines = {r: (r[1] or "").split("\n") for r in unique}
    pairs = collections.Counter(p for ls in lines.values() for p in zip(ls, ls[1:]))
    chunks = {}
    for r, ls in lines.items():
        shared = np.array([pairs[p] > 1 for p in zip(ls, ls[1:])] + [False])
        chunks[r] = line_chunks(np.array([digest(x) for x in ls], np.uint64), shared)
    seen, want = {}, {}
    for r, ls in lines.items():
        gone = set()
        for a, b in chunks[r]:
            body = tuple(ls[a:b])
            if b - a >= 2 and any(x.strip(" \t\n\x0b\x0c\r") for x in body) and seen.setdefault(body, (r, a)) != (r, a):
                gone |= set(range(a, b))
        want[r] = len(gone), "\n".join(x for k, x in enumerate(ls) if k not in gone) if gone else r[1] or ""
    return want


def test_planted_passages_of_2_to_10_lines_go_from_all_but_the_first_place(spark, docs, plain, no_docs):
    fresh = lambda i, n, k: [f"own line {i} {n} {j}" for j in range(k)]
    rows, planted = [], []
    for n in range(2, 11):
        for turn in range(6):
            passage = [f"passage {n} {turn} line {j}" for j in range(n)]
            for copy in range(3):
                i = 1000 * n + 10 * turn + copy
                before, after = ["a common line", *fresh(i, 0, copy + 1)], fresh(i, 1, 2)
                rows.append((i, "\n".join([*before, *passage, *after])))
                planted.append((i, 0 if copy == 0 else n, "\n".join([*before, *(passage if copy == 0 else []), *after])))
    rows += [(90001, "p\nq\nr"), (90002, "q\nr\ns"), (90003, "r\ns\nown"), (90004, "z\nz\nz\nz"), (90005, "p\nq"),
             (90006, "one intro\n\n\none end"), (90007, "other intro\n\n\nother end"), (90008, "\n \n\n")]
    got = {r["doc_id"]: r for r in drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_chunks(rows)
    assert all((got[i]["removed_lines"], got[i]["text"]) == want[i, t] for i, t in rows) and len(got) == len(rows)
    assert all((got[i]["removed_lines"], got[i]["text"]) == (n, text) for i, n, text in planted)
    assert all(got[i]["removed_lines"] == 0 for i in (90006, 90007, 90008))  # blank lines are no passage
    odd = drop_repeated_chunks(docs).collect()
    want = brute_chunks(plain)
    assert sorted(((r["doc_id"], r["removed_lines"], r["text"]) for r in odd), key=repr) == sorted(
        ((i, *want[i, t]) for i, t in plain), key=repr)
    assert any(r["removed_chunks"] for r in odd) and drop_repeated_chunks(no_docs).count() == 0


def test_a_long_text_of_many_lines(spark):
    long = "\n".join(f"line number {i}" for i in range(120_000))  # 2 MB
    shared = "\n".join(f"line number {i}" for i in range(50_000, 50_040))
    got = {r["doc_id"]: r for r in drop_repeated_chunks(spark.createDataFrame(
        [(1, long), (2, "own\n" + shared + "\nend")], "doc_id long, text string")).collect()}
    assert got[1]["text"] == long and got[2]["text"] == "own\nend"
