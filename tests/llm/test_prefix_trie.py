"""Truncation peeling against a trie built turn by turn."""
import hashlib
import random
import zlib

import pytest

from clvforge.llm.prefix_trie import prefix_trie, share_heads, turn_paths

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, rebuild=True):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(ts)] for c, ts in convs.items()}
    full = own
    if rebuild:
        full = {}
        for c, ts in own.items():
            h = zlib.crc32(str(c).encode()) % 6
            base = int(c - (abs(c) % 100) * (1 if c >= 0 else -1))
            full[c] = own.get(base, [])[:h] + ts[h:]
    members = {}
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for p, m in members.items():
        kids = [q for q in members if len(q) == len(p) + 1 and q[:len(p)] == p]
        tree = [q for q in members if q[:len(p)] == p]
        leaves = [q for q in tree if not any(len(x) == len(q) + 1 and x[:len(q)] == q for x in tree)]
        saved = sum((len(members[q]) - 1) * (len(q[-1][1]) if q else 0) for q in tree)
        ends = ",".join(map(str, sorted(c for c in m if len(full[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(long):
    draw = random.Random(3)
    texts = [None, "", "a", "héllo", "x" * 5000, "😀 ok", "a\nb"]
    rows = []
    for c in [*range(0, 40), *range(100, 140), *range(205, 230), *range(-9, 0), 2 ** 40, 7]:
        for t in range(draw.randint(1, 7)):
            rows.append((c, t if draw.random() > 0.05 else None, draw.choice(["user", "assistant", None]), texts[draw.randint(0, 6) if t else 2]))
    rows += [(300 + i, t, "user", "same") for i in range(30) for t in range(3)]  # copies
    rows += [(400 + i, t, "user", f"deep {t}" if t != 30 else f"{i}") for i in range(4) for t in range(long)]
    rows += [(None, 1, "user", "lost"), (None, None, None, None), (500, None, None, None)]
    return rows


def nodes(df, group):
    return sorted(map(tuple, prefix_trie(df, group=group).select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("long,group", [(45, 100_000), (12, 50)])
def test_trie_matches_brute_force(spark, long, group):
    rows = made(long)
    schema = "conv_id long, turn long, role string, text string, path string, depth int, node binary"
    if group == 50:  # rows of a conversation that are tied in turn: in some order, the same one each time
        tied = spark.createDataFrame([(*r, "x", 1, b"y") for r in rows], schema)
        assert sum(r["depth"] == 0 for r in prefix_trie(turn_paths(tied)).collect()) == 1
    count = {}
    for c, t, *_ in rows:
        count[c, t] = count.get((c, t), 0) + 1
    rows = [r for r in rows if count[r[:2]] == 1]
    paths = turn_paths(spark.createDataFrame([(*r, "x", 1, b"y") for r in rows], schema))
    if group == 50:
        assert nodes(paths, group) == brute(rows, rebuild=False)
    else:
        assert nodes(share_heads(paths), group) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie(share_heads(turn_paths(df))).count() == 0
