"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clvforge.llm.common import cut, id_and_text

# Words of the given lexicons, common insults of four languages.
LEXICONS = {
    "mind": """idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile fool fools clown clowns
        dimwit halfwit brainless dummkopf dumm blöd blödmann trottel depp vollidiot idiote imbécile crétin abruti débile
        stupide estúpido estúpida idiota imbécil tonto tonta payaso""",
    "worth": """worthless pathetic loser losers trash garbage scum useless nobody failure filth vermin parasite abschaum
        versager wertlos müll nutzlos erbärmlich armselig nul nulle raté ordure minable racaille inútil basura escoria
        perdedor patético patética""",
    "disgust": """disgusting disgust gross repulsive revolting vile nasty ugly creep pervert freak ekelhaft widerlich
        abscheulich hässlich dégoûtant dégueulasse répugnant moche asqueroso asquerosa repugnante feo""",
    "threat": """kill die murder hang destroy beat hurt stirb umbringen töten hängen verprügeln crève tuer frapper
        muere matar golpear""",
    "profane": """damn hell crap shit bullshit bastard bitch ass asshole arschloch scheiße scheiss verdammt mist merde
        putain connard salaud con mierda puta cabrón gilipollas joder""",
}
# Words that address the reader.
ADDRESS = "you your youre ur u du dich dir dein ihr euch tu toi ton vous tú te ti eres usted ustedes".split()

#: Bytes of the prefixes that are terms beside whole words.
PREFIXES = (3, 4, 5, 6, 7, 8, 10)
#: The mined lexicons' kind of each kind of term: words, prefixes up to 4, 6 and 10 bytes; each has three strengths.
_KINDS = np.array([0, 1, 1, 2, 2, 3, 3, 3])
_STRENGTHS = (2.5, 8.0, 30.0)
_MINED, _GIVEN = 12, len(LEXICONS)
PATTERNS = ["dense", "address", "shouting", "marks", "masked", "short"]
VOTERS = _MINED + _GIVEN + len(PATTERNS)
_PIECE = 1 << 19


@functools.lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    b = np.arange(256)
    letter = ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)
    return letter, np.isin(b, list(b"*@$#013457"))


def _mix(lo: np.ndarray, hi: np.ndarray, tag) -> np.ndarray:
    x = lo * np.uint64(0x9E3779B97F4A7C15) ^ (hi + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F) ^ (
        (np.atleast_1d(tag).astype(np.uint64) + np.uint64(1)) * np.uint64(0x165667B19E3779F9))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Piece:
    """Words (runs of letters) of some texts, or of a part of one, lower-cased (ASCII and Latin-1 letters).

    A word is known by its first 16 bytes and its length.
    """

    def __init__(self, parts: list[tuple[int, bytes]]):
        letter, masking = _classes()
        self.data = np.frombuffer(b"\n".join(p for _, p in parts) + b"\n", np.uint8)
        ends = np.cumsum([len(p) + 1 for _, p in parts])
        self.docs = np.array([d for d, _ in parts])
        low = self.data.copy()
        low[(low >= 65) & (low <= 90)] |= 32
        wide = np.flatnonzero(low[:-1] == 0xC3) + 1
        wide = wide[(low[wide] >= 0x80) & (low[wide] <= 0x9E) & (low[wide] != 0x97)]
        low[wide] |= 32
        is_letter = letter[low]
        edge = np.flatnonzero(np.diff(is_letter, prepend=False))
        start, end = edge[::2], edge[1::2]
        self.size = end - start
        reach = np.arange(16)
        first = low[np.minimum(start[:, None] + reach, len(low) - 1)]
        first[reach >= self.size[:, None]] = 0
        self.lo, self.hi = (np.ascontiguousarray(first[:, k:k + 8]).view("<u8")[:, 0] for k in (0, 8))
        self.doc = self.docs[np.searchsorted(ends, start, side="right")] if len(start) else start
        self.word = _mix(self.lo, self.hi, self.size)
        caps = np.concatenate(([0], np.cumsum((self.data >= 65) & (self.data <= 90), dtype=np.int32)))
        self.caps = (self.size > 1) & (caps[end] - caps[start] == self.size)
        place = lambda at: self.docs[np.searchsorted(ends, at, side="right")]
        bang = self.data == 33
        self.marks = place(np.flatnonzero(bang[2:] & bang[1:-1] & bang[:-2]))
        inner = masking[self.data[1:-1]] & is_letter[:-2] & is_letter[2:]
        self.masked = place(np.flatnonzero(inner) + 1)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        _, first, inverse = np.unique(self.word, return_index=True, return_inverse=True)
        return first, inverse

    def terms(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(key, whether the word has such a term) of the words ``at``: the word itself, then its prefixes.

        The last three bits of a key are the kind of term, 0 for a word.
        """
        lo, hi, size = self.lo[at], self.hi[at], self.size[at]
        yield self.word[at] & ~np.uint64(7), np.ones(len(at), bool)
        for kind, n in enumerate(PREFIXES, 1):
            a = lo & np.uint64((1 << 8 * min(n, 8)) - 1)
            b = hi & np.uint64((1 << 8 * max(n - 8, 0)) - 1)
            yield _mix(a, b, 1_000_000 + n) & ~np.uint64(7) | np.uint64(kind), size > n


def pieces(texts: list[bytes]) -> Iterator[Piece]:
    """Texts in pieces of bounded size; a long text is cut at white space, a run without any stays whole."""
    parts, held = [], 0
    for doc, text in enumerate(texts):
        lo = 0
        while lo < len(text):
            hi = min(lo + _PIECE, len(text))
            if hi < len(text):
                blank = max(text.rfind(b" ", lo, hi), text.rfind(b"\n", lo, hi))
                if blank < lo:
                    nexts = [x for x in (text.find(b" ", hi), text.find(b"\n", hi)) if x >= 0]
                    blank = min(nexts, default=len(text) - 1)
                hi = blank + 1
            if held and held + hi - lo > _PIECE:
                yield Piece(parts)
                parts, held = [], 0
            parts.append((doc, text[lo:hi]))
            held, lo = held + hi - lo, hi
    if parts:
        yield Piece(parts)


class Lookup:
    """Sorted term keys with the lexicons that hold them."""

    def __init__(self, keys: np.ndarray, mined: np.ndarray, given: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.mined, self.given = keys[order], mined[order], given[order]
        self.may = np.zeros(1 << 21, bool)
        self.may[(self.keys >> np.uint64(43)).astype(np.int64)] = True

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1)
        may = np.flatnonzero(self.may[(keys >> np.uint64(43)).astype(np.int64)])
        if len(may) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys[may]), len(self.keys) - 1)
            out[may] = np.where(self.keys[at] == keys[may], at, -1)
        return out

    def hits(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """(word, place of its term) of all terms of the piece that are known."""
        first, inverse = piece.distinct()
        words, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for key, has in piece.terms(first):
            known = np.where(has, self.find(key), -1)
            if (known >= 0).any():
                place = known[inverse]
                at = np.flatnonzero(place >= 0)
                words.append(at)
                places.append(place[at])
        return np.concatenate(words), np.concatenate(places)


def given_words() -> tuple[np.ndarray, np.ndarray]:
    """(key, number) of the given lexicons' words; ADDRESS has the last number."""
    lists = [*(words.split() for words in LEXICONS.values()), ADDRESS]
    both = [(Piece([(0, w.encode())]).word[0] & ~np.uint64(7), n) for n, words in enumerate(lists) for w in words]
    return np.array([k for k, _ in both], np.uint64), np.array([n for _, n in both])


def votes(texts: list[bytes], lookup: Lookup, with_terms: bool = False):
    """Votes (texts x VOTERS) of 0 (nothing), 1 (something) or 2 (much); terms as (text, place, count) if asked for."""
    n, lexicons = len(texts), _MINED + _GIVEN
    count = np.zeros((n, lexicons), np.int64)
    words, strong, caps, marks, masked, address = (np.zeros(n, np.int64) for _ in range(6))
    pairs, amounts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    known = max(1, len(lookup.keys))
    for piece in pieces(texts):
        at, place = lookup.hits(piece)
        words += np.bincount(piece.doc, minlength=n)
        caps += np.bincount(piece.doc[piece.caps], minlength=n)
        marks += np.bincount(piece.marks, minlength=n)
        masked += np.bincount(piece.masked, minlength=n)
        mined, given = lookup.mined[place], lookup.given[place]
        lexicon = np.concatenate([mined, np.where((given >= 0) & (given < _GIVEN), given + _MINED, -1)])
        both = np.unique(np.concatenate([at, at])[lexicon >= 0] * lexicons + lexicon[lexicon >= 0])  # a word counts once a lexicon
        word, lexicon = both // lexicons, both % lexicons
        count += np.bincount(piece.doc[word] * lexicons + lexicon, minlength=n * lexicons).reshape(n, lexicons)
        bad = np.unique(word[(lexicon >= _MINED) | (lexicon % 3 == 2)])
        strong += np.bincount(piece.doc[bad], minlength=n)
        told = np.zeros(len(piece.doc) + 1, np.int64)
        told[at[given == _GIVEN] + 1] = 1
        told = np.cumsum(told)
        before = np.maximum(bad - 3, np.searchsorted(piece.doc, piece.doc[bad]))
        address += np.bincount(piece.doc[bad[told[bad] > told[before]]], minlength=n)
        if with_terms:
            pair, amount = np.unique(piece.doc[at] * known + place, return_counts=True)
            pairs.append(pair)
            amounts.append(amount)
    out = np.zeros((n, VOTERS), np.int64)
    out[:, :lexicons] = np.minimum(count, 2)
    level = lambda *tests: sum(t.astype(np.int64) for t in tests)
    out[:, lexicons:] = np.stack([
        level(strong > 0, strong * 200 >= np.maximum(words, 1)),
        level(address > 0, address > 1),
        level(caps > 2, (caps > 4) & (caps * 3 > words)),
        level(marks > 0, marks > 2),
        level(masked > 0, masked > 2),
        level(words < 40, words < 10)], 1)
    if not with_terms:
        return out
    pair, back = np.unique(np.concatenate(pairs), return_inverse=True)
    return out, (pair // known, pair % known, np.bincount(back, np.concatenate(amounts), len(pair)))


def encode(vote: np.ndarray) -> np.ndarray:
    """A row of votes as one number, two bits a voter."""
    return (vote.astype(np.int64) << (2 * np.arange(vote.shape[1]))).sum(1)


def decode(code: np.ndarray) -> np.ndarray:
    return (code[:, None] >> (2 * np.arange(VOTERS))) & 3


def _bytes(column: pa.Array) -> list[bytes]:
    return [x.as_py() or b"" for x in column.cast(pa.binary())]


# --- terms ---------------------------------------------------------------------------------------

def _counted(rows: DataFrame) -> DataFrame:
    """(key, n): how many texts hold each term, summed in the task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def total() -> tuple[np.ndarray, np.ndarray]:
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)

        def batch_of(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

        for batch in batches:
            for text in _bytes(batch.column(0)):
                own = [np.zeros(0, np.uint64)]
                for piece in pieces([text]):
                    own += [key[has] for key, has in piece.terms(piece.distinct()[0])]
                own = np.unique(np.concatenate(own))
                keys.append(own)
                counts.append(np.ones(len(own)))
                held += len(own)
                if held > 2_000_000:
                    key, n = total()
                    if len(key) > 1_000_000:
                        yield batch_of(key, n)
                        key, n = key[:0], n[:0]
                    keys, counts, held = [key], [n], len(key)
        if keys:
            yield batch_of(*total())

    return rows.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _count_known(rows: DataFrame, keys: np.ndarray) -> np.ndarray:
    """How many texts hold each of the given terms."""
    none = np.full(len(keys), -1)
    shared = rows.sparkSession.sparkContext.broadcast(Lookup(keys, none, none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = shared.value
        n = np.zeros(len(lookup.keys), np.int64)
        for batch in batches:
            _, (_, place, _) = votes(_bytes(batch.column(0)), lookup, with_terms=True)
            n += np.bincount(place, minlength=len(n))
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(n[has])], names=["place", "n"])

    got = rows.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    out = np.zeros(len(keys))
    out[got["place"].to_numpy()] = got["n"].to_numpy()
    return out


def mine_lexicons(labelled: DataFrame, n1: int, n0: int, max_terms: int = 1 << 16, least_share: float = 0.002) -> Lookup:
    """Terms that go with a label, and the mined and given lexicons over them.

    Counts cover all labelled rows. A term is taken up where at least three texts and ``least_share``
    of those of label 1 hold it (so there are at most some hundred times a text's distinct terms), its
    G² with the label is more than chance gives the best of that many terms (one time in 20), and it is
    among the ``max_terms`` of greatest G².
    """
    given_keys, given_number = given_words()
    keys, mined = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n1 and n0:
        least = max(3, int(np.ceil(least_share * n1)))
        found = (_counted(labelled.filter("label = 1")).filter(F.col("n") >= least)
                 .orderBy(F.desc("n"), "key").limit(8 * max_terms).toArrow())
        keys = found["key"].to_numpy().astype(np.int64).view(np.uint64)
        ones = found["n"].to_numpy().astype(float)
        order = np.argsort(keys)
        keys, ones = keys[order], ones[order]
        zeros = _count_known(labelled.filter("label = 0"), keys) if len(keys) else ones
        part = lambda seen, fair: np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(fair, 1e-9)), 0.0)
        share = (ones + zeros) / (n1 + n0)
        g2 = 2 * (part(ones, n1 * share) + part(n1 - ones, n1 * (1 - share)) + part(zeros, n0 * share) + part(n0 - zeros, n0 * (1 - share)))
        best = np.argsort(-g2, kind="stable")[:max_terms]
        best = best[g2[best] >= 2 * np.log(max(len(keys), 1) / 0.05)]
        keys, ones, zeros = keys[best], ones[best], zeros[best]
        ratio = ((ones + 0.5) / (n1 + 1)) / ((zeros + 0.5) / (n0 + 1))
        strength = np.searchsorted(_STRENGTHS, ratio, side="right") - 1
        mined = np.where(strength >= 0, 3 * _KINDS[(keys & np.uint64(7)).astype(np.int64)] + strength, -1)
    extra = ~np.isin(given_keys, keys)
    new, index = np.unique(given_keys[extra], return_index=True)
    keys = np.concatenate([keys, new])
    mined = np.concatenate([mined, np.full(len(new), -1)])
    given = np.full(len(keys), -1)
    order = np.argsort(keys)
    given[order[np.searchsorted(keys[order], given_keys)]] = given_number
    return Lookup(keys, mined, given)


# --- label model ---------------------------------------------------------------------------------

class LabelModel:
    """Class shares, and of each voter its votes' probabilities given the class and its parent voter's vote."""

    def __init__(self, prior: np.ndarray, table: np.ndarray, parent: np.ndarray, trust: float):
        self.prior, self.table, self.parent, self.trust = prior, table, parent, trust

    def posterior(self, vote: np.ndarray, label: np.ndarray) -> np.ndarray:
        """P(toxic) from votes (rows x VOTERS) and a given label (-1: none), which is right with probability ``trust``."""
        above = np.where(self.parent >= 0, vote[:, np.maximum(self.parent, 0)], 0)
        each = np.log(self.table[:, np.arange(VOTERS), above, vote]).sum(2)  # class x row
        score = np.log(self.prior)[:, None] + each
        right, wrong = np.log(self.trust), np.log(1 - self.trust)
        score[1] += np.where(label == 1, right, np.where(label == 0, wrong, 0.0))
        score[0] += np.where(label == 0, right, np.where(label == 1, wrong, 0.0))
        return 1 / (1 + np.exp(np.clip(score[0] - score[1], -60, 60)))


def _pair_sums(patterns: DataFrame, believe) -> np.ndarray:
    """Expected counts (class x voter-vote x voter-vote) over all documents; ``believe`` gives P(toxic)."""
    width = 3 * VOTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, width, width))
        for batch in batches:
            vote = decode(batch.column(0).to_numpy())
            label, n = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(float)
            q = believe(vote, label)
            hot = (vote[:, :, None] == np.arange(3)).reshape(len(vote), width).astype(float)
            for y, weight in enumerate(((1 - q) * n, q * n)):
                sums[y] += (hot * weight[:, None]).T @ hot
        place = np.arange(width * width)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(sums[0].ravel()), pa.array(sums[1].ravel())],
                                         names=["place", "zero", "one"])

    got = patterns.mapInArrow(run, "place long, zero double, one double").groupBy("place").agg(
        F.sum("zero").alias("zero"), F.sum("one").alias("one")).toArrow()
    out = np.zeros((2, width * width))
    out[0, got["place"].to_numpy()], out[1, got["place"].to_numpy()] = got["zero"].to_numpy(), got["one"].to_numpy()
    return out.reshape(2, VOTERS, 3, VOTERS, 3)


def _correlated(sums: np.ndarray) -> np.ndarray:
    """Each voter's parent: a greatest spanning forest over the voters' conditional dependence given the class."""
    total = sums[:, 0, :, 0, :].sum()
    gain = np.zeros((VOTERS, VOTERS))
    for y in range(2):
        for i in range(VOTERS):
            for j in range(i):
                joint = sums[y, i, :, j, :] + 1e-9
                expected = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True) / joint.sum()
                gain[i, j] += (joint * np.log(joint / expected)).sum()
    gain += gain.T
    parent, joined = np.full(VOTERS, -1), np.zeros(VOTERS, bool)
    joined[int(gain.sum(0).argmax())] = True
    while not joined.all():
        open_edges = np.where(joined[:, None] & ~joined[None, :], gain, -1.0)
        i, j = np.unravel_index(int(open_edges.argmax()), gain.shape)
        if 2 * open_edges[i, j] > 20 + np.log(max(total, 2)):  # chance gives about 8 degrees of freedom
            parent[j] = i
        joined[j] = True
    return parent


def _tables(sums: np.ndarray, parent: np.ndarray, trust: float, smooth: float = 1.0) -> LabelModel:
    prior = sums[:, 0, :, 0, :].sum((1, 2)) + smooth
    table = np.zeros((2, VOTERS, 3, 3))
    for j, p in enumerate(parent):
        own = np.stack([np.diagonal(sums[y, j, :, j, :]) for y in range(2)])
        overall = (own + smooth / 3) / (own.sum(1, keepdims=True) + smooth)
        table[:, j] = overall[:, None, :]
        if p >= 0:
            n = sums[:, p, :, j, :]
            table[:, j] = (n + 2 * overall[:, None, :]) / (n.sum(2, keepdims=True) + 2)
    return LabelModel(prior / prior.sum(), table, parent, trust)


def fit_label_model(patterns: DataFrame, trust: float = 0.97, tolerance: float = 1e-3, rounds: int = 40) -> LabelModel:
    """Accuracies and correlations of the voters by expectation maximisation over all documents.

    ``patterns`` has (code, label, n). The start believes the given labels, or without labels of both
    classes the given lexicons; then each round is one Spark job that sums expected counts. Votes are
    dependent along a forest learnt from the first rounds' counts. It ends when no probability moves
    by ``tolerance``, and fails if that takes more than ``rounds``.
    """
    seen = {r["label"] for r in patterns.select("label").distinct().collect()}
    anchored = {0, 1} <= seen

    def first(vote: np.ndarray, label: np.ndarray) -> np.ndarray:
        insulted = (vote[:, _MINED:_MINED + 3] > 0).any(1)
        return np.where(insulted, 0.9, 0.02) if not anchored else np.where(label == 1, trust, 1 - trust)

    start = patterns.filter("label >= 0") if anchored else patterns
    model = _tables(_pair_sums(start, first), np.full(VOTERS, -1), trust)
    sums = _pair_sums(patterns, model.posterior)
    model = _tables(sums, _correlated(sums), trust)
    for _ in range(rounds):
        new = _tables(_pair_sums(patterns, model.posterior), model.parent, trust)
        weight = new.prior[:, None, None, None]
        moved = max(np.abs(new.prior - model.prior).max(), (np.abs(new.table - model.table) * weight).max())
        model = new
        if moved < tolerance:
            return model
    raise RuntimeError(f"the label model has not settled in {rounds} rounds")


# --- linear classifier ---------------------------------------------------------------------------

def _design(vote: np.ndarray, terms: tuple, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value): damped term counts of unit length, then votes, then a constant."""
    text, place, count = terms
    value = 1 + np.log(np.maximum(count, 1))
    length = np.sqrt(np.bincount(text, value * value, len(vote)))
    voted, voter = np.nonzero(vote)
    feature = known + 2 * voter + vote[voted, voter] - 1
    n = np.arange(len(vote))
    row = np.concatenate([text, voted, n])
    column = np.concatenate([place, feature, np.full(len(n), known + 2 * VOTERS)])
    values = np.concatenate([value / np.maximum(length[text], 1e-9), np.full(len(voted), 0.5), np.ones(len(n))])
    order = np.argsort(row, kind="stable")
    return row[order], column[order].astype(np.int32), values[order].astype(np.float32)


def _descend(row, column, value, target, weight, size: int, rounds: int = 200) -> np.ndarray:
    """Logistic weights for soft targets by a limited-memory quasi-Newton descent."""
    penalty = np.full(size, 1 / max(1, len(target)))
    penalty[-1] = 1e-8

    def loss(w):
        z = np.bincount(row, w[column] * value, len(target))
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        f = (weight * (np.logaddexp(0, z) - target * z)).sum() + 0.5 * (penalty * w * w).sum()
        return f, np.bincount(column, (weight * (p - target))[row] * value, size) + penalty * w

    w = np.zeros(size)
    f, g = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, back = g.copy(), []
        for s, y in reversed(steps):
            a = (s @ d) / (s @ y)
            d -= a * y
            back.append(a)
        if steps:
            s, y = steps[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(back)):
            d += s * (a - (y @ d) / (s @ y))
        slope, t = g @ d, 1.0 if steps else 1.0 / max(1e-12, np.abs(g).sum())
        for _ in range(40):
            new = w - t * d
            f2, g2 = loss(new)
            if f2 <= f - 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = new - w, g2 - g
        if s @ y > 1e-12:
            steps = [*steps[-9:], (s, y)]
        done = f - f2 < 1e-6 * abs(f)
        w, f, g = new, f2, g2
        if done:
            break
    return w


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _labels(labels: DataFrame, label_col: str) -> DataFrame:
    """(doc_id, label) of the rows to learn from; several labels of a document count by majority, ties 0."""
    return cut(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("v"))
               .filter("doc_id IS NOT NULL AND v IS NOT NULL").filter(~held_out("doc_id"))
               .groupBy("doc_id").agg((F.avg("v") > 0.5).cast("int").alias("label")))


def detect_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = 12_000, max_terms: int = 1 << 16,
                    label_col: str = "toxic", broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document, one row per input row.

    1. Terms (words and their prefixes) that go with label 1 are mined from all labelled rows that
       are not held out, into 12 lexicons by kind and strength; with the given lexicons and six
       patterns they vote on every document.
    2. The label model estimates the voters' accuracies and correlations from the votes on all
       documents, given labels being one more voter (none on held-out rows).
    3. Its posteriors are the targets of a logistic classifier over damped term counts and votes,
       fitted on about ``max_rows`` documents that are not held out: a third each of those labelled
       1, labelled 0 and not labelled, drawn by a hash of the id and weighted back to their shares.
    4. The classifier scores every whole text.

    Only texts are inputs of a score. Null and empty texts have votes but no terms; equal texts have equal
    scores; other columns stay out. Without labels of both classes only the given lexicons and
    patterns vote. Empty tables give no rows.
    """
    spark = docs.sparkSession
    train = _labels(labels, label_col)
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    side = F.broadcast(train) if sum(sizes.values()) <= broadcast_rows else train
    texts = id_and_text(docs, "doc_id", "text")
    labelled = texts.join(side, "doc_id")
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    lookup = mine_lexicons(labelled, n1, n0, max_terms)
    table = spark.sparkContext.broadcast(lookup)
    marked = texts.join(side, "doc_id", "left").select("doc_id", "text", F.coalesce("label", F.lit(-1)).alias("label"))

    def cast_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = encode(votes(_bytes(batch.column(0)), table.value))
            yield pa.RecordBatch.from_arrays([pa.array(code), batch.column(1)], names=["code", "label"])

    patterns = cut(marked.select("text", "label").mapInArrow(cast_votes, "code long, label int")
                   .groupBy("code", "label").agg(F.count(F.lit(1)).alias("n")))
    seen = {r["label"]: r["n"] for r in patterns.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if not seen:
        return texts.select("doc_id", held_out("doc_id").alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    model = fit_label_model(patterns)

    rate = {y: min(1.0, max_rows / 3 / max(1, seen.get(y, 0))) for y in (-1, 0, 1)}
    rates = F.when(F.col("label") == 1, rate[1]).when(F.col("label") == 0, rate[0]).otherwise(rate[-1])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) / 1_000_000
    sample = marked.filter(~held_out("doc_id")).filter(draw < rates).select("text", "label", (1 / rates).alias("weight"))
    known = len(lookup.keys)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vote, terms = votes(_bytes(batch.column(0)), table.value, with_terms=True)
            q = model.posterior(vote, batch.column(1).to_numpy())
            row, column, value = _design(vote, terms, known)
            ends = np.searchsorted(row, np.arange(len(vote) + 1))
            pack = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([pack(column), pack(value), pa.array(q), batch.column(2)],
                                             names=["places", "vals", "q", "weight"])

    def train_linear(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["q", "weight", "places", "vals"])  # the same sum whatever the order of arrival
        row = np.repeat(np.arange(len(pdf)), [len(x) // 4 for x in pdf["places"]])
        column = np.frombuffer(b"".join(pdf["places"]), np.int32)
        value = np.frombuffer(b"".join(pdf["vals"]), np.float32).astype(np.float64)
        weight = pdf["weight"].to_numpy() / pdf["weight"].sum()
        w = _descend(row, column, value, pdf["q"].to_numpy(), weight, known + 2 * VOTERS + 1)
        return pd.DataFrame({"w": [w.astype(np.float32).tobytes()]})

    got = sample.mapInArrow(extract, "places binary, vals binary, q double, weight double").groupBy().applyInPandas(
        train_linear, "w binary").collect()
    w = np.frombuffer(bytes(got[0]["w"]), np.float32) if got else np.zeros(known + 2 * VOTERS + 1, np.float32)
    weights = spark.sparkContext.broadcast(w)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vote, terms = votes(_bytes(batch.column(1)), table.value, with_terms=True)
            row, column, value = _design(vote, terms, known)
            z = np.bincount(row, weights.value[column] * value.astype(np.float64), len(vote))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))],
                                             names=["doc_id", "score"])

    return texts.mapInArrow(score, "doc_id long, score double").select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
