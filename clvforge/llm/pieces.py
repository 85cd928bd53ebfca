"""SentencePiece encoding and decoding of merge-type (BPE) models by backtracking."""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clvforge.llm.common import id_and_text

SPACE = "▁"


class PieceCodec:
    """Encoder and decoder for one model file: byte fallback, identity normalisation, dummy prefix.

    A sequence of pieces is what merging yields exactly when each neighbouring pair is what merging
    yields for the pair's own text. So the encoder takes the longest piece at each position, found by
    an Aho-Corasick automaton, checks it against the piece before by merging the two again, tries
    shorter pieces, and steps back where none fits; positions from which it failed are bits that are
    never tried again.

    No piece holds a space mark after another character (checked on load), and a character outside
    all pieces never merges. Text is cut at both, and segments are remembered between texts: up to twice
    ``remembered`` of them, some 250 bytes each.
    """

    def __init__(self, path: str, remembered: int = 400_000, pairs: int = 200_000):
        import ahocorasick
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id: dict[int, int] = {}
        self.piece_bytes: list[bytes] = [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.piece_bytes[i] = bytes([int(piece[3:5], 16)])
            elif sp.is_unknown(i):
                self.piece_bytes[i] = " ⁇ ".encode()
            elif not (sp.is_control(i) or sp.is_unused(i)):
                self.ids[piece] = i
                self.score[piece] = sp.get_score(i)
                self.piece_bytes[i] = piece.replace(SPACE, " ").encode()
        alphabet = {c for p in self.ids for c in p}
        if len(self.byte_id) != 256 or any(c not in self.ids for c in alphabet):
            raise ValueError("the model needs byte fallback and a piece for each of its characters")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece crosses a word start; text cannot be cut there")
        self.alphabet = alphabet
        line = "" if "\n" in alphabet else "\n"
        self.segments = re.compile(f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + (f"|{line}" if line else "")).findall
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[str, str] = {}  # the longest piece that a piece starts with, itself excepted
        for piece in self.ids:
            self.automaton.add_word(piece, (len(piece) - 1, piece))
            self.shorter[piece] = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.ids), "")
        self.automaton.make_automaton()
        self.most = max(map(len, self.ids))
        self.fits: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}  # segments met lately, and those met before them
        self.older: dict[str, bytes] = {}
        self.remembered, self.pairs = remembered, pairs

    def apart(self, left: str, right: str) -> bool:
        """Merge the joint text, best score first and leftmost among equals: are the two pieces what is left?"""
        none, get, parts, inner = float("-inf"), self.score.get, list(left + right), len(left)
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > none:
            i = scores.index(best)
            if i == inner - 1:
                return False  # a merge across the boundary
            inner -= i < inner
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], none)
        return len(parts) == 1 + bool(left)

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the two pieces' text again gives the two pieces."""
        if len(self.fits) > self.pairs:
            self.fits.clear()
        ok = self.fits[left, right] = self.apart(left, right)
        return ok

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text whose characters all are pieces."""
        n, fits, shorter = len(text), self.fits, self.shorter
        longest = {end - size: piece for end, (size, piece) in self.automaton.iter_long(text)}
        alive = bytearray(b"\1") * (n + 1)
        out: list[str] = []
        pos, last, piece = 0, "", longest[0]
        while True:
            while piece:
                end = pos + len(piece)
                if alive[end]:
                    ok = fits.get((last, piece))
                    if self.compatible(last, piece) if ok is None else ok:
                        break
                piece = shorter[piece]
            if piece:
                if end == n:
                    out.append(piece)
                    return out
                out.append(piece)
                pos, last, piece = end, piece, longest.get(end) or self.longest(text, end)
            else:
                alive[pos] = 0
                piece = out.pop()
                pos -= len(piece)
                last = out[-1] if out else ""

    def longest(self, text: str, start: int) -> str:
        """The longest piece at a start that the automaton's scan of neighbouring pieces passed over."""
        ids = self.ids
        for end in range(start + self.automaton.longest_prefix(text[start:start + self.most]), start, -1):
            if (piece := text[start:end]) in ids:
                return piece
        return ""

    def segment(self, text: str) -> bytes:
        """Ids of one segment, as little-endian 32-bit integers."""
        number = self.ids.__getitem__
        if self.alphabet.issuperset(text):
            return array("I", map(number, self.backtrack(text))).tobytes()
        ids: list[int] = []
        for known, run in itertools.groupby(text, self.alphabet.__contains__):
            run = "".join(run)
            ids += map(number, self.backtrack(run)) if known else map(self.byte_id.__getitem__, run.encode())
        return array("I", ids).tobytes()

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a whole text with begin and end ids, as little-endian 32-bit integers."""
        segments = self.segments(SPACE + text.replace(" ", SPACE)) if text else []
        ids = list(map(self.known.get, segments))
        try:
            body = b"".join(ids)
        except TypeError:  # some are not remembered
            body = b"".join([self.recall(s) if i is None else i for s, i in zip(segments, ids)])
        return self.bos.to_bytes(4, "little") + body + self.eos.to_bytes(4, "little")

    def recall(self, segment: str) -> bytes:
        """Ids of a segment that was not met lately; it is remembered unless it is long."""
        ids = self.known.get(segment) or self.older.get(segment) or self.segment(segment)
        if len(segment) <= 64:
            if len(self.known) >= self.remembered:
                self.older, self.known = self.known, {}
            self.known[segment] = ids
        return ids

    def forget(self) -> None:
        """Memory that grows with the texts goes; workers are used again by other operators."""
        self.known, self.older, self.fits = {}, {}, {}

    def decode_bytes(self, ids: list[int]) -> bytes:
        """UTF-8 text of ids: control ids are silent, the dummy space goes, broken byte runs become U+FFFD."""
        raw = b"".join(map(self.piece_bytes.__getitem__, ids))
        first = next((i for i in ids if i not in (self.bos, self.eos)), None)
        if first is not None and first not in self.byte_id.values() and raw[:1] == b" ":
            raw = raw[1:]
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


@functools.lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                     keep_ids: bool = True) -> DataFrame:
    """Encode each whole text with begin and end ids, then decode the ids.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, ids (binary,
    little-endian unsigned 32-bit) and decoded. Null text is empty: two ids, decoded empty. Repeated
    rows and ids give a row each; a very long text is one value in its task. Texts are encoded where
    they lie; there is no shuffle, and each Python worker loads the model once and forgets the texts'
    segments at the end of a partition. ``model_path`` must be readable on every executor.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", ids binary, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        try:
            yield from encoded(c, batches)
        finally:
            c.forget()

    def encoded(c: PieceCodec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                cols: list[list] = [[], [], [], [], []]
                for text in part.column(1):
                    ids = c.encode_bytes(text.as_py())
                    decoded = c.decode_bytes(np.frombuffer(ids, "<u4").tolist())
                    row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
                    for col, v in zip(cols, (*row, ids, decoded) if keep_ids else row):
                        col.append(v)
                arrays = [part.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    arrays += [pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary()).cast(pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)
