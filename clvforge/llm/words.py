"""Texts in pieces of bounded size, and sorted keys to look n-grams up."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from clvforge.llm.common import ASCII_SPACE

_SPACES = [c.encode() for c in ASCII_SPACE]


class Part(NamedTuple):
    """A text or a part of one; ``more_before`` and ``more_after`` tell whether the text goes on."""

    doc: int
    text: bytes
    more_before: bool = False
    more_after: bool = False


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column, null as empty."""
    return [x.as_py() or b"" for x in column.cast(pa.binary())]


def _back(text: bytes, low: int, high: int, words: int) -> int:
    """The start of the last ``words`` words of text[low:high]."""
    at = high
    for _ in range(words):
        at = low + len(text[low:at].rstrip())
        at = max(text.rfind(s, low, at) for s in _SPACES) + 1
        if at <= low:
            return low
    return at


def in_pieces(texts: list[bytes], size: int = 1 << 19, overlap: int = 0) -> Iterator[list[Part]]:
    """Lists of texts of about ``size`` bytes. A longer text is cut after ASCII white space, each part but the
    first beginning with the last ``overlap`` words before it; a run without white space is never cut."""
    parts, held = [], 0
    for doc, text in enumerate(texts):
        lo, first = 0, True
        while lo < len(text) or first:
            hi = len(text)
            if hi - lo > size:
                hi = max(text.rfind(s, lo, lo + size) for s in _SPACES) + 1
                if hi <= lo:
                    hi = min((x for x in (text.find(s, lo + size) for s in _SPACES) if x >= 0), default=len(text) - 1) + 1
            again = hi
            while overlap and hi < len(text) and (again := _back(text, lo, hi, overlap)) <= lo:  # too few words to go on from
                hi = min((x for x in (text.find(s, hi) for s in _SPACES) if x >= 0), default=len(text) - 1) + 1
            if held and held + hi - lo > size:
                yield parts
                parts, held = [], 0
            parts.append(Part(doc, text[lo:hi], not first, hi < len(text)))
            held, first = held + hi - lo, False
            lo = again if overlap and hi < len(text) else hi
    if parts:
        yield parts


class KeyLookup:
    """Sorted 64-bit keys and where they stand."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys.astype(np.uint64))
        self.may = np.zeros(1 << 21, bool)  # most keys that are asked for are not there
        self.may[(self.keys >> np.uint64(43)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is not known."""
        out = np.full(len(keys), -1)
        may = np.flatnonzero(self.may[(keys >> np.uint64(43)).astype(np.int64)])
        if len(may) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys[may]), len(self.keys) - 1)
            out[may] = np.where(self.keys[at] == keys[may], at, -1)
        return out
