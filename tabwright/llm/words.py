"""Words and word shingles of whole texts, for use inside tasks."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from tabwright.llm.memory import Remembered

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs without white space, as UTF-8; ``lower`` lower-cases A-Z only."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return WORD.findall(raw.lower() if lower else raw)


def shingles(ws: list[bytes], width: int) -> list[bytes]:
    """Space-joined runs of ``width`` words with repeats; fewer words: the whole sequence; none: nothing."""
    if len(ws) < width:
        return [b" ".join(ws)] if ws else []
    return list(map(b" ".join, zip(*(ws[i:] for i in range(width)))))


class WordHashes(Remembered):
    """Word -> 64-bit hash, remembered within a task up to a bound."""

    def __init__(self):
        super().__init__(xxhash.xxh64_intdigest)


def shingle_hashes(ws: list[bytes], width: int, known: dict) -> np.ndarray:
    """One hash per shingle of ``width`` words; fewer words: one for the whole sequence."""
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    w = min(width, len(ws))
    out = np.full(len(ws) - w + 1, w, np.uint64)
    for i in range(w):
        out = (out * _MIX[1]) ^ (h[i : len(ws) - w + 1 + i] + _MIX[0])
        out ^= out >> np.uint64(29)
    out *= _MIX[2]
    return out ^ (out >> np.uint64(32))
