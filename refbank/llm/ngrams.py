"""Vectorised character n-gram streams shared by the scoring operators.

A text becomes a stream of small integer symbols.  A *word* is a maximal run
of letters and digits; everything else is one boundary symbol (0).  N-grams
never reach across a boundary: context positions before the word's first
letter read as 0, and the boundary after a word's last letter is an event of
its own, so word ends count.

Texts are processed in pieces of at most ``PIECE`` characters cut at word
boundaries; memory per task is bounded by the piece, not by a document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

PIECE = 1 << 20
SYMBOLS = 64  # boundary, a-z, digit, 36 classes for other letters
BITS = 6


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """BMP code point -> symbol of the 64-letter alphabet, without case."""
    t = np.zeros(65536, np.uint32)
    for cp in range(65536):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        if ch.isdigit():
            t[cp] = 27
        elif ch.isalpha():
            low = ch.lower()[0]
            t[cp] = ord(low) - 96 if "a" <= low <= "z" else 28 + ord(low) % 36
    return t


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """BMP code point -> lower-case code point of a letter, 0 for anything else."""
    t = np.zeros(65536, np.uint32)
    for cp in range(65536):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()
            t[cp] = ord(low[0])
    return t


def cut(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of at most ``size`` characters, cut after white
    space where a piece holds any (else at the size)."""
    start, n = 0, len(text)
    while n - start > size:
        end = max(text.rfind(" ", start, start + size), text.rfind("\n", start, start + size))
        end = end + 1 if end >= start else start + size
        yield text[start:end]
        start = end
    yield text[start:]


def batches(texts: Iterable[str | None], size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, document index per piece, piece offsets) of runs of
    pieces.  Every piece is followed by one newline, so pieces never touch."""
    buf: list[str] = []
    docs: list[int] = []
    held = 0

    def flush():
        cps = np.frombuffer("\n".join([*buf, ""]).encode("utf-32-le", "replace"), np.uint32)
        lens = np.fromiter((len(b) + 1 for b in buf), np.int64, len(buf))
        return cps, np.array(docs, np.int64), np.concatenate(([0], np.cumsum(lens)))

    for i, text in enumerate(texts):
        for piece in cut(text or "", size):
            buf.append(piece)
            docs.append(i)
            held += len(piece) + 1
            if held >= size:
                yield flush()
                buf, docs, held = [], [], 0
    if buf:
        yield flush()


def _astral_letters(cps: np.ndarray) -> np.ndarray:
    """Which of some code points above 65535 are letters."""
    kinds, at = np.unique(cps, return_inverse=True)
    return np.array([chr(c).isalpha() for c in kinds.tolist()], bool)[at]


def symbols(cps: np.ndarray) -> np.ndarray:
    """Symbols of code points in the 64-letter alphabet (emoji and other signs
    are boundaries)."""
    out = symbol_table()[np.minimum(cps, 65535)]
    astral = cps > 65535
    if astral.any():
        far = cps[astral]
        out[astral] = np.where(_astral_letters(far), 28 + far % 36, 0)
    return out


def lowered(cps: np.ndarray) -> np.ndarray:
    """Lower-case letters, 0 at boundaries (letters above 65535 stay as they are)."""
    out = letter_table()[np.minimum(cps, 65535)]
    astral = cps > 65535
    if astral.any():
        far = cps[astral]
        out[astral] = np.where(_astral_letters(far), far, 0)
    return out


def in_word(syms: np.ndarray) -> np.ndarray:
    """Symbols since the last boundary (0 at a word's first letter; at a
    boundary, the length of the word it ends)."""
    idx = np.arange(len(syms), dtype=np.int32)
    last = np.maximum.accumulate(np.where(syms == 0, idx, np.int32(-1)))
    prev = np.empty_like(last)
    prev[0] = -1
    prev[1:] = last[:-1]
    return idx - prev - 1


def packed(syms: np.ndarray, depth: np.ndarray, order: int) -> np.ndarray:
    """N-gram codes ending at each position, newest symbol in the low bits;
    context beyond the word's start reads as boundary."""
    s = syms.astype(np.uint32)
    code = s.copy()
    for k in range(1, order):
        lag = np.zeros_like(s)
        if k < len(s):
            lag[k:] = s[:-k]
        code |= np.where(depth >= k, lag, np.uint32(0)) << np.uint32(BITS * k)
    return code


def events(syms: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Mask of positions that count: letters, and the boundary after a word."""
    return (syms > 0) | (depth > 0)
