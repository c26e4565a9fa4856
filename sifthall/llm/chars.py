"""Character tables and hashes shared by the text operators.

Texts are handled as arrays of code points, many documents at once, so that normalisation, counting and hashing
are table look-ups and prefix sums instead of per-character Python. A table has one entry per code point and is
built once per Python worker from the Unicode data of the interpreter.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (makes pa.compute available)

SIZE = 0x110000
#: Marks a code point whose normal form is not one code point, or that may combine with its neighbour.
SLOW = np.uint32(0xFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


#: What is not listed one by one are ideographs that stand for themselves, unassigned and private code points.
LISTED = (*range(0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200))
IDEOGRAPHS = slice(0x20000, 0x323B0)


def _invisible(ch: str, category: str) -> bool:
    o = ord(ch)
    return category == "Cf" or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0)


@cache
def line_table() -> np.ndarray:
    """Code point -> its compatibility form; 0 for white space, invisible characters and digits; SLOW where needed."""
    table = np.arange(SIZE, dtype=np.uint32)
    for o in LISTED:
        ch = chr(o)
        category = unicodedata.category(ch)
        if category in ("Cn", "Co", "Cs"):
            continue
        if ch.isspace() or category == "Cc" or _invisible(ch, category):
            table[o] = 0
            continue
        form = unicodedata.normalize("NFKC", ch)
        if len(form) != 1 or unicodedata.combining(ch):
            table[o] = SLOW
        elif form.isspace() or unicodedata.category(form) == "Nd":
            table[o] = 0
        else:
            table[o] = ord(form)
    table[0x1161:0x11A8] = SLOW  # jamo vowels and finals compose with what is before them
    table[0x11A8:0x1200] = SLOW
    return table


@cache
def letter_table() -> np.ndarray:
    """True for letters of any script, ideographs included."""
    table = np.zeros(SIZE, dtype=bool)
    table[IDEOGRAPHS] = True
    for o in LISTED:
        table[o] = unicodedata.category(chr(o))[0] == "L"
    return table


@cache
def fold_table() -> np.ndarray:
    """Code point -> lower-cased compatibility form if that is one letter or digit; 0 if dropped; SLOW where needed."""
    table = np.zeros(SIZE, dtype=np.uint32)
    table[IDEOGRAPHS] = np.arange(IDEOGRAPHS.start, IDEOGRAPHS.stop)
    for o in LISTED:
        ch = chr(o)
        category = unicodedata.category(ch)
        if category in ("Cn", "Co", "Cs", "Cc", "Cf"):
            continue
        if unicodedata.combining(ch) or 0x1161 <= o < 0x1200:
            table[o] = SLOW
            continue
        form = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", ch).lower())
        if len(form) == 1:
            table[o] = ord(form) if form.isalnum() else 0
        else:
            table[o] = SLOW if any(x.isalnum() for x in form) else 0
    return table


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing function (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.empty(size, dtype=np.uint64)
            p[0] = 1
            filled = 1
            with np.errstate(over="ignore"):
                while filled < size:
                    take = min(filled, size - filled)
                    p[filled : filled + take] = p[:take] * np.uint64(pow(base, filled, 1 << 64))
                    filled += take
            _POWERS[key] = p
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums of mixed symbols times powers of a base, for span_hashes; one longer than ``symbols``."""
    up, _ = _powers(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(symbols) * up[: len(symbols)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 63-bit hash of each span [start, end): equal spans have equal hashes wherever they stand."""
    _, down = _powers(len(sums))
    with np.errstate(over="ignore"):
        return (mix((sums[end] - sums[start]) * down[start]) >> np.uint64(1)).astype(np.int64)


def windows(symbols: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` symbols, in order; empty if there are fewer symbols."""
    n = len(symbols) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    sums = prefix_sums(symbols)
    _, down = _powers(len(sums))
    with np.errstate(over="ignore"):
        return (mix((sums[width:] - sums[:-width]) * down[:n]) >> np.uint64(1)).astype(np.int64)


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of values with together at most about ``limit`` bytes of text, as (first row, values).

    A single longer text is a run of its own, so memory follows the longest text, not the batch.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    i, n = 0, len(column)
    while i < n:
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield i, column.slice(i, j - i).to_pylist()
        i = j
