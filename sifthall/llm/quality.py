"""Per-document text statistics and fixed-threshold rules that tell prose from lists, tables and junk.

All counts are prefix sums over the code points of many documents at once. The rules are of the kind that is published for web
corpora: one threshold on one statistic each (``RULES``). Every rule is looked at for every document, and every rule that it
fails is recorded by name; no rule waits for another. Rules of form decide (``DECISIVE``): failing one of them is enough. Rules of
length (few words, unusual word length) are recorded only, since a short text may be prose.

A line is prose if its common words reach a share of its words (Latin words and single ideographs; the shares differ by
script), it is not made of marks and digits, and it either has a sentence end or is long. A document fails ``little_prose`` if
prose lines hold less than half of its characters other than white space: that is a list or a table within one line, which
has no lines to be counted.

Edge cases: null, empty and blank texts have null shares and no reasons; texts of any length are read whole; no common
words given means that none counts, so that ``few_common_words`` and ``little_prose`` fail every text; repeated ids give
repeated rows; further columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifthall.llm.chars import LISTED, SIZE, chunks, codes, prefix_sums, span_hashes, windows

# Marks that end a sentence, closing marks that may follow them, signs that begin a list item.
ENDS = "。！？!?….．"
CLOSERS = "”’\"')）」』】]》"
BULLETS = "•●○◦■□◆◇▪▫–—-*·>＞|"
#: Share of a line's words that must be common words, by script; published rules for prose ask for a floor of this kind.
LATIN_COMMON, IDEOGRAPH_COMMON = 0.15, 0.05
MARKS_AND_DIGITS = 0.45
PROSE_SHARE, LONG_LINE, REPEAT_RUN = 0.5, 80, 8
# The rules by the name of the reason, as the least or greatest value that passes.
LEAST_LINE_ENDS, MOST_BULLETS, MOST_SYMBOLS, MOST_DIGITS, LEAST_COMMON, MOST_REPEATED = 0.12, 0.9, 0.2, 0.2, 0.05, 0.5
LEAST_WORDS, WORD_LENGTHS = 20, (3.0, 10.0)
#: Failing one of these makes a list, a table or junk.
DECISIVE = ("few_line_ends", "bullets", "symbols", "digits", "few_common_words", "repeated", "little_prose")
RULES = (*DECISIVE, "few_words", "word_length")
SCHEMA = "doc_id bigint, n_chars bigint, n_words bigint, mean_word_length double, symbol_ratio double, digit_ratio double, n_lines bigint, end_line_share double, bullet_line_share double, common_word_share double, prose_share double, repeated_share double, reasons array<string>"

SPACE, LATIN, IDEOGRAPH, DIGIT, OTHER_LETTER, SYMBOL = range(6)


@cache
def _classes() -> np.ndarray:
    table = np.full(SIZE, SYMBOL, dtype=np.uint8)
    table[0x20000:0x323B0] = IDEOGRAPH
    for o in LISTED:
        ch = chr(o)
        category = unicodedata.category(ch)
        if ch.isspace() or category in ("Cf", "Cc"):
            table[o] = SPACE
        elif 0x4E00 <= o < 0xA000 or 0x3400 <= o < 0x4DC0 or 0xF900 <= o < 0xFB00:
            table[o] = IDEOGRAPH
        elif category[0] == "L" or category[0] == "M":
            table[o] = LATIN if o < 0x250 or 0xFF21 <= o <= 0xFF5A else OTHER_LETTER
        elif category[0] == "N":
            table[o] = DIGIT
    return table


@cache
def _lower() -> np.ndarray:
    table = np.arange(SIZE, dtype=np.uint32)
    for o in LISTED:
        low = unicodedata.normalize("NFKC", chr(o)).lower()
        if len(low) == 1:
            table[o] = ord(low)
    return table


def _member(values: str) -> np.ndarray:
    out = np.zeros(SIZE, dtype=bool)
    out[[ord(x) for x in values]] = True
    return out


def _isin(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(x), dtype=bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


class Common:
    """Look-ups for the common words: hashes of words of letters, which count as whole words, single ideographs, and hashes of
    longer runs with ideographs by their length, which count wherever they stand."""

    def __init__(self, words: list[str]):
        forms = [_lower()[codes(w)] for w in words if w]
        lettered = [f for f in forms if (_classes()[f] == LATIN).all()]
        others = [f for f in forms if not (_classes()[f] == LATIN).all()]
        self.latin = np.sort(np.concatenate([windows(f, len(f)) for f in lettered])) if lettered else np.empty(0, dtype=np.int64)
        self.single = np.array(sorted(int(f[0]) for f in others if len(f) == 1), dtype=np.int64)
        self.runs = {n: np.sort(np.concatenate([windows(f, n) for f in others if len(f) == n])) for n in sorted({len(f) for f in others}) if n > 1}


def statistics(texts: list[str | None], common: Common) -> list[tuple]:
    """Rows after the id, of SCHEMA."""
    raw = codes("\n".join([*((t or "").replace("\r", "\n") for t in texts), ""]))
    kind = _classes()[raw]
    n = len(raw)
    newline = raw == 10
    stop = np.flatnonzero(newline)
    start = np.concatenate(([0], stop[:-1] + 1))
    breaks = np.array([(t or "").count("\n") + (t or "").count("\r") + 1 for t in texts])
    line_doc = np.repeat(np.arange(len(texts)), breaks)
    sums = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    per_line = lambda mask: (c := sums(mask))[stop] - c[start]
    solid = kind != SPACE
    chars = per_line(solid)
    # Latin words
    latin = kind == LATIN
    edge = np.diff(np.concatenate(([0], latin.astype(np.int8), [0])))
    w0, w1 = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    is_common = _isin(span_hashes(prefix_sums(_lower()[raw]), w0, w1), common.latin) if len(w0) else np.zeros(0, dtype=bool)
    word_at, common_at = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    word_at[w0] = True
    common_at[w0[is_common]] = True
    # ideographs: those in a common run or common by themselves
    low = _lower()[raw]
    run_at = np.zeros(n, dtype=bool)
    for size, hashes in common.runs.items():
        hit = np.flatnonzero(_isin(windows(low, size), hashes))
        for k in range(size):
            run_at[hit + k] = True
    han = kind == IDEOGRAPH
    han_common = han & (run_at | _isin(raw.astype(np.int64), common.single))
    lw, lc, hw, hc = per_line(word_at), per_line(common_at), per_line(han), per_line(han_common)
    other = per_line(kind == OTHER_LETTER)
    # sentence ends: a full stop counts if white space or the line's end follows
    ends = _member(ENDS)[raw]
    after = np.concatenate((kind[1:], [SPACE])) == SPACE
    ends &= (raw != 46) | after
    numbered = np.zeros(n, dtype=bool)  # the full stop of an item's number
    numbered[1:-1] = (raw[1:-1] == 46) & (kind[:-2] == DIGIT) & (raw[2:] != 10)
    ends &= ~numbered
    marks = per_line(ends)
    # the last and first character of a line that is not white space
    at = np.where(solid, np.arange(n), -1)
    last = np.maximum.accumulate(at)[np.maximum(stop - 1, 0)]
    closing = _member(CLOSERS)[raw]
    inner = np.maximum.accumulate(np.where(solid & ~closing, np.arange(n), -1))[np.maximum(stop - 1, 0)]
    has = chars > 0
    ended = has & (inner >= start) & ends[np.maximum(inner, 0)] & (last >= start)
    following = np.minimum.accumulate(np.where(solid, np.arange(n), n)[::-1])[::-1]
    first = np.minimum(following[start], n - 1)
    bullet = has & _member(BULLETS)[raw[first]]
    wordy = (lc / LATIN_COMMON + hc / IDEOGRAPH_COMMON >= lw + hw + other) & (lw + hw > 0)
    clean = per_line((kind == SYMBOL) | (kind == DIGIT)) <= MARKS_AND_DIGITS * chars
    prose = wordy & clean & ((marks > 0) | (chars >= LONG_LINE))
    by_doc = lambda x: np.bincount(line_doc, weights=x, minlength=len(texts))
    # repeated runs, over the text without white space
    symbols = raw[solid]
    solid_doc = np.repeat(line_doc, stop - start + 1)[: n][solid]
    runs = windows(symbols, REPEAT_RUN)
    inside = solid_doc[: len(runs)] == solid_doc[REPEAT_RUN - 1 :] if len(runs) else np.zeros(0, dtype=bool)
    keyed = np.sort(solid_doc[: len(runs)][inside].astype(np.int64) << 42 | (runs[inside] & ((1 << 42) - 1)))
    total_runs = np.bincount(keyed >> 42, minlength=len(texts))
    distinct = np.bincount(keyed[np.concatenate(([True], keyed[1:] != keyed[:-1]))] >> 42, minlength=len(texts)) if len(keyed) else np.zeros(len(texts))
    n_solid, words = by_doc(chars), by_doc(lw + hw)
    stats = {
        "lines": by_doc(has), "ended": by_doc(ended), "bullets": by_doc(bullet), "common": by_doc(lc + hc), "prose": by_doc(np.where(prose, chars, 0)),
        "latin_letters": by_doc(per_line(latin)), "latin_words": by_doc(lw), "symbols": by_doc(per_line(kind == SYMBOL)), "digits": by_doc(per_line(kind == DIGIT)),
    }
    rows = []
    for k, text in enumerate(texts):
        size = len(text or "")
        if not n_solid[k]:
            rows.append((size, 0, None, None, None, 0, None, None, None, None, None, []))
            continue
        s = {name: float(v[k]) for name, v in stats.items()} | {"size": float(n_solid[k]), "words": float(words[k])}
        repeated = float(1 - distinct[k] / total_runs[k]) if total_runs[k] else 0.0
        share = s["prose"] / s["size"]
        length = s["latin_letters"] / s["latin_words"] if s["latin_words"] else None
        failed = (
            s["lines"] > 1 and s["ended"] < LEAST_LINE_ENDS * s["lines"], s["lines"] > 1 and s["bullets"] > MOST_BULLETS * s["lines"], s["symbols"] > MOST_SYMBOLS * s["size"], s["digits"] > MOST_DIGITS * s["size"],
            s["common"] < LEAST_COMMON * s["words"] or not s["words"], repeated > MOST_REPEATED, share < PROSE_SHARE, s["words"] < LEAST_WORDS,
            2 * s["latin_words"] > s["words"] and not WORD_LENGTHS[0] <= length <= WORD_LENGTHS[1],
        )
        reasons = [name for name, fails in zip(RULES, failed, strict=True) if fails]
        rows.append((size, int(words[k]), length, s["symbols"] / s["size"], s["digits"] / s["size"], int(s["lines"]), s["ended"] / s["lines"], s["bullets"] / s["lines"], s["common"] / s["words"] if s["words"] else 0.0, share, repeated, reasons))
    return rows


def _run(words: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = Common(words)
        kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.int64(), *[pa.float64()] * 5, pa.list_(pa.string())]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for at, texts in chunks(batch.column(1)):
                columns = zip(*statistics(texts, common), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    return run


def described(docs: DataFrame, common_words: DataFrame, max_words: int = 100_000) -> DataFrame:
    """SCHEMA, one row per row of ``docs``. ``common_words`` is a reference list, read behind a check of its size."""
    words = [r.word for r in common_words.select("word").where("word is not null").distinct().limit(max_words + 1).collect()]
    if len(words) > max_words:
        raise ValueError(f"more than {max_words} common words")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_run(sorted(words)), SCHEMA)


def found(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """Documents that are for the most part lists, tables or junk: those that fail a decisive rule."""
    decides = F.arrays_overlap("reasons", F.array(*[F.lit(x) for x in DECISIVE]))
    return described(docs, common_words).where(decides).select("doc_id").distinct()
