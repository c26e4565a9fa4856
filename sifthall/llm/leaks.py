"""Evaluation items that stand wholly or partly in documents, found through template windows.

Both sides become a stream of letters and digits (case, width and everything else dropped) and then a template
stream: a run of digits is one number symbol, a unit ideograph after it one unit symbol, a name one name symbol
(Latin names from the items' own capitalised words, ideographic names by the place or body suffix they precede).
Windows of template symbols are hash-joined. For each pair of document and item that shares a window, slots are
checked for consistency: a window that both have is consistent if each of its slots holds the same number, unit or name in both.
Pairs with a consistent window are held against each other character by character, and a run of at least ``least`` raw
characters is a leak; template matches without one, whose slots differ, are re-parameterised items.

Items are the stated query set. They are taken in blocks of ``BLOCK_ITEMS``, each held against all documents: the windows of a
block are the small side of the hash join, which every worker holds, so that documents are read once per block where they lie, and
nothing is shuffled. What a worker holds is bounded by the block, however many items there are.

No leak is lost: every raw run of ``least`` characters holds a whole window that does not depend on what surrounds
the run, and which is consistent; runs of an item for which that cannot be shown (made of little but numbers and names) are also joined by the
hash of the raw run itself.

Edge cases: null, empty and very long texts are fine (whole texts are read, one at a time if long); repeated rows
count once per id; no items or no documents give no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifthall.llm.chars import SLOW, chunks, codes, fold_table, prefix_sums, span_hashes, windows

BETWEEN, NUMBER, UNIT, NAME = 0xF0000, 0xF0001, 0xF0002, 0xF0003
UNITS = "年月日时分秒天周岁元角万亿个份次处人名户项条家枚行台件座米吨里亩度号层股届期页"
SUFFIXES = "省市区县镇乡村路街巷弄里坊浜苑桥河江湖山局院校社会组队所馆站厂仓闸口"
WIDTH, LEAST = 20, 60
#: Items of a block: some three million windows, 50 MB.
BLOCK_ITEMS = 10_000


def stream(text: str | None) -> np.ndarray:
    """Letters and digits of ``text``, lower-cased and in compatibility form, as code points."""
    if not text:
        return np.empty(0, dtype=np.uint32)
    out = fold_table()[codes(text)]
    if (out == SLOW).any():
        form = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).lower())
        raw = codes(form)
        out = fold_table()[raw]
        for i in np.flatnonzero(out == SLOW):
            out[i] = raw[i] if chr(raw[i]).isalnum() else 0
    return out[out != 0]


def streams(texts: list[str | None]) -> np.ndarray:
    """The streams of all texts one after another, each ended by BETWEEN."""
    held = [(t or "").replace("\0", " ") for t in texts]
    raw = codes("\0".join([*held, ""]))
    out = fold_table()[raw]
    slow = np.flatnonzero(out == SLOW)
    if len(slow):
        for k in np.unique(np.searchsorted(np.flatnonzero(raw == 0), slow)):
            held[k] = "".join(map(chr, stream(held[k])))
        raw = codes("\0".join([*held, ""]))
        out = fold_table()[raw]
        out = np.where(out == SLOW, raw, out)
    out = np.where(raw == 0, np.uint32(BETWEEN), out)
    return out[out != 0]


def names_of(texts: list[str]) -> list[str]:
    """Capitalised Latin words that do not begin a sentence, of four letters or more, lower-cased."""
    found = set()
    for text in texts:
        for m in re.finditer(r"(?<=[a-z,;:0-9] )[A-Z][A-Za-z'’-]{3,}", text or ""):
            name = "".join(map(chr, stream(m[0])))
            if len(name) >= 4:
                found.add(name)
    return sorted(found)


def _automaton(names: list[str]):
    a = ahocorasick.Automaton()
    for n in names:
        a.add_word(n, len(n))
    if names:
        a.make_automaton()
    return a


_IS_UNIT, _IS_SUFFIX = (np.array(sorted(map(ord, s)), dtype=np.uint32) for s in (UNITS, SUFFIXES))


def _among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def template(raw: np.ndarray, automaton) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, start of each symbol in ``raw``)."""
    n = len(raw)
    if not n:
        return raw, np.empty(0, dtype=np.int64)
    digit = (raw >= 48) & (raw <= 57)
    out = raw.copy()
    out[digit] = NUMBER
    keep = np.ones(n, dtype=bool)
    keep[1:] &= ~(digit[1:] & digit[:-1])
    unit = np.zeros(n, dtype=bool)
    unit[1:] = digit[:-1] & _among(raw[1:], _IS_UNIT)
    out[unit] = UNIT
    suffix = _among(raw, _IS_SUFFIX)
    ideograph = (raw >= 0x4E00) & (raw < 0xA000) & ~unit
    named = np.flatnonzero(suffix[2:] & ideograph[1:-1] & ideograph[:-2]) if n > 2 else np.empty(0, dtype=np.int64)
    out[named] = NAME
    out[named + 1] = NAME
    if len(automaton):
        for end, size in automaton.iter_long(raw.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")):
            out[end - size + 1] = NAME
            out[end - size + 2 : end + 1] = 0
    keep &= out != 0
    at = np.flatnonzero(keep)
    return out[at], at


class Index:
    """Windows of a block of items by their hash, and a filter of them in front, sixteen bits a window or more."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.values = hashes[order], values[order]
        self.bits = max(16, int(np.ceil(np.log2(16 * max(len(hashes), 1)))))
        self.filter = np.zeros(1 << (self.bits - 3), dtype=np.uint8)
        at = self._places(self.hashes)
        np.bitwise_or.at(self.filter, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.int64(7)) & np.int64((1 << self.bits) - 1)

    def met(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``hashes``, value) of all windows that are in the index."""
        at = self._places(hashes)
        hit = np.flatnonzero(self.filter[at >> 3] >> (at & 7).astype(np.uint8) & 1)
        low, high = (np.searchsorted(self.hashes, hashes[hit], side=side) for side in ("left", "right"))
        n = high - low
        return np.repeat(hit, n), self.values[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


class Block:
    """A block of items: their streams and templates one after another, and indexes of template windows and of the raw runs that
    no template window is sure to find."""

    def __init__(self, item_ids: list[int], texts: list[str], width: int, least: int):
        self.ids, self.names, self.width, self.least = np.array(item_ids, dtype=np.int64), names_of(texts), width, least
        automaton, longest = _automaton(self.names), max(map(len, self.names), default=3)
        self.raws = [stream(t) for t in texts]
        forms = [template(raw, automaton) for raw in self.raws]
        self.symbols = np.concatenate([f for f, _ in forms]) if forms else np.empty(0, dtype=np.uint32)
        self.slots = np.concatenate([slot_hashes(raw, at) for raw, (_, at) in zip(self.raws, forms, strict=True)]) if forms else np.empty(0, dtype=np.int64)
        self.ends = np.cumsum([len(f) for f, _ in forms])
        self.n_windows = np.array([max(len(f) - width + 1, 0) for f, _ in forms])
        keys = [windows(f, width) for f, _ in forms]
        starts = self.ends - np.array([len(f) for f, _ in forms]) if forms else self.ends
        self.templates = Index(np.concatenate(keys) if keys else np.empty(0, dtype=np.int64), np.concatenate([s + np.arange(len(k)) for s, k in zip(starts, keys, strict=True)]).astype(np.int64) if keys else np.empty(0, dtype=np.int64))
        dense = [np.unique(windows(raw, least)[~_sure(raw, at, longest, width, least)]) if len(raw) >= least else np.empty(0, dtype=np.int64) for raw, (_, at) in zip(self.raws, forms, strict=True)]
        self.dense = Index(np.concatenate(dense), np.repeat(np.arange(len(dense)), [len(d) for d in dense])) if any(map(len, dense)) else None

    def item_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")


def _sure(raw: np.ndarray, at: np.ndarray, longest: int, width: int, least: int) -> np.ndarray:
    """Of each run of ``least`` characters, whether a whole template window in it depends on nothing around it."""
    stops = np.append(at, len(raw))
    starts, ends = at[: len(at) - width + 1], stops[width:]
    p = np.arange(len(raw) - least + 1)
    if not len(starts):
        return np.zeros(len(p), dtype=bool)
    first = np.searchsorted(starts, p + longest)
    return (first < len(starts)) & (ends[np.minimum(first, len(ends) - 1)] <= p + least - longest)


def slot_hashes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of what each template symbol stands for."""
    return span_hashes(prefix_sums(raw), at, np.append(at[1:], len(raw))) if len(at) else np.empty(0, dtype=np.int64)


def longest_run(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Length of the longest common run of two streams, which have one of ``least``."""
    low, high = least, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if np.isin(windows(b, middle), windows(a, middle)).any():
            low = middle
        else:
            high = middle - 1
    return low


def slots_agree(symbols: np.ndarray, slots: np.ndarray, ends: np.ndarray, block: Block) -> dict[tuple[int, int], tuple[float, int, int, int]]:
    """(text, item) -> (share of the item's template windows that the text has, slots in them, slots that hold the same number, unit
    or name in both, windows of which all slots do), of all shared windows of many texts at once: ``symbols`` and ``slots`` of
    the texts one after another, which end at ``ends``."""
    here, there = block.templates.met(windows(symbols, block.width))
    if not len(here):
        return {}
    texts, items = np.searchsorted(ends, here), block.item_of(there)
    size, n_items = len(block.symbols), len(block.ids)
    keys, pair = np.unique(texts * n_items + items, return_inverse=True)
    whole, seen, same = np.ones(len(here), dtype=bool), [], []
    for k in range(block.width):
        slot = np.flatnonzero(block.symbols[there + k] >= NUMBER)
        equal = slots[here[slot] + k] == block.slots[there[slot] + k]
        whole[slot[~equal]] = False
        place = pair[slot] * size + there[slot] + k
        seen.append(np.unique(place))
        same.append(np.unique(place[equal]))
    count = lambda places: np.bincount(np.unique(places) // size, minlength=len(keys))
    n_windows, n_seen, n_same, n_whole = count(pair * size + there), count(np.concatenate(seen)), count(np.concatenate(same)), np.bincount(pair[whole], minlength=len(keys))
    covered = n_windows / np.maximum(block.n_windows[keys % n_items], 1)
    return {(k // n_items, k % n_items): x for k, x in zip(keys.tolist(), zip(covered.tolist(), n_seen.tolist(), n_same.tolist(), n_whole.tolist(), strict=True), strict=True)}


def _compare(block: Block) -> Callable:
    """(doc_id, item_id, run_length, covered, slots, slots_same) of documents with shared windows: whole batches are looked up at
    once, and only documents with a consistent window are compared character by character."""
    least = block.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(block.names)
        runs_of_item: dict[int, np.ndarray] = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, part in chunks(batch.column(1)):
                raw = streams(part)
                symbols, at = template(raw, automaton)
                raw_ends = np.flatnonzero(raw == BETWEEN)
                pairs = slots_agree(symbols, slot_hashes(raw, at), np.flatnonzero(symbols == BETWEEN), block)
                if block.dense:
                    places, items = block.dense.met(windows(raw, least))
                    for pair in set(zip(np.searchsorted(raw_ends, places).tolist(), items.tolist(), strict=True)):
                        pairs[pair] = (*pairs.get(pair, (0.0, 0, 0, 0))[:3], 1)
                out, last, own, runs = [], -1, raw[:0], np.empty(0, dtype=np.int64)
                for (k, item), (covered, slots, same, consistent) in sorted(pairs.items()):
                    length = 0
                    if consistent:
                        if k != last:
                            last, own = k, raw[raw_ends[k - 1] + 1 if k else 0 : raw_ends[k]]
                            runs = np.sort(windows(own, least))
                        if item not in runs_of_item:
                            runs_of_item[item] = windows(block.raws[item], least)
                        theirs = runs_of_item[item]
                        if len(runs) and len(theirs) and (runs[np.minimum(np.searchsorted(runs, theirs), len(runs) - 1)] == theirs).any():
                            length = longest_run(own, block.raws[item], least)
                    out.append((ids[first + k], int(block.ids[item]), length, covered, slots, same))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else ((),) * 6, kinds, strict=True)], names=["doc_id", "item_id", "run_length", "covered", "slots", "slots_same"])

    return run


_PAIRS = "doc_id bigint, item_id bigint, run_length bigint, covered double, slots bigint, slots_same bigint"


def candidates(docs: DataFrame, items: DataFrame, *, width: int = WIDTH, least: int = LEAST, max_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, run_length, covered, slots, slots_same) of documents and ``items``, a block of the stated query set, that share a
    window. The block is read to the driver behind a check of its size."""
    held = items.select(F.col("item_id").cast("bigint").alias("item_id"), "item_text").where("item_text <> ''").limit(max_items + 1).collect()
    if len(held) > max_items:
        raise ValueError(f"more than {max_items} items: give them in blocks")
    block = Block([r.item_id for r in held], [r.item_text for r in held], width, least)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    return texts.mapInArrow(_compare(block), _PAIRS)


def compare(docs: DataFrame, items: DataFrame, *, width: int = WIDTH, least: int = LEAST, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, run_length, covered, slots, slots_same) of each pair that shares a template window; run_length
    is 0 if the longest common raw run is shorter than ``least``."""
    n = items.count()
    blocks = 1 if n <= block_items else -(-2 * n // block_items)  # half full on average, so that none is too full
    out: DataFrame | None = None
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64(F.col("item_id").cast("bigint")), F.lit(blocks)) == block)
        met = candidates(docs, part, width=width, least=least, max_items=max(block_items, 1))
        out = met if out is None else out.unionByName(met)
    return out


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    return compare(docs, items).where("run_length > 0").select("doc_id", "item_id").distinct()


def reparameterised(docs: DataFrame, items: DataFrame, *, least_covered: float = 0.5, least_slots: int = 1) -> DataFrame:
    """Documents that hold at least ``least_covered`` of an item's template, but with other numbers or names in its slots:
    (doc_id, item_id, slots, slots_same)."""
    pairs = compare(docs, items).distinct()
    return pairs.where((F.col("run_length") == 0) & (F.col("covered") >= least_covered) & (F.col("slots") >= least_slots) & (F.col("slots_same") < F.col("slots"))).select("doc_id", "item_id", "slots", "slots_same")
