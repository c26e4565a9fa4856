"""Lines that one source repeats across its documents, found incrementally and taken out.

The state is a set of written tables: the places of each line (one part per delta), the number of documents per (source, line) and
per source, the lines at or over the threshold, and of each document the lines to take out. ``merge`` folds a delta of new
documents into it: only the delta's text is read, counts are merged as deltas, crossings of the threshold are detected in both
directions (a source that grows can bring a line below its share again), and what is to be taken out is worked out again for new
documents and those that hold a line that crossed, and kept for all others. ``save`` and ``load`` let another application go
on from there.

Two lines are the same if they differ only in white space, invisible characters, compatibility forms or digits.
A line counts once per document; lines without a letter take no part.

Edge cases: null and empty texts count as documents of their source and have no lines; a null source is a source of
its own; rows repeated within a delta count as rows; an empty delta changes nothing; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifthall.llm.chars import SLOW, chunks, codes, letter_table, line_table, prefix_sums, span_hashes
from sifthall.plans.merge import VersionedTable
from sifthall.plans.stage import fresh_path

PLACES = "source string, document_id bigint, line_no bigint, line_key bigint, first_in_document boolean"


def line_keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines with a letter: index of the text, number of the line from 1, key, whether first of its key in the text."""
    import unicodedata

    table, letters = line_table(), letter_table()
    parts, owners = [], []
    for k, text in enumerate(texts):
        if not text:
            continue
        raw = codes(text + "\n")
        shaped = table[raw]
        if (shaped == SLOW).any():
            raw = codes(unicodedata.normalize("NFKC", text) + "\n")
            shaped = table[raw]
            again = shaped == SLOW
            shaped[again] = raw[again]
        shaped[raw == 10] = SLOW
        parts.append(shaped)
        owners.append(k)
    none = np.empty(0, dtype=np.int64)
    if not parts:
        return none, none, none, none.astype(bool)
    lengths = np.array([len(p) for p in parts])
    whole = np.concatenate(parts)
    ends = np.flatnonzero(whole == SLOW)
    owner_of_part = np.searchsorted(np.cumsum(lengths), ends, side="right")
    per_part = np.bincount(owner_of_part, minlength=len(parts))
    line_no = np.arange(len(ends)) - np.repeat(np.cumsum(per_part) - per_part, per_part) + 1
    kept = (whole != 0) & (whole != SLOW)
    position = np.concatenate(([0], np.cumsum(kept)))
    stop = position[ends]
    start = np.concatenate(([0], stop[:-1]))
    symbols = whole[kept]
    has_letter = np.concatenate(([0], np.cumsum(letters[symbols])))
    use = has_letter[stop] > has_letter[start]
    keys = span_hashes(prefix_sums(symbols), start, stop)[use]
    owner = np.array(owners)[owner_of_part[use]]
    first = np.zeros(len(keys), dtype=bool)
    if len(keys):
        order = np.lexsort((line_no[use], keys, owner))
        o, h = owner[order], keys[order]
        first[order] = np.concatenate(([True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])))
    return owner, line_no[use].astype(np.int64), keys, first


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sources = batch.column("document_id"), batch.column("source")
        for at, texts in chunks(batch.column("text")):
            owner, line_no, keys, first = line_keys(texts)
            take = pa.array(owner + at)
            yield pa.RecordBatch.from_arrays([sources.take(take), ids.take(take), pa.array(line_no), pa.array(keys), pa.array(first)], names=["source", "document_id", "line_no", "line_key", "first_in_document"])


def as_source(column: str) -> F.Column:
    """A source's name as a key that is never null: null is a source of its own."""
    return F.when(F.col(column).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(column)))


SCHEMAS = {
    "places": PLACES, "counts": "source string, line_key bigint, n bigint", "sources": "source string, n_source bigint", "repeated": "source string, line_key bigint",
    "changed": "source string, line_key bigint", "dropped": "document_id bigint, line_no bigint",
}
#: Repeated lines of which each worker can hold the keys; more are taken out by a join.
HELD_LINES = 1_000_000


@dataclass(frozen=True)
class LineState:
    """Tables after some deltas, by the paths of their parts. ``changed`` holds the lines that crossed the threshold in the last
    merge, ``dropped`` the lines to be taken out of each document."""

    spark: SparkSession
    paths: dict[str, tuple[str, ...]]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(*self.paths[name])


def save(state: LineState, folder: str) -> None:
    """Make ``state``, whose tables lie in ``folder``, the one that ``load`` opens; readers see the old or the new one."""
    rows = [(name, at, path) for name, paths in state.paths.items() for at, path in enumerate(paths)]
    VersionedTable(state.spark, f"{folder}/head").write(state.spark.createDataFrame(rows, "name string, at int, path string").coalesce(1))


def load(spark: SparkSession, folder: str) -> LineState | None:
    """The state saved in ``folder``, if there is one."""
    head = VersionedTable(spark, f"{folder}/head").read()
    if head is None:
        return None
    rows = sorted((r["name"], r["at"], r["path"]) for r in head.collect())  # one row per table and delta
    return LineState(spark, {name: tuple(path for n, _, path in rows if n == name) for name in SCHEMAS})


def merge(state: LineState | None, delta: DataFrame, *, document: str = "id", source: str = "source_site", text: str = "body_text", least: int = 5, share: tuple[int, int] = (1, 4), folder: str | None = None) -> LineState:
    """The state after ``delta``: new documents only. A line is repeated within its source if it stands in at least
    ``least`` documents and in at least ``share`` (a fraction) of all documents of the source. Tables are written to ``folder``,
    or among those staged for this application."""
    spark = delta.sparkSession
    paths: dict[str, tuple[str, ...]] = {}

    def kept(name: str, df: DataFrame) -> DataFrame:
        path = f"{folder}/{name}-{uuid.uuid4().hex}" if folder else fresh_path(spark, name)
        df.write.parquet(path)
        paths[name] = (path,)
        return spark.read.schema(SCHEMAS[name]).parquet(path)

    docs = delta.select(as_source(source).alias("source"), F.col(document).cast("bigint").alias("document_id"), F.col(text).alias("text"))
    new = kept("places", docs.where("text <> ''").mapInArrow(_places, PLACES))
    counts = new.where("first_in_document").groupBy("source", "line_key").agg(F.count(F.lit(1)).alias("n"))
    sources = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_source"))
    if state is not None:
        counts = state.counts.unionByName(counts).groupBy("source", "line_key").agg(F.sum("n").alias("n"))
        sources = state.sources.unionByName(sources).groupBy("source").agg(F.sum("n_source").alias("n_source"))
    counts, sources = kept("counts", counts), kept("sources", sources)
    up, down = share
    repeated = kept("repeated", counts.where(F.col("n") >= least).join(sources, "source").where(F.col("n") * down >= F.col("n_source") * up).select("source", "line_key"))
    line = ["source", "line_key"]
    if state is None:
        paths["changed"] = paths["repeated"]
        kept("dropped", new.join(repeated, line, "left_semi").select("document_id", "line_no").distinct())
        return LineState(spark, paths)
    kept("changed", repeated.join(state.repeated, line, "left_anti").unionByName(state.repeated.join(repeated, line, "left_anti")))
    paths["places"] = state.paths["places"] + paths["places"]
    after = LineState(spark, paths)
    rebuild = documents_to_rebuild(after)
    again = state.places.join(rebuild, "document_id", "left_semi").unionByName(new).join(repeated, line, "left_semi").select("document_id", "line_no").distinct()
    kept("dropped", state.dropped.join(rebuild, "document_id", "left_anti").unionByName(again).distinct())
    return after


def repeated_places(state: LineState) -> DataFrame:
    """(document_id, line_no) of every occurrence of a repeated line."""
    return state.dropped


def documents_to_rebuild(state: LineState) -> DataFrame:
    """Ids of the documents that hold a line that crossed the threshold in the last merge."""
    return state.places.join(state.changed, ["source", "line_key"], "left_semi").select("document_id").distinct()


def without_lines(docs: DataFrame, places: DataFrame, *, document: str = "id", text: str = "body_text") -> DataFrame:
    """``docs`` with the lines at ``places`` taken out of ``text``; other documents pass unchanged. Ids must be unique."""
    drop = places.groupBy(F.col("document_id").alias("__document")).agg(F.collect_set("line_no").alias("__drop"))
    joined = docs.join(drop, F.col(document) == F.col("__document"), "left")
    kept = F.expr(f"array_join(filter(split(`{text}`, '\\n', -1), (x, i) -> not array_contains(__drop, cast(i + 1 as bigint))), '\\n')")
    return joined.withColumn(text, F.when(F.col("__drop").isNull(), F.col(text)).otherwise(kept)).drop("__document", "__drop")


def _cleaning(repeated: dict[str, np.ndarray]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column("source").to_pylist()
            for at, texts in chunks(batch.column("text")):
                owner, line_no, keys, _ = line_keys(texts)
                drop: dict[int, set[int]] = {}
                for k in np.unique(owner).tolist():
                    mine, own = repeated.get(sources[at + k]), owner == k
                    if mine is not None and len(hit := line_no[own][np.isin(keys[own], mine)]):
                        drop[k] = set(hit.tolist())
                out = ["\n".join(x for i, x in enumerate(t.split("\n"), 1) if i not in drop[k]) if k in drop else t for k, t in enumerate(texts)]
                yield pa.RecordBatch.from_arrays([batch.column("document_id").slice(at, len(texts)), pa.array(out, pa.string())], names=["document_id", "text"])

    return work


def cleaned(docs: DataFrame, state: LineState, *, document: str = "id", source: str = "source_site", text: str = "body_text") -> DataFrame:
    """(document, text) of every row of ``docs`` without the lines that its source repeats, where the texts lie: each worker holds
    the keys of the repeated lines, of which a source has no more than its documents have lines on average, over the share.
    Beyond ``HELD_LINES`` of them the lines to be taken out are joined instead."""
    held = state.repeated.limit(HELD_LINES + 1).collect()
    if len(held) > HELD_LINES:
        return without_lines(docs, state.dropped, document=document, text=text).select(document, text)
    keys: dict[str, list[int]] = {}
    for r in held:
        keys.setdefault(r["source"], []).append(r["line_key"])
    rows = docs.select(F.col(document).cast("bigint").alias("document_id"), as_source(source).alias("source"), F.col(text).cast("string").alias("text"))
    done = rows.mapInArrow(_cleaning({k: np.array(v, dtype=np.int64) for k, v in keys.items()}), "document_id bigint, text string")
    return done.select(F.col("document_id").alias(document), F.col("text").alias(text))


def deltas(docs: DataFrame, time: str = "first_seen_at", parts: int = 2) -> list[DataFrame]:
    """``docs`` in order of arrival, in ``parts`` deltas of about equal size; together they are all rows."""
    cuts = docs.agg(F.percentile_approx(time, [k / parts for k in range(1, parts)], 1000).alias("cuts")).first()["cuts"] or []
    out, low = [], None
    for cut in [*cuts, None]:
        part = docs
        if low is not None:
            part = part.where(F.col(time) > F.lit(low))
        if cut is not None:
            part = part.where((F.col(time) <= F.lit(cut)) | F.col(time).isNull()) if low is None else part.where(F.col(time) <= F.lit(cut))
        out.append(part)
        low = cut
    return out


def state_of(docs: DataFrame) -> LineState:
    """The state after ``docs``, merged in the deltas in which they arrived."""
    state = None
    for delta in deltas(docs):
        state = merge(state, delta)
    return state


def found(docs: DataFrame) -> DataFrame:
    return repeated_places(state_of(docs))
