"""What was added, removed or changed between consecutive full snapshots of a table.

A snapshot is a completed full job; its predecessor is the one before it, by start, with the same source signature.
Records of both are reduced to a key and a canonical hash and met in one full outer join: a missing side gives an
addition or a removal, unequal hashes give a change. Only keys and hashes are shuffled, never the records.

Edge cases: a null start sorts before all others, ties go by id; a job without rows is a snapshot (all records of its
predecessor are removed); the first snapshot of a signature has no cases; records with a null key take no part;
several rows of one record in a job count by the latest time (null earliest), ties by the highest id; null is a value;
text that is no JSON is compared as it stands; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sifthall.plans.stage import broadcast_if_small, stage

#: Leading and trailing white space of any kind, for trimming as text libraries do.
_ENDS = r"(?U)^[\s\u001c-\u001f]+|[\s\u001c-\u001f]+$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, _ENDS, "")


def row_hash(*columns: Column) -> Column:
    """A 96-bit hash of values in which null differs from every value."""
    parts = [x for c in columns for x in (c.isNull(), c)]
    return F.struct(F.xxhash64(*parts).alias("a"), F.hash(*parts).alias("b"))


def canonical_json(text: Column) -> Column:
    """JSON text in one notation: keys in order, no white space, escapes resolved, numbers without idle zeros.

    Text that is not JSON (or repeats a key) is returned as it stands."""
    parsed = F.to_json(F.try_parse_json(text))
    string = r'("(?:[^"\\]|\\.)*+")'
    shortened = F.regexp_replace(parsed, string + r"|(-?\d+\.\d*?[1-9])0+(?!\d)|(-?\d+)\.0+(?![\d.])", "$1$2$3")
    return F.coalesce(F.when(parsed.rlike(r"\d\.\d"), shortened).otherwise(parsed), text)


def consecutive(jobs: DataFrame) -> DataFrame:
    """(job_id, previous_job_id, next_job_id) of the completed full jobs."""
    order = Window.partitionBy("source_signature").orderBy(F.col("started_at").asc_nulls_first(), "id")
    full = jobs.where("mode = 'full' AND status = 'completed'")
    return full.select(F.col("id").alias("job_id"), F.lag("id").over(order).alias("previous_job_id"), F.lead("id").over(order).alias("next_job_id"))


def changes(records: DataFrame, jobs: DataFrame, key: list[str], value: list[Column], latest: list[Column], *, max_jobs: int = 50_000) -> DataFrame:
    """(job_id, *key, change_kind) of ``records``, which have ``job_id`` and ``key``.

    ``value`` is compared by hash; of several rows of a record in a job the one with the greatest ``latest`` counts."""
    chain = broadcast_if_small(consecutive(jobs), max_jobs)
    keyed = records.where(" AND ".join(f"`{k}` IS NOT NULL" for k in key)).select("job_id", *key, row_hash(*value).alias("value"), F.struct(*[x.alias(f"o{i}") for i, x in enumerate(latest)]).alias("latest"))
    one = keyed.join(chain, "job_id").groupBy("job_id", *key).agg(F.max_by("value", "latest").alias("value"), F.first("previous_job_id").alias("previous_job_id"), F.first("next_job_id").alias("next_job_id"))
    one = stage(one, "snapshot-rows", release=True)  # both sides of the join read it; keys and hashes only
    now = one.where("previous_job_id IS NOT NULL").select("job_id", *key, F.col("value").alias("now"))
    before = one.where("next_job_id IS NOT NULL").select(F.col("next_job_id").alias("job_id"), *key, F.col("value").alias("before"))
    both = now.join(before, ["job_id", *key], "full_outer")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("before"), "changed")
    return both.select("job_id", *key, kind.alias("change_kind")).where("change_kind IS NOT NULL")


def list_changes(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Changes of list entries, keyed by target and url: title (trimmed) and listed date are compared."""
    return changes(items, jobs, ["target_key", "url"], [trimmed(F.col("title")), F.col("listed_date")], [F.col("checked_at"), F.col("id")])


def document_changes(snapshots: DataFrame, jobs: DataFrame) -> DataFrame:
    """Changes of document records, keyed by document: the JSON values are compared."""
    return changes(snapshots, jobs, ["document_id"], [canonical_json(F.col("raw_json"))], [F.col("captured_at"), F.col("id")])


def found(items: DataFrame, snapshots: DataFrame, jobs: DataFrame) -> DataFrame:
    lists = list_changes(items, jobs).select(F.lit("scan_item_results").alias("record_table"), "job_id", "target_key", F.col("url").alias("record_key"), "change_kind")
    docs = document_changes(snapshots, jobs).select(F.lit("document_snapshots").alias("record_table"), "job_id", F.lit("").alias("target_key"), F.col("document_id").cast("string").alias("record_key"), "change_kind")
    return lists.unionByName(docs)
