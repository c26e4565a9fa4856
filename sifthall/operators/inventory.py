"""Inventories of list entries over time, resolution of names by priority, and joins by position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifthall.operators.relational import SMALL
from sifthall.plans.stage import broadcast_if_small


def state(items: DataFrame, full_jobs: DataFrame) -> DataFrame:
    """(target_key, url, first_job_id, last_job_id, is_present): an entry is present if the newest full job that listed
    anything of its target listed it; entries of targets without a full job count as present. History is kept."""
    rows = items.where("url IS NOT NULL")
    seen = rows.groupBy("target_key", "url").agg(F.min("job_id").alias("first_job_id"), F.max("job_id").alias("last_job_id"))
    of_full = rows.join(broadcast_if_small(full_jobs.select(F.col("id").alias("job_id")), SMALL), "job_id", "left_semi")
    newest = of_full.groupBy("target_key").agg(F.max("job_id").alias("full_job_id"))
    listed = of_full.select("job_id", "target_key", "url").join(newest.select("target_key", F.col("full_job_id").alias("job_id")), ["target_key", "job_id"]).select("target_key", "url").distinct().withColumn("listed", F.lit(True))
    joined = seen.join(newest, "target_key", "left").join(listed, ["target_key", "url"], "left")
    return joined.select("target_key", "url", "first_job_id", "last_job_id", (F.col("full_job_id").isNull() | F.coalesce("listed", F.lit(False))).alias("is_present"))


def discovered(known: DataFrame, found: DataFrame) -> DataFrame:
    """``known`` (stable_id, fingerprint, status, attempt) after a discovery of ``found`` (stable_id, fingerprint): new
    entries are pending; finished ones are opened again if their fingerprint changed, those under review are not."""
    one = found.groupBy("stable_id").agg(F.max("fingerprint").alias("new_fingerprint"))
    joined = known.join(one, "stable_id", "full_outer")
    changed = F.col("status").isin("completed", "reused") & F.col("new_fingerprint").isNotNull() & ~F.col("new_fingerprint").eqNullSafe(F.col("fingerprint"))
    status = F.when(F.col("status").isNull() | changed, "pending").otherwise(F.col("status"))
    return joined.select("stable_id", F.coalesce("new_fingerprint", "fingerprint").alias("fingerprint"), status.alias("status"), F.coalesce("attempt", F.lit(0)).alias("attempt"))


def claimed(queue: DataFrame, n: int) -> DataFrame:
    """``queue`` with its first ``n`` open entries, by page and place, being checked: one more attempt each."""
    first = queue.where(F.col("status").isin("pending", "retry")).orderBy("page_number", "item_index", "stable_id").limit(n).select("stable_id", F.lit(True).alias("__taken"))
    joined = queue.join(first, "stable_id", "left")
    taken = F.coalesce("__taken", F.lit(False))
    return joined.withColumn("status", F.when(taken, "checking").otherwise(F.col("status"))).withColumn("attempt", F.col("attempt") + taken.cast("int")).drop("__taken")


def completed(queue: DataFrame, done: DataFrame) -> DataFrame:
    """``queue`` after entries were ``done`` (stable_id, status, document_id): their status, and the document where one is given."""
    new = done.groupBy("stable_id").agg(F.max(F.struct("status", "document_id")).alias("__done"))
    joined = queue.join(new, "stable_id", "left")
    return joined.withColumn("status", F.coalesce("__done.status", "status")).withColumn("document_id", F.coalesce("__done.document_id", "document_id")).drop("__done")


def caught_up(rounds: list[DataFrame], known: DataFrame, stop_after: int = 2) -> DataFrame:
    """Entries that repeated readings of a list's head add to ``known`` (stable_id), up to the round at which
    ``stop_after`` rounds in a row brought nothing new: (stable_id, round)."""
    if not rounds:
        return known.select("stable_id", F.lit(0).alias("round")).limit(0)
    read = reduce(DataFrame.unionByName, [r.select("stable_id", F.lit(i).alias("round")) for i, r in enumerate(rounds, 1)])
    first = read.groupBy("stable_id").agg(F.min("round").alias("round")).join(known.select("stable_id"), "stable_id", "left_anti")
    news = {r["round"] for r in first.select("round").distinct().collect()}  # at most one row per round
    last, empty = len(rounds), 0
    for i in range(1, len(rounds) + 1):
        empty = 0 if i in news else empty + 1
        if empty == stop_after:
            last = i
            break
    return first.where(F.col("round") <= last)


def synonyms(reference: DataFrame, key: str, levels: list[Column]) -> DataFrame:
    """(name, key) of every name of a reference: ``levels`` are arrays of names in order of priority. A name that several
    rows claim goes to the first level, then to the smallest key."""
    each = [reference.select(F.col(key).alias("key"), F.explode(level).alias("name"), F.lit(i).alias("level")) for i, level in enumerate(levels)]
    return reduce(DataFrame.unionByName, each).where("name <> ''").groupBy("name").agg(F.min(F.struct("level", "key")).alias("m")).select("name", F.col("m.key").alias("key"))


def resolved(df: DataFrame, column: str, names: DataFrame, into: str) -> DataFrame:
    """``df`` with the key that a column's value names, null where it names none."""
    known = broadcast_if_small(names.select(F.col("name").alias("__name"), F.col("key").alias(into)), SMALL)
    return df.join(known, F.col(column) == F.col("__name"), "left").drop("__name")


def by_position(left: DataFrame, right: DataFrame, place: list[str], value: str) -> DataFrame:
    """Places whose values differ, white space of any kind apart, or that one side lacks (compare values of ``text.comparable``
    to leave out other differences of form):
    (*place, left_value, right_value)."""
    solid = lambda c: F.regexp_replace(F.col(c), r"(?U)\s+", "")
    a, b = left.select(*place, F.col(value).alias("left_value"), F.lit(True).alias("l")), right.select(*place, F.col(value).alias("right_value"), F.lit(True).alias("r"))
    met = a.join(b, place, "full_outer")
    return met.where(F.col("l").isNull() | F.col("r").isNull() | ~solid("left_value").eqNullSafe(solid("right_value"))).drop("l", "r")


def enriched(links: DataFrame, related: DataFrame, on: str, columns: list[str], overwrite: bool) -> DataFrame:
    """``links`` with columns of their related rows: taken over as they are, or only where a link has none of its own."""
    other = related.groupBy(on).agg(*[F.first(c, ignorenulls=True).alias(f"__{c}") for c in columns])
    joined = links.join(other, on, "left")
    own = lambda c: F.nullif(F.col(c), F.lit(""))
    return joined.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) if overwrite else F.coalesce(own(c), F.col(f"__{c}"), F.col(c)) for c in columns}).drop(*[f"__{c}" for c in columns])
