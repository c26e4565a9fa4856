"""The review queue: pages of findings, counts, evidence, decisions, and statistics of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifthall.operators import relational as R
from sifthall.plans.merge import keyed_upsert

STATES = ("pending", "confirmed", "dismissed")


def queue(findings: DataFrame, docs: DataFrame, decisions: DataFrame | None = None, *, status: str = "all", page: int = 1, size: int = 20) -> DataFrame:
    """A page of findings, the newest first, with their documents and notes. ``size`` is from 1 to 50."""
    if status != "all" and status not in STATES:
        raise ValueError(f"status must be all or one of {STATES}")
    if page < 1 or not 1 <= size <= 50:
        raise ValueError("page begins with 1, size is from 1 to 50")
    rows = findings if status == "all" else findings.where(F.col("review_status") == status)
    joined = R.findings_with_documents(rows, docs)
    if decisions is None:
        joined = joined.withColumn("note", F.lit(""))
    else:
        joined = joined.join(decisions.select(F.col("finding_id").alias("id"), "note"), "id", "left").withColumn("note", F.coalesce("note", F.lit("")))
    return joined.orderBy(F.desc("id")).offset((page - 1) * size).limit(size)


def counts(findings: DataFrame) -> DataFrame:
    return R.status_counts(findings, ["job_id"], "review_status", list(STATES))


def exception_counts(items: DataFrame, failed_status: str = "review_required") -> DataFrame:
    """Per job: entries that failed and were resolved by a later row, and those that still stand."""
    failed = items.where((F.col("detail_status") == failed_status) & F.col("url").isNotNull()).select("job_id", "url").distinct()
    last = R.best_per_key(items.where("url IS NOT NULL").select("job_id", "url", "detail_status", "checked_at", "id"), ["job_id", "url"], [F.col("checked_at"), F.col("id")])
    joined = failed.join(last, ["job_id", "url"])
    return joined.groupBy("job_id").agg(F.count_if(F.col("detail_status") == failed_status).alias("n_pending"), F.count_if(F.col("detail_status") != failed_status).alias("n_resolved"))


def item_stats(items: DataFrame) -> DataFrame:
    """Per job: counts of entries by what their status says, in one aggregate."""
    s = F.col("detail_status")
    return items.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "checked_complete").alias("complete_header"), F.count_if(s == "checked_incomplete").alias("incomplete_header"),
        F.count_if(s.contains("no_header")).alias("no_header_pass"), F.count_if(s.startswith("reused")).alias("reused"), F.count_if(s.isin("exception", "review_required")).alias("exception"),
    )


def evidence(findings: DataFrame, docs: DataFrame, finding_id: int) -> DataFrame:
    """One finding with its document (a point look-up: the filter reaches the scan)."""
    return R.findings_with_documents(findings.where(F.col("id") == finding_id), docs)


def decided(findings: DataFrame, decisions: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, decisions) after ``new`` (finding_id, decision, note, decided_at): upserted, and the findings follow."""
    bad = new.where(~F.col("decision").isin("confirmed", "dismissed") | F.col("decision").isNull()).limit(1).count()
    if bad:
        raise ValueError("a decision is confirmed or dismissed")
    merged = keyed_upsert(decisions, new, ["finding_id"], [F.col("decided_at")])
    state = merged.select(F.col("finding_id").alias("id"), F.col("decision").alias("__decision"))
    after = findings.join(state, "id", "left").withColumn("review_status", F.coalesce("__decision", "review_status")).select(*findings.columns)
    return after, merged
