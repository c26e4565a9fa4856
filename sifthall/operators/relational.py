"""Joins, windows and aggregates of the compliance tables, each a function of DataFrames.

Rankings are expressed as ``max_by``/``min_by`` aggregates where one row per key is wanted: they combine before the
shuffle, so that a hot key costs one row per task, where a window would bring all its rows to one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sifthall.plans.stage import broadcast_if_small

#: Sides that hold one row per job or reference name; broadcast only behind this check.
SMALL = 100_000


def best_per_key(df: DataFrame, key: list[str], order: list[Column], columns: list[str] | None = None) -> DataFrame:
    """The row of each key with the greatest ``order``; give a unique last column to break ties. Null keys are a key.

    The row travels as one value, so that the scan reads each of its columns: name those that are needed."""
    if columns is not None:
        order_by = [o.alias(f"__o{i}") for i, o in enumerate(order)]
        df = df.select(*key, *[c for c in columns if c not in key], *order_by)
        kept = [*key, *[c for c in columns if c not in key]]
        best = df.groupBy(*key).agg(F.max_by(F.struct(*kept[len(key) :]), F.struct(*[f"__o{i}" for i in range(len(order))])).alias("best"))
        return best.select(*key, "best.*")
    others = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("best"))
    return best.select(*key, "best.*").select(*df.columns)


def mark(df: DataFrame, keys: DataFrame, on: str, name: str) -> DataFrame:
    """``df`` with a flag whether ``on`` stands in ``keys``: an existence join, one row per row of ``df``."""
    flagged = keys.select(F.col(on).alias("__key")).where("__key IS NOT NULL").distinct().withColumn("__there", F.lit(True))
    return df.join(flagged, F.col(on) == F.col("__key"), "left").withColumn(name, F.coalesce("__there", F.lit(False))).drop("__key", "__there")


def with_count(df: DataFrame, rows: DataFrame, key: str, foreign: str, name: str) -> DataFrame:
    """``df`` with the number of ``rows`` of each key, 0 where there is none (a scalar subquery, pre-aggregated)."""
    n = rows.where(F.col(foreign).isNotNull()).groupBy(F.col(foreign).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    return df.join(n, F.col(key) == F.col("__key"), "left").withColumn(name, F.coalesce("__n", F.lit(0))).drop("__key", "__n")


def with_latest(df: DataFrame, rows: DataFrame, key: str, foreign: str, value: str, order: str, name: str) -> DataFrame:
    """``df`` with the value of the last of ``rows`` of each key, null where there is none."""
    last = rows.groupBy(F.col(foreign).alias("__key")).agg(F.max_by(value, order).alias(name))
    return df.join(last, F.col(key) == F.col("__key"), "left").drop("__key")


def status_counts(df: DataFrame, key: list[str], column: str, values: list[str]) -> DataFrame:
    """One row per key: ``total`` and a zero-filled count per known value."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def ordered_concat(df: DataFrame, key: list[str], order: str, parts: dict[str, tuple[str, str]], count: str | None = None) -> DataFrame:
    """One row per key, with the number of its rows as ``count``; each of ``parts`` (name: column, separator) joined in the order of ``order``. The lists are those
    of one key and are meant for keys with a bounded number of rows, such as the findings of one document."""
    rows = F.array_sort(F.collect_list(F.struct(order, *dict.fromkeys(c for c, _ in parts.values()))))
    return df.groupBy(*key).agg(rows.alias("__rows")).select(*key, *[F.array_join(F.col(f"__rows.{c}"), sep).alias(name) for name, (c, sep) in parts.items()], *([F.size("__rows").cast("bigint").alias(count)] if count else []))


def effective_document(reused: str = "reused_document_id", own: str = "document_id") -> Column:
    return F.coalesce(F.nullif(F.col(own), F.lit(0)), F.nullif(F.col(reused), F.lit(0)))


# --- findings, documents, items -----------------------------------------------------------------------------------


def findings_with_documents(findings: DataFrame, docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("id").alias("document_id"), "title", "url", "district", "source_site", "issuing_agency", "page_document_number", "published_date", "authored_date")
    return findings.join(d, "document_id")


def visible_evidence() -> Column:
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    return F.col("visible") & (F.col("review_status") != "legacy_hidden") & filled("source_area") & filled("source_page_url")


def link_problems(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Confirmed broken or failed links with visible evidence, with their documents."""
    kept = links.where(visible_evidence() & (F.col("review_status") == "confirmed") & F.col("result").isin("broken", "error"))
    d = docs.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), F.col("url").alias("document_url"), "district")
    return kept.join(d, "document_id")


def documents_overview(docs: DataFrame, snapshots: DataFrame, findings: DataFrame, job_id: int) -> DataFrame:
    """Documents of a job or last seen by it, with the number of the job's findings: the job's predicate stands on the
    right sides before the outer joins, so that documents without rows stay."""
    seen = snapshots.where(F.col("job_id") == job_id).select(F.col("document_id").alias("id"), F.lit(True).alias("captured")).distinct()
    counts = findings.where(F.col("job_id") == job_id).groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    joined = docs.select("id", "district", "title", "last_seen_job_id").join(seen, "id", "left").where(F.col("captured").isNotNull() | (F.col("last_seen_job_id") == job_id))
    return joined.join(counts, "id", "left").select("id", "district", "title", F.coalesce("captured", F.lit(False)).alias("captured"), F.coalesce("n", F.lit(0)).alias("n_findings"))


def first_agency(docs: DataFrame, agencies: DataFrame) -> DataFrame:
    """(id, agency_id): the first agency, by id, of the document's district one of whose names holds the issuing agency
    or is held by it. Names are matched once per distinct (district, agency) and joined back."""
    names = agencies.select(F.col("id").alias("agency_id"), "district", F.concat(F.array("agency_name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("names"))
    typed = docs.where("issuing_agency <> ''").select("district", "issuing_agency").distinct()
    near = F.exists("names", lambda n: F.contains(F.col("issuing_agency"), n) | F.contains(n, F.col("issuing_agency")))
    first = typed.join(broadcast_if_small(names, SMALL), "district").where(near).groupBy("district", "issuing_agency").agg(F.min("agency_id").alias("agency_id"))
    return docs.select("id", "district", "issuing_agency").join(first, ["district", "issuing_agency"]).select("id", "agency_id")


def findings_of_items(items: DataFrame, findings: DataFrame) -> DataFrame:
    """(source_label, url, finding_id, category), each once: findings that list entries of the same job lead to."""
    i = items.select("job_id", "source_label", "url", effective_document().alias("document_id")).where("document_id IS NOT NULL").distinct()
    f = findings.select("job_id", "document_id", F.col("id").alias("finding_id"), "category")
    return i.join(f, ["job_id", "document_id"]).select("job_id", "source_label", "url", "finding_id", "category").distinct()


def unmapped_findings(items: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings that no list entry of their job leads to."""
    i = items.select("job_id", effective_document().alias("document_id")).where("document_id IS NOT NULL").distinct()
    return findings.join(i, ["job_id", "document_id"], "left_anti")


def issue_summary(items: DataFrame, findings: DataFrame, docs: DataFrame) -> DataFrame:
    """(source, category, n): findings by the source that lists them, once per address; those that none lists go to
    their document's site, or its district."""
    listed = findings_of_items(items, findings).groupBy(F.col("source_label").alias("source"), "category").agg(F.count(F.lit(1)).alias("n"))
    site = F.coalesce(F.nullif("source_site", F.lit("")), "district")
    rest = unmapped_findings(items, findings).join(docs.select(F.col("id").alias("document_id"), site.alias("source")), "document_id").groupBy("source", "category").agg(F.count(F.lit(1)).alias("n"))
    return listed.unionByName(rest).groupBy("source", "category").agg(F.sum("n").alias("n"))


def metadata_issues(items: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per job and address with incomplete metadata: incomplete checks before others, then the first listed."""
    rows = items.where((F.size("missing_fields") > 0) | (F.col("detail_status") == "checked_incomplete"))
    first = [F.when(F.col("detail_status") == "checked_incomplete", 2).otherwise(1), -F.coalesce("page_number", F.lit(0)), -F.coalesce("item_index", F.lit(0)), -F.col("id")]
    return best_per_key(rows, ["job_id", "url"], first, columns)


def best_rows(items: DataFrame, performed: list[str], columns: list[str] | None = None) -> DataFrame:
    """The row of each job and address that counts: performed statuses first, then the latest."""
    return best_per_key(items, ["job_id", "url"], [F.col("detail_status").isin(performed).cast("int"), F.col("checked_at"), F.col("id")], columns)


def latest_rows(items: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return best_per_key(items, ["job_id", "target_key", "url"], [F.col("checked_at"), F.col("id")], columns)


def shared_addresses(items: DataFrame) -> DataFrame:
    """Entries whose address another source of the same job has listed before them, by source, page and place."""
    order = F.struct(F.col("target_key").alias("t"), F.coalesce("page_number", F.lit(0)).alias("p"), F.coalesce("item_index", F.lit(0)).alias("i"), F.col("id").alias("id"))
    rows = items.where("url IS NOT NULL").select("id", "job_id", "target_key", "url", order.alias("place"))
    first = rows.groupBy("job_id", "url").agg(F.min("place").alias("first"), F.min("target_key").alias("low"), F.max("target_key").alias("high")).where("low <> high").select("job_id", "url", F.col("first.id").alias("first_id"), F.col("first.t").alias("first_target"))
    return rows.join(first, ["job_id", "url"]).where("id <> first_id").select("id", "job_id", "url", "target_key", "first_target")


def copied_findings(items: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of baseline jobs copied to the jobs that reuse their documents, once however often it is run: keyed by
    (new job, document, rule), the first finding of the baseline counting."""
    reuse = items.where("reused_document_id IS NOT NULL AND baseline_job_id IS NOT NULL").select(F.col("job_id").alias("new_job_id"), F.col("reused_document_id").alias("document_id"), F.col("baseline_job_id").alias("job_id")).distinct()
    met = reuse.join(findings.select("job_id", "document_id", "rule_code", "category", "severity", "detail", "id"), ["job_id", "document_id"])
    return met.groupBy("new_job_id", "document_id", "rule_code").agg(F.min_by(F.struct("category", "severity", "detail"), "id").alias("f")).select(F.col("new_job_id").alias("job_id"), "document_id", "rule_code", "f.category", "f.severity", "f.detail")


def distinct_links(*links: DataFrame) -> DataFrame:
    """Union of related links, each once by kind, address, area, text and page, the first kept."""
    key = ["link_kind", "original_url", "source_area", "link_text", "source_page_url"]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), links)
    return rows.groupBy(*key).agg(F.min("id").alias("id"))


# --- jobs ---------------------------------------------------------------------------------------------------------


def baselines(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """Completed full jobs with complete coverage that have results, newest first."""
    full = jobs.where("mode = 'full' AND status = 'completed' AND coverage_status = 'complete'")
    return full.join(items.select(F.col("job_id").alias("id")).distinct(), "id", "left_semi")


def newest_baseline(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """(signature, id): the newest baseline of each set of sources, in whatever order they are named."""
    signature = F.array_join(F.array_sort("source_signature"), "|")
    return baselines(jobs, items).groupBy(signature.alias("signature")).agg(F.max("id").alias("id"))


def removed_since(before: DataFrame, now: DataFrame, key: list[str]) -> DataFrame:
    """Keys of ``before`` that ``now`` has no more."""
    return before.select(*key).distinct().join(now.select(*key).distinct(), key, "left_anti")


def changed_versions(items: DataFrame, print_: Column) -> DataFrame:
    """Entries whose fingerprint differs from the one the job before them had; entries of one job count by the latest."""
    one = best_per_key(items.select("job_id", "target_key", "url", "checked_at", "id", print_.alias("fingerprint")), ["job_id", "target_key", "url"], [F.col("checked_at"), F.col("id")])
    w = Window.partitionBy("target_key", "url").orderBy("job_id")
    return one.withColumn("previous", F.lag("fingerprint").over(w)).where("previous <> fingerprint").select("job_id", "target_key", "url", "fingerprint")


def first_seen(items: DataFrame) -> DataFrame:
    """(target_key, url, job_id): the first job that listed an entry."""
    return items.where("url IS NOT NULL").groupBy("target_key", "url").agg(F.min("job_id").alias("job_id"))


def coverage(jobs: DataFrame, items: DataFrame, done: list[str]) -> DataFrame:
    """Counts of each job's entries held against one another, and the mismatches in words."""
    n = items.groupBy(F.col("job_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_items"), F.countDistinct("target_key", "url").alias("n_unique"), F.count_if(F.col("detail_status").isin(done)).alias("n_done"),
        F.count_if(F.col("detail_status").isin("exception", "review_required")).alias("n_exceptions"), F.count_if(F.col("checked_at").isNull()).alias("n_unchecked"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = jobs.select("id", "status", "coverage_status").join(n, "id", "left").select("id", "status", "coverage_status", *[zero(c).alias(c) for c in ("n_items", "n_unique", "n_done", "n_exceptions", "n_unchecked")])
    problems = F.array_compact(F.array(
        F.when(F.col("n_items") == 0, "no entries"), F.when(F.col("n_items") != F.col("n_unique"), "entries repeat"), F.when(F.col("n_done") < F.col("n_items"), "entries are open"),
        F.when(F.col("n_exceptions") > 0, "exceptions are left"), F.when(F.col("n_unchecked") > 0, "entries were not checked"),
    ))
    return joined.withColumn("mismatches", F.array_join(problems, "; ")).withColumn("is_complete", F.size(problems) == 0)


def reuse_decision(items: DataFrame, jobs: DataFrame, links: DataFrame, least_version: int = 1) -> DataFrame:
    """(id, can_reuse, reason) of each entry of an incremental job against the latest row of its baseline: one windowless
    de-duplication and one left join; the first reason that holds counts."""
    base = latest_rows(items.where("url IS NOT NULL"), ["title", "listed_date", "detail_status", "link_check_version", "missing_fields", "document_id", "reused_document_id"])
    hidden = links.where("NOT coalesce(visible, false) OR review_status = 'legacy_hidden' OR trim(coalesce(source_area, '')) = ''").select("document_id", F.col("job_id"))
    old = base.select(
        F.col("job_id").alias("baseline"), "target_key", "url", F.col("title").alias("b_title"), F.col("listed_date").alias("b_date"), F.col("detail_status").alias("b_status"),
        F.col("link_check_version").alias("b_version"), F.size("missing_fields").alias("b_missing"), effective_document().alias("document_id"),
    )
    old = old.join(hidden.select("document_id", F.col("job_id").alias("baseline"), F.lit(True).alias("hidden")).distinct(), ["document_id", "baseline"], "left")
    now = items.where("url IS NOT NULL").join(broadcast_if_small(jobs.where("baseline_job_id IS NOT NULL").select(F.col("id").alias("job_id"), F.col("baseline_job_id").alias("baseline")), SMALL), "job_id")
    met = now.select("id", "baseline", "target_key", "url", "title", "listed_date").join(old, ["baseline", "target_key", "url"], "left")
    reason = (
        F.when(F.col("b_status").isNull(), "new").when(F.trim("title") != F.trim("b_title"), "title changed").when(~F.col("listed_date").eqNullSafe(F.col("b_date")), "date changed")
        .when(F.coalesce("b_version", F.lit(0)) < least_version, "links not checked").when(F.col("b_status").isin("exception", "review_required", "checked_incomplete"), "baseline incomplete")
        .when(F.coalesce("hidden", F.lit(False)), "links without evidence").when(F.col("b_status").contains("no_header"), "no header, unchanged").when(F.col("b_missing") > 0, "fields missing")
        .when(F.col("document_id").isNull(), "no document").otherwise("unchanged")
    )
    return met.select("id", reason.alias("reason")).withColumn("can_reuse", F.col("reason").isin("no header, unchanged", "unchanged"))


# --- list pages ---------------------------------------------------------------------------------------------------


def page_checks(items: DataFrame, size: int = 15) -> DataFrame:
    """Each page of a job's list held against its place: full unless last, no entry twice, places within the size."""
    pages = items.where("page_number IS NOT NULL").groupBy("job_id", "target_key", "page_number").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("url").alias("n_urls"), F.countDistinct("item_index").alias("n_places"), F.max("item_index").alias("last_place"))
    last = pages.groupBy("job_id", "target_key").agg(F.max("page_number").alias("last_page"))
    joined = pages.join(last, ["job_id", "target_key"])
    problem = F.array_compact(F.array(
        F.when(F.col("n_urls") < F.col("n_rows"), "entries repeat"), F.when(F.col("n_places") < F.col("n_rows"), "places repeat"),
        F.when((F.col("page_number") < F.col("last_page")) & (F.col("n_places") < size), "page not full"), F.when(F.col("last_place") >= size, "place beyond the size"),
    ))
    return joined.select("job_id", "target_key", "page_number", "n_rows", "n_urls", F.array_join(problem, "; ").alias("problems"))


def expected_pages(total: Column, size: int) -> Column:
    return F.ceil(total / size).cast("bigint")


def expected_rows(total: Column, page: Column, size: int) -> Column:
    """Rows a page of a list of ``total`` must hold: full pages, then the rest, then none."""
    return F.greatest(F.least(total - (page - 1) * size, F.lit(size)), F.lit(0)).cast("bigint")
