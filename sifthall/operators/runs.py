"""Jobs, their generations, plans, schedules and exceptions, as decision tables over written facts.

Nothing here keeps counters: what a job has done is what its rows say. A state is a pure function of tables and a time
``as_of``, so that the same question can be asked of any moment. Tables of jobs have one row per run and are small; tables of
entries are aggregated before they meet them.

Edge cases: null keys and addresses take no part; a null time is unknown and makes nothing due; repeated rows count once per
entry, the latest one; empty tables give empty results, or zeros where every job has a row.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sifthall.functions import text as T
from sifthall.functions import web
from sifthall.operators import relational as R
from sifthall.plans.stage import broadcast_if_small

# States of jobs and entries, and what stops a run for a while.
ACTIVE = ("pending", "running", "cooling")
RESUMABLE = (*ACTIVE, "paused", "partial", "failed")
PERFORMED = ("checked_complete", "checked_incomplete", "no_header")
STATES = {"pending": "pending", "review_required": "review", "exception": "retry", "reused": "reused", "skipped": "reused"}
COOLING_MARKERS = ("访问受限", "HTTP 403", "HTTP 429", "验证码", "访问频繁", "安全冷却")
#: (state, command) -> state; what is not listed is not allowed.
TRANSITIONS = {
    "pause": {s: "paused" for s in ACTIVE}, "stop": {s: "stopped" for s in ("pending", "running", "paused", "partial", "cooling", "failed")},
    "resume": {s: "pending" for s in ("paused", "partial", "cooling", "failed")},
}
INCREMENTAL_HOURS, FULL_DAYS, RETRY_MINUTES, REFRESH_DAYS = 6, 7, 15, 30


def signature(sources: Column) -> Column:
    """One text for a set of sources, in whatever order they are named."""
    return F.array_join(F.array_sort(sources), "|")


def status_at(jobs: DataFrame, as_of: datetime | Column) -> DataFrame:
    """Jobs created by ``as_of``, with the ``status`` they had then: pending before their start, running before their end."""
    at = as_of if isinstance(as_of, Column) else F.lit(as_of)
    status = F.when(F.coalesce(F.col("started_at") > at, F.lit(True)), "pending").when(F.col("finished_at") > at, "running").otherwise(F.col("status"))
    return jobs.where(F.col("created_at") <= at).withColumn("status", status)


def recent(jobs: DataFrame, n: int = 30) -> DataFrame:
    return jobs.orderBy(F.desc("id")).limit(n)


def active(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin(*ACTIVE))


# --- generations: the entries of one target in one job ------------------------------------------------------------


def generation_items(items: DataFrame) -> DataFrame:
    """(job_id, target_key, url, state, ...) of each entry by its latest row."""
    known = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    latest = R.latest_rows(items.where("url IS NOT NULL AND target_key IS NOT NULL"), ["detail_status", "page_number", "item_index", "document_id", "reused_document_id"])
    return latest.withColumn("state", F.coalesce(known[F.col("detail_status")], F.lit("completed")))


def generations(items: DataFrame) -> DataFrame:
    """Header of each generation: entries by state, places that its list showed, rows written, and whether it is covered."""
    of = ["job_id", "target_key"]
    n = lambda *states: F.count_if(F.col("state").isin(*states))
    header = generation_items(items).groupBy(*of).agg(
        F.count(F.lit(1)).alias("discovered"), n("completed", "reused").alias("completed"), n("reused").alias("reused"), n("retry").alias("retry"), n("review").alias("review"),
        n("completed", "reused", "review").alias("terminal"), n("pending", "checking", "retry").alias("open"),
    )
    seen = items.where("url IS NOT NULL AND target_key IS NOT NULL").groupBy(*of).agg(F.countDistinct("page_number", "item_index").alias("observed"), F.count(F.lit(1)).alias("n_rows"))
    ok = (F.col("open") == 0) & (F.col("discovered") > 0) & (F.col("terminal") == F.col("discovered")) & (F.col("n_rows") >= F.col("terminal")) & F.col("observed").isin(0, F.col("discovered"))
    return header.join(seen, of).withColumn("ok", ok)


def job_totals(headers: DataFrame) -> DataFrame:
    """Sums over all generations of each job."""
    sums = [F.sum(c).alias(c) for c in ("discovered", "completed", "reused", "retry", "review", "open")]
    return headers.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_generations"), *sums, F.max("observed").alias("largest"))


def latest_generation(headers: DataFrame) -> DataFrame:
    """The newest generation of each target."""
    return R.best_per_key(headers, ["target_key"], [F.col("job_id")], ["job_id", "discovered", "terminal", "ok"])


def reconciled(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """(id, mismatches) of each job: what keeps it from being complete. Full jobs are judged by their generations, others by
    the counts of their rows."""
    h = generations(items)
    own = F.array_compact(F.array(
        F.when(F.col("terminal") != F.col("discovered"), F.format_string("%s: %d of %d entries are done", "target_key", "terminal", "discovered")),
        F.when((F.col("observed") > 0) & (F.col("observed") != F.col("discovered")), F.format_string("%s: list showed %d, %d are known", "target_key", "observed", "discovered")),
    ))
    by_job = h.withColumn("own", own).groupBy("job_id").agg(
        F.sum("open").alias("open"), F.sum("discovered").alias("discovered"), F.sum("terminal").alias("terminal"), F.sum("n_rows").alias("n_rows"), F.sum("observed").alias("observed"),
        F.transform(F.array_sort(F.collect_list(F.struct("target_key", "own"))), lambda x: x["own"]).alias("each"),
    )
    work = generation_items(items).groupBy("job_id").agg(F.count_if(F.col("state").isin("reused")).alias("skipped"), F.count_if(F.col("detail_status").isin(*PERFORMED)).alias("processed"))
    joined = jobs.select(F.col("id").alias("job_id"), "mode").join(by_job, "job_id", "left").join(work, "job_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    snapshot = F.concat(
        F.coalesce(F.flatten("each"), F.array().cast("array<string>")),
        F.array_compact(F.array(F.when(zero("open") > 0, F.format_string("%d entries are open", zero("open"))), F.when(zero("discovered") <= 0, F.lit("no entry is known")), F.when((zero("terminal") > 0) & (zero("n_rows") == 0), F.lit("no results")))),
    )
    counted = F.array_compact(F.array(
        F.when(zero("discovered") != zero("observed"), F.format_string("covered %d of %d", zero("discovered"), zero("observed"))), F.when(zero("n_rows") != zero("discovered"), F.format_string("%d results for %d covered", zero("n_rows"), zero("discovered"))),
        F.when(zero("processed") + zero("skipped") != zero("discovered"), F.format_string("%d checked and %d skipped are not %d", zero("processed"), zero("skipped"), zero("discovered"))),
    ))
    return joined.select(F.col("job_id").alias("id"), F.array_join(F.when(F.col("mode") == "full", snapshot).otherwise(counted), "; ").alias("mismatches"))


def progress(jobs: DataFrame, headers: DataFrame) -> DataFrame:
    """(id, examined, total, remaining, percent) of each job."""
    t = headers.groupBy(F.col("job_id").alias("id")).agg(F.sum("terminal").alias("examined"), F.sum(F.greatest("observed", "discovered")).alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = jobs.select("id").join(t, "id", "left").select("id", zero("examined").alias("examined"), zero("total").alias("total"))
    percent = F.when(F.col("total") > 0, F.least(F.lit(100), F.floor(100 * F.col("examined") / F.col("total")))).otherwise(0).cast("bigint")
    return joined.select("id", "examined", "total", F.greatest(F.col("total") - F.col("examined"), F.lit(0)).alias("remaining"), percent.alias("percent"))


# --- baselines and plans ------------------------------------------------------------------------------------------


def valid_baselines(jobs: DataFrame, headers: DataFrame) -> DataFrame:
    """(id, signature) of completed full jobs whose entries are as many as their lists showed and as were examined, over the
    targets that the job was asked for."""
    n = headers.groupBy(F.col("job_id").alias("id")).agg(F.sum("discovered").alias("n"), F.sum("observed").alias("observed"), F.sum("terminal").alias("terminal"), F.array_join(F.array_sort(F.collect_set("target_key")), "|").alias("targets"))
    full = jobs.where("mode = 'full' AND status = 'completed' AND coverage_status = 'complete'").select("id", signature(F.col("source_signature")).alias("signature"))
    return full.join(n, "id").where("n > 0 AND n = observed AND targets = signature").select("id", "signature", "n", (F.col("n") - F.col("terminal")).alias("n_open"))


def automatic_plan(jobs: DataFrame, baselines: DataFrame) -> DataFrame:
    """What to do for each set of sources: go on with the newest job, or create one, incremental if there is a baseline."""
    last = R.best_per_key(jobs.select(signature(F.col("source_signature")).alias("signature"), "id", "status", "mode"), ["signature"], [F.col("id")], ["id", "status", "mode"])
    base = baselines.groupBy("signature").agg(F.max("id").alias("baseline_id"))
    joined = last.join(base, "signature", "left")
    on = F.col("status").isin(*RESUMABLE) & (F.col("baseline_id").isNull() | (F.col("id") > F.col("baseline_id")))
    action = F.when(on & F.col("status").isin(*ACTIVE), "existing").when(on, "resume").otherwise("create")
    mode = F.when(on, F.col("mode")).when(F.col("baseline_id").isNull(), "full").otherwise("incremental")
    return joined.select("signature", F.col("id").alias("job_id"), action.alias("action"), mode.alias("next_mode"), "baseline_id")


def commanded(jobs: DataFrame) -> DataFrame:
    """(id, command, next_status, violation) of each command to each job: a legal transition, or why it is none. A job is not
    resumed beside another active one of the same sources, nor while it cools down."""
    busy = active(jobs).groupBy(signature(F.col("source_signature")).alias("signature")).agg(F.max("id").alias("other"), F.count(F.lit(1)).alias("n_active"))
    table = F.create_map(*[x for command, moves in TRANSITIONS.items() for s, to in moves.items() for x in (F.lit(f"{command}|{s}"), F.lit(to))])
    asked = jobs.select("id", "status", signature(F.col("source_signature")).alias("signature"), cooling_reason(F.col("pause_reason")).alias("cooling"), F.explode(F.array(*[F.lit(c) for c in TRANSITIONS])).alias("command")).join(broadcast_if_small(busy, R.SMALL), "signature", "left")
    to = F.try_element_at(table, F.concat_ws("|", "command", "status"))
    others = F.coalesce("n_active", F.lit(0)) - F.col("status").isin(*ACTIVE).cast("int") > 0
    violation = F.when(to.isNull(), "not allowed in this state").when((F.col("command") == "resume") & others, "another job of these sources is active").when((F.col("command") == "resume") & F.col("cooling"), "cooling down")
    return asked.select("id", "command", F.when(violation.isNull(), to).alias("next_status"), violation.alias("violation"))


def started(jobs: DataFrame, full: bool) -> DataFrame:
    """(signature, action, job_id) of a start for each set of sources: an active job is reused, else one is created. A full
    rebuild is all or nothing: where any is active, all are refused."""
    rows = jobs.select(signature(F.col("source_signature")).alias("signature"), "id", F.col("status").isin(*ACTIVE).alias("active"))
    by = rows.groupBy("signature").agg(F.max(F.when(F.col("active"), F.col("id"))).alias("job_id"))
    if not full:
        return by.select("signature", F.when(F.col("job_id").isNull(), "create").otherwise("existing").alias("action"), "job_id")
    any_ = F.broadcast(by.agg(F.coalesce(F.max(F.col("job_id").isNotNull()), F.lit(False)).alias("busy")).withColumn("one", F.lit(1)))
    return by.withColumn("one", F.lit(1)).join(any_, "one").select("signature", F.when(F.col("busy"), "refused").otherwise("create").alias("action"), "job_id")


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart of the program: what was pending or running is paused, as interrupted."""
    cut = F.col("status").isin("pending", "running")
    return jobs.withColumns({"pause_reason": F.when(cut, "interrupted").otherwise(F.col("pause_reason")), "coverage_status": F.when(cut, "partial").otherwise(F.col("coverage_status")), "status": F.when(cut, "paused").otherwise(F.col("status"))})


def cooling_reason(reason: Column) -> Column:
    return F.coalesce(reason.rlike("|".join(COOLING_MARKERS)), F.lit(False))


# --- schedules ----------------------------------------------------------------------------------------------------


def schedules(jobs: DataFrame) -> DataFrame:
    """Cadence of each set of sources after its ended jobs: only an end moves it, and after a failure the next try is soon."""
    ended = jobs.where(F.col("finished_at").isNotNull())
    key = signature(F.col("source_signature")).alias("signature")
    done = F.col("status") == "completed"
    times = ended.groupBy(key).agg(
        F.max_by(F.struct("id", "mode", "status", "finished_at"), F.struct("finished_at", "id")).alias("last"),
        F.max(F.when(done & (F.col("mode") == "full"), F.col("finished_at"))).alias("last_full_at"), F.max(F.when(done & (F.col("mode") != "full"), F.col("finished_at"))).alias("last_incremental_at"),
    )
    failed = F.col("last.status") != "completed"
    soon = F.col("last.finished_at") + F.expr(f"INTERVAL {RETRY_MINUTES} MINUTES")
    next_full = F.when(failed & (F.col("last.mode") == "full"), soon).otherwise(F.col("last_full_at") + F.expr(f"INTERVAL {FULL_DAYS} DAYS"))
    next_incremental = F.when(failed, soon).otherwise(F.col("last.finished_at") + F.expr(f"INTERVAL {INCREMENTAL_HOURS} HOURS"))
    return times.select("signature", F.col("last.id").alias("last_job_id"), F.col("last.status").alias("last_status"), "last_full_at", "last_incremental_at", next_full.alias("next_full_at"), next_incremental.alias("next_incremental_at"))


def due(planned: DataFrame, busy: DataFrame, baselines: DataFrame, as_of: datetime | Column) -> DataFrame:
    """(signature, kind, baseline_id) of schedules that are due and not busy: a due full run comes before an incremental one, which
    needs a baseline; without one a first full run is made."""
    at = as_of if isinstance(as_of, Column) else F.lit(as_of)
    on = lambda c: F.coalesce(F.col(c) <= at, F.lit(False))
    base = baselines.groupBy("signature").agg(F.max("id").alias("baseline_id"))
    free = planned.where(on("next_full_at") | on("next_incremental_at")).join(active(busy).select(signature(F.col("source_signature")).alias("signature")), "signature", "left_anti")
    kind = F.when(on("next_full_at"), "full").when(F.col("baseline_id").isNotNull(), "incremental").otherwise("first full")
    return free.join(base, "signature", "left").select("signature", kind.alias("kind"), "baseline_id")


def site_status(sites: DataFrame, plans: DataFrame, planned: DataFrame) -> DataFrame:
    """Each site (signature) with its plan and schedule, whether it has them or not."""
    p, s = plans.select("signature", "job_id", "action", "next_mode", "baseline_id"), planned.select("signature", "last_status", "next_full_at", "next_incremental_at")
    return sites.select("signature").distinct().join(p, "signature", "left").join(s, "signature", "left").withColumn("action", F.coalesce("action", F.lit("create"))).withColumn("next_mode", F.coalesce("next_mode", F.lit("full")))


def site_targets(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """(signature, target_key, source_label, level) of each site's targets: several targets make a site of a district."""
    labels = items.where("target_key IS NOT NULL").groupBy("target_key").agg(F.min("source_label").alias("source_label"))
    each = jobs.select(signature(F.col("source_signature")).alias("signature"), F.size("source_signature").alias("n"), F.explode("source_signature").alias("target_key")).distinct()
    return each.join(labels, "target_key", "left").select("signature", "target_key", "source_label", F.when(F.col("n") > 1, "district").otherwise("city").alias("level"))


# --- entries: exceptions, precedence, reuse -----------------------------------------------------------------------


def exceptions(items: DataFrame, failed: str = "review_required") -> DataFrame:
    """(job_id, url, status, retry_count, first_id, last_id, page_number, item_index) of each address that failed in a job: pending
    after its first failure, resolved once a later row did not fail, to be reviewed if a later one failed again."""
    rows = items.where("url IS NOT NULL").select("job_id", "url", (F.col("detail_status") == failed).alias("bad"), F.struct(F.coalesce("checked_at", F.lit("1900-01-01").cast("timestamp")).alias("t"), "id").alias("at"), "page_number", "item_index")
    one = rows.groupBy("job_id", "url").agg(
        F.min(F.when(F.col("bad"), F.col("at"))).alias("first"), F.max("at").alias("last"), F.max_by("bad", "at").alias("still"), F.count_if("bad").alias("n_bad"), F.max_by(F.struct("page_number", "item_index"), "at").alias("place"),
    )
    bad = one.where("first IS NOT NULL")
    status = F.when(~F.col("still"), "resolved").when(F.col("n_bad") > 1, "review_required").otherwise("pending")
    return bad.select("job_id", "url", status.alias("status"), (F.col("n_bad") - 1).alias("retry_count"), F.col("first.id").alias("first_id"), F.col("last.id").alias("last_id"), "place.page_number", "place.item_index")


def pending_exceptions(found: DataFrame) -> DataFrame:
    """Those still to be tried, by page and place."""
    return found.where("status = 'pending'").orderBy("job_id", "page_number", "item_index", "url")


def precedence(items: DataFrame, jobs: DataFrame, links: DataFrame, least_version: int = 1) -> DataFrame:
    """(id, path, next_status) of each entry: taken from another target of the same job that lists the address before it, from a row
    of this job that was checked already, from the baseline, or else its page is opened. What is taken over is named by
    whether it has a header."""
    run = R.shared_addresses(items).select("id", F.col("first_target").alias("cached")).distinct()  # rows may be delivered twice
    best = R.best_rows(items.where(F.col("url").isNotNull() & (F.coalesce("link_check_version", F.lit(0)) >= least_version)), list(PERFORMED), ["id", "detail_status", "header_detected"])
    current = best.where(F.col("detail_status").isin(*PERFORMED)).select("job_id", "url", F.col("id").alias("current_id"), F.col("detail_status").alias("current_status"))
    base = R.reuse_decision(items, jobs, links).where("can_reuse").select("id", F.lit(True).alias("reusable")).distinct()
    rows = items.where("url IS NOT NULL").select("id", "job_id", "url", F.coalesce("header_detected", F.lit(False)).alias("header"))
    joined = rows.join(run, "id", "left").join(current, ["job_id", "url"], "left").join(base, "id", "left")
    path = F.when(F.col("cached").isNotNull(), "run").when(F.col("current_id") == F.col("id"), "done").when(F.col("current_id").isNotNull(), "job").when(F.col("reusable"), "baseline").otherwise("open")
    kind = F.when(F.col("header"), "detail").otherwise("no_header")
    status = F.when(path == "done", F.col("current_status")).when(path.isin("run", "job"), F.concat(F.lit("reused_current_"), kind)).when(path == "baseline", F.concat(F.lit("reused_baseline_"), kind)).otherwise("to_open")
    return joined.select("id", path.alias("path"), status.alias("next_status"))


def fresh_enough(items: DataFrame, docs: DataFrame, as_of: datetime | Column, refresh_days: int = REFRESH_DAYS) -> DataFrame:
    """(id, reason, document_id) of each entry: whether its document was checked lately and still has the same title and date;
    the first reason that holds counts."""
    at = as_of if isinstance(as_of, Column) else F.lit(as_of)
    d = docs.select("url", F.col("id").alias("document_id"), F.col("title").alias("d_title"), "published_date", "last_detail_checked_at")
    met = items.where("url IS NOT NULL").select("id", "url", "title", "listed_date").join(d, "url", "left")
    reason = (
        F.when(F.col("document_id").isNull(), "new").when(~T.strip(F.col("d_title")).eqNullSafe(T.strip(F.col("title"))), "title changed")
        .when(F.col("listed_date").isNotNull() & ~F.col("listed_date").eqNullSafe(F.col("published_date")), "date changed").when(F.col("last_detail_checked_at").isNull(), "never checked")
        .when(F.col("last_detail_checked_at") < at - F.expr(f"INTERVAL {refresh_days} DAYS"), "checked too long ago").otherwise("fresh")
    )
    return met.select("id", reason.alias("reason"), "document_id")


def copied_links(items: DataFrame, links: DataFrame) -> DataFrame:
    """Links of baseline jobs with visible evidence, copied to the jobs that reuse their documents: keyed by where they stand, the
    last check of each counting, so that copying again changes nothing."""
    reuse = items.where("reused_document_id IS NOT NULL AND baseline_job_id IS NOT NULL").select(F.col("job_id").alias("new_job_id"), F.col("reused_document_id").alias("document_id"), F.col("baseline_job_id").alias("job_id")).distinct()
    kept = links.where(R.visible_evidence()).select("job_id", "document_id", "original_url", "source_area", "source_page_url", "link_text", "result", "status_code", "id")
    met = reuse.join(kept, ["job_id", "document_id"])
    key = ["new_job_id", "document_id", "original_url", "source_area", "source_page_url", "link_text"]
    return met.groupBy(*key).agg(F.max_by(F.struct("result", "status_code"), "id").alias("l")).select(F.col("new_job_id").alias("job_id"), *key[1:], "l.result", "l.status_code")


def by_address_or_place(items: DataFrame) -> DataFrame:
    """One row per entry of a job's target: by address where it has one, else by place; a place that a later entry has taken is
    marked by minus the id of the row that lost it."""
    key = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("url:"), "url")).otherwise(F.concat_ws("|", F.lit("place:"), F.col("page_number").cast("string"), F.col("item_index").cast("string")))
    rows = items.where("page_number IS NOT NULL AND item_index IS NOT NULL AND target_key IS NOT NULL").select("job_id", "target_key", key.alias("entry"), "id", "page_number", F.col("item_index").cast("bigint").alias("item_index"), "detail_status")
    one = R.best_per_key(rows, ["job_id", "target_key", "entry"], [F.col("id")], ["id", "page_number", "item_index", "detail_status"])
    place = Window.partitionBy("job_id", "target_key", "page_number", "item_index")  # rows of one place of one list
    return one.withColumn("item_index", F.when(F.col("id") == F.max("id").over(place), F.col("item_index")).otherwise(-F.col("id")))


def wrong_hosts(rows: DataFrame, key: str, url: str, id_: str = "id") -> DataFrame:
    """(id, host, expected) of rows whose address lies on another host than most of their ``key``."""
    each = rows.where(F.col(url).isNotNull() & F.col(key).isNotNull()).select(F.col(id_).alias("id"), F.col(key).alias("key"), web.host(F.col(url)).alias("host"))
    common = each.where("host IS NOT NULL").groupBy("key", "host").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("host", F.struct("n", "host")).alias("expected"))
    return each.join(broadcast_if_small(common, R.SMALL), "key").where(~F.col("host").eqNullSafe(F.col("expected"))).select("id", "host", "expected")


# --- records, counters, contracts ---------------------------------------------------------------------------------


def opened(items: DataFrame, details: DataFrame, n: int | None = None) -> DataFrame:
    """Entries with the detail page of their address, as results: blank columns of a page are filled from its entry, and where there is no
    page the entry stays, to be reviewed. ``n`` takes the first entries by page and place only."""
    d = details.select(F.col("url").alias("d_url"), F.col("id").alias("d_id"), F.col("title").alias("d_title"), "issuing_agency", "page_document_number", "published_date", "authored_date", "district").dropDuplicates(["d_url"])
    rows = items.where("url IS NOT NULL").select("id", "job_id", "target_key", "url", "title", "source_label", "page_number", "item_index")
    if n is not None:
        rows = rows.orderBy("page_number", "item_index", "id").limit(n)
    joined = rows.join(d, F.col("url") == F.col("d_url"), "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    lacks = (blank("issuing_agency") == "") | F.col("published_date").isNull()
    outcome = F.when(F.col("d_id").isNull(), "exception").when(lacks, "review_required").otherwise("checked_complete")
    return joined.select("id", F.col("d_id").alias("document_id"), F.coalesce(F.nullif("d_title", F.lit("")), "title").alias("title"), F.coalesce(F.nullif("district", F.lit("")), "source_label").alias("source"), blank("issuing_agency").alias("agency"), blank("page_document_number").alias("number"), "published_date", "authored_date", outcome.alias("outcome"))


def counters(items: DataFrame, findings: DataFrame) -> DataFrame:
    """(job_id, examined, processed, skipped, exceptions, findings) of each job, from its rows: nothing is counted up anywhere."""
    work = generation_items(items).groupBy("job_id").agg(F.count(F.lit(1)).alias("examined"), F.count_if(F.col("detail_status").isin(*PERFORMED)).alias("processed"), F.count_if(F.col("state") == "reused").alias("skipped"), F.count_if(F.col("state") == "review").alias("exceptions"))
    found = findings.where("job_id IS NOT NULL").groupBy("job_id").agg(F.countDistinct("id").alias("findings"))
    return work.join(found, "job_id", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))


def batches(headers: DataFrame, size: int) -> DataFrame:
    """(job_id, n_batches, in_last, state) of each job in batches of ``size`` entries: partial while entries are left after the first."""
    n = headers.groupBy("job_id").agg(F.sum("discovered").alias("n"))
    return n.select("job_id", F.ceil(F.col("n") / size).cast("bigint").alias("n_batches"), (F.col("n") - (F.ceil(F.col("n") / size) - 1) * size).cast("bigint").alias("in_last"), F.when(F.col("n") > size, "partial").otherwise("completed").alias("state"))


def contracts(jobs: DataFrame, items: DataFrame, current: int) -> DataFrame:
    """(id, version, may_resume, may_be_baseline) of each job: rows written under an older contract than the current one can neither
    be gone on with nor reused. A job without rows has no contract to break."""
    v = items.groupBy(F.col("job_id").alias("id")).agg(F.min(F.coalesce("link_check_version", F.lit(0))).alias("version"))
    now = F.coalesce(F.col("version") >= current, F.lit(True))
    joined = jobs.select("id", "status", "mode").join(v, "id", "left")
    return joined.select("id", "version", (now & F.col("status").isin(*RESUMABLE)).alias("may_resume"), (now & F.col("version").isNotNull() & (F.col("status") == "completed") & (F.col("mode") == "full")).alias("may_be_baseline"))


def concurrency(jobs: DataFrame) -> DataFrame:
    """(id, n_running, n_of_site) at the start of each job, itself included: sums over starts and ends in order of time. Jobs have
    one row per run."""
    timed = jobs.where("started_at IS NOT NULL AND finished_at IS NOT NULL AND finished_at >= started_at").select("id", signature(F.col("source_signature")).alias("signature"), "started_at", "finished_at")
    moves = timed.select("id", "signature", F.col("started_at").alias("t"), F.lit(1).alias("move")).unionByName(timed.select("id", "signature", F.col("finished_at").alias("t"), F.lit(-1).alias("move")))
    order = [F.col("t"), F.col("move"), F.col("id")]  # an end frees its place before a start at the same time
    upto = lambda w: F.sum("move").over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")
    placed = moves.withColumn("day", F.lit(0))
    return placed.select("id", "move", upto(Window.partitionBy("day")).alias("n_running"), upto(Window.partitionBy("signature")).alias("n_of_site")).where("move = 1").drop("move")


def last_seen(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(id, first_seen_job_id, last_seen_job_id) of documents after the jobs that listed them: the first stays, the last only moves on."""
    seen = items.select("job_id", R.effective_document().alias("id")).where("id IS NOT NULL").groupBy("id").agg(F.max("job_id").alias("seen"))
    return docs.select("id", "first_seen_job_id", "last_seen_job_id").join(seen, "id", "left").select("id", "first_seen_job_id", F.greatest("last_seen_job_id", "seen").alias("last_seen_job_id"))
