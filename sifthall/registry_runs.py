"""Queries on jobs, generations, plans, schedules, exceptions and the report's sheets, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifthall.functions import text as T
from sifthall.operators import accesslog as A
from sifthall.operators import report
from sifthall.operators import runs as J
from sifthall.registry import _GAP, _NUMBER, _NUMBERED, _SPACE, big, days, query

_STATE = "CASE detail_status WHEN 'pending' THEN 'pending' WHEN 'review_required' THEN 'review' WHEN 'exception' THEN 'retry' WHEN 'reused' THEN 'reused' WHEN 'skipped' THEN 'reused' ELSE 'completed' END"
_G = f"""g AS (SELECT *, {_STATE} AS state FROM (SELECT *, row_number() OVER (PARTITION BY job_id, target_key, url ORDER BY checked_at DESC NULLS LAST, id DESC) AS n FROM scan_item_results WHERE url IS NOT NULL AND target_key IS NOT NULL) WHERE n = 1),
o AS (SELECT job_id, target_key, count(DISTINCT CAST(page_number AS VARCHAR) || '~' || CAST(item_index AS VARCHAR)) AS observed, count(*) AS n_rows FROM scan_item_results WHERE url IS NOT NULL AND target_key IS NOT NULL GROUP BY 1, 2),
h AS (SELECT *, open = 0 AND discovered > 0 AND terminal = discovered AND n_rows >= terminal AND observed IN (0, discovered) AS ok FROM (
  SELECT job_id, target_key, count(*) AS discovered, count(*) FILTER (state IN ('completed', 'reused')) AS completed, count(*) FILTER (state = 'reused') AS reused, count(*) FILTER (state = 'retry') AS retry, count(*) FILTER (state = 'review') AS review,
  count(*) FILTER (state IN ('completed', 'reused', 'review')) AS terminal, count(*) FILTER (state IN ('pending', 'checking', 'retry')) AS open FROM g GROUP BY 1, 2) JOIN o USING (job_id, target_key))"""
_SIG = "array_to_string(list_sort(source_signature), '|')"
_AT = "(SELECT max(started_at) FROM scan_jobs WHERE finished_at > started_at)"
_THEN = f"j AS (SELECT * REPLACE (CASE WHEN started_at > {_AT} OR started_at IS NULL THEN 'pending' WHEN finished_at > {_AT} THEN 'running' ELSE status END AS status), {_SIG} AS signature FROM scan_jobs WHERE created_at <= {_AT})"
_BASE = f"""b AS (SELECT j.id, {_SIG} AS signature, n, n - terminal AS n_open FROM scan_jobs j JOIN (SELECT job_id, sum(discovered) AS n, sum(observed) AS observed, sum(terminal) AS terminal, array_to_string(list_sort(list(DISTINCT target_key)), '|') AS targets FROM h GROUP BY 1) t ON t.job_id = j.id
  WHERE mode = 'full' AND status = 'completed' AND coverage_status = 'complete' AND n > 0 AND n = t.observed AND targets = {_SIG})"""
_SCHEDULE = f"""s AS (SELECT signature, last.id AS last_job_id, last.status AS last_status, last_full_at, last_incremental_at,
  CASE WHEN last.status <> 'completed' AND last.mode = 'full' THEN last.finished_at + INTERVAL 15 MINUTE ELSE last_full_at + INTERVAL 7 DAY END AS next_full_at, CASE WHEN last.status <> 'completed' THEN last.finished_at + INTERVAL 15 MINUTE ELSE last.finished_at + INTERVAL 6 HOUR END AS next_incremental_at
  FROM (SELECT {_SIG} AS signature, arg_max({{'id': id, 'mode': mode, 'status': status, 'finished_at': finished_at}}, (finished_at, id)) AS last, max(finished_at) FILTER (status = 'completed' AND mode = 'full') AS last_full_at, max(finished_at) FILTER (status = 'completed' AND mode <> 'full') AS last_incremental_at
  FROM scan_jobs WHERE finished_at IS NOT NULL GROUP BY 1))"""
_MICROS = ("last_full_at", "last_incremental_at", "next_full_at", "next_incremental_at")


def latest_start(jobs: DataFrame):
    """The time of the last start of a job that ended: the moment that queries ask about, at which that job was running."""
    return F.lit(jobs.where("finished_at > started_at").agg(F.max("started_at").alias("t")).first()["t"])


def micros(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.unix_micros(c) for c in columns})


# --- generations and coverage -------------------------------------------------------------------------------------


@query("scan_item_results", sql=f"WITH {_G} SELECT job_id, target_key, discovered, completed, reused, retry, review FROM h")
def generation_header(items: DataFrame) -> DataFrame:
    return J.generations(items).select("job_id", "target_key", "discovered", "completed", "reused", "retry", "review")


@query("scan_item_results", sql=f"WITH {_G} SELECT job_id, target_key, terminal, open, discovered, observed, n_rows, ok FROM h")
def generation_coverage(items: DataFrame) -> DataFrame:
    return J.generations(items).select("job_id", "target_key", "terminal", "open", "discovered", "observed", "n_rows", "ok")


@query("scan_item_results", sql=f"WITH {_G} SELECT job_id, count(*) AS n_generations, CAST(sum(discovered) AS BIGINT) AS discovered, CAST(sum(completed) AS BIGINT) AS completed, CAST(sum(reused) AS BIGINT) AS reused, CAST(sum(retry) AS BIGINT) AS retry, CAST(sum(review) AS BIGINT) AS review, CAST(sum(open) AS BIGINT) AS open, max(observed) AS largest FROM h GROUP BY 1")
def job_totals(items: DataFrame) -> DataFrame:
    return J.job_totals(J.generations(items))


@query("scan_item_results", sql=f"WITH {_G} SELECT target_key, arg_max(job_id, job_id) AS job_id, arg_max(discovered, job_id) AS discovered, arg_max(terminal, job_id) AS terminal, arg_max(ok, job_id) AS ok FROM h GROUP BY 1")
def latest_generation(items: DataFrame) -> DataFrame:
    return J.latest_generation(J.generations(items))


@query("scan_item_results", sql=f"WITH {_G} SELECT job_id, target_key, url, state, CAST(page_number AS BIGINT) AS page_number, CAST(item_index AS BIGINT) AS item_index, document_id, reused_document_id FROM g")
def generation_entries(items: DataFrame) -> DataFrame:
    return big(J.generation_items(items).select("job_id", "target_key", "url", "state", "page_number", "item_index", "document_id", "reused_document_id"))


@query("scan_jobs", "scan_item_results", sql=f"""
WITH {_G}, e AS (SELECT job_id, string_agg(own, '; ' ORDER BY target_key) AS each FROM (SELECT job_id, target_key, nullif(concat_ws('; ', CASE WHEN terminal <> discovered THEN target_key || ': ' || terminal || ' of ' || discovered || ' entries are done' END, CASE WHEN observed > 0 AND observed <> discovered THEN target_key || ': list showed ' || observed || ', ' || discovered || ' are known' END), '') AS own FROM h) GROUP BY 1),
t AS (SELECT job_id, sum(open)::BIGINT AS open, sum(discovered)::BIGINT AS discovered, sum(terminal)::BIGINT AS terminal, sum(n_rows)::BIGINT AS n_rows, sum(observed)::BIGINT AS observed FROM h GROUP BY 1),
w AS (SELECT job_id, count(*) FILTER (state = 'reused') AS skipped, count(*) FILTER (detail_status IN ('checked_complete', 'checked_incomplete', 'no_header')) AS processed FROM g GROUP BY 1),
z AS (SELECT j.id, j.mode, each, coalesce(open, 0) AS open, coalesce(discovered, 0) AS discovered, coalesce(terminal, 0) AS terminal, coalesce(n_rows, 0) AS n_rows, coalesce(observed, 0) AS observed, coalesce(skipped, 0) AS skipped, coalesce(processed, 0) AS processed FROM scan_jobs j LEFT JOIN e ON e.job_id = j.id LEFT JOIN t ON t.job_id = j.id LEFT JOIN w ON w.job_id = j.id)
SELECT id, CASE WHEN mode = 'full' THEN concat_ws('; ', each, CASE WHEN open > 0 THEN open || ' entries are open' END, CASE WHEN discovered <= 0 THEN 'no entry is known' END, CASE WHEN terminal > 0 AND n_rows = 0 THEN 'no results' END)
ELSE concat_ws('; ', CASE WHEN discovered <> observed THEN 'covered ' || discovered || ' of ' || observed END, CASE WHEN n_rows <> discovered THEN n_rows || ' results for ' || discovered || ' covered' END, CASE WHEN processed + skipped <> discovered THEN processed || ' checked and ' || skipped || ' skipped are not ' || discovered END) END AS mismatches FROM z""")
def reconciliation(jobs: DataFrame, items: DataFrame) -> DataFrame:
    return J.reconciled(jobs, items)


@query("scan_jobs", "scan_item_results", sql=f"WITH {_G}, t AS (SELECT job_id, sum(terminal)::BIGINT AS examined, sum(greatest(observed, discovered))::BIGINT AS total FROM h GROUP BY 1) SELECT id, coalesce(examined, 0) AS examined, coalesce(total, 0) AS total, greatest(coalesce(total, 0) - coalesce(examined, 0), 0) AS remaining, CASE WHEN total > 0 THEN least(100, (100 * examined) // total) ELSE 0 END AS percent FROM scan_jobs LEFT JOIN t ON t.job_id = id")
def job_progress(jobs: DataFrame, items: DataFrame) -> DataFrame:
    return J.progress(jobs, J.generations(items))


# --- jobs and plans -----------------------------------------------------------------------------------------------


@query("scan_jobs", sql=f"WITH {_THEN} SELECT id, status, signature FROM j WHERE status IN ('pending', 'running', 'cooling')")
def active_jobs(jobs: DataFrame) -> DataFrame:
    return J.active(J.status_at(jobs, latest_start(jobs))).select("id", "status", J.signature(F.col("source_signature")).alias("signature"))


@query("scan_jobs", sql="SELECT id, mode, status FROM scan_jobs ORDER BY id DESC LIMIT 30")
def recent_jobs(jobs: DataFrame) -> DataFrame:
    return J.recent(jobs).select("id", "mode", "status")


@query("scan_jobs", sql=f"WITH {_THEN} SELECT id, status FROM j WHERE status IN ('pending', 'running', 'cooling') ORDER BY id DESC LIMIT 1")
def latest_active_job(jobs: DataFrame) -> DataFrame:
    return J.recent(J.active(J.status_at(jobs, latest_start(jobs))), 1).select("id", "status")


@query("scan_jobs", "scan_item_results", sql=f"WITH {_G}, {_BASE} SELECT id, signature, CAST(n AS BIGINT) AS n, CAST(n_open AS BIGINT) AS n_open FROM b")
def valid_baselines(jobs: DataFrame, items: DataFrame) -> DataFrame:
    return J.valid_baselines(jobs, J.generations(items))


@query("scan_jobs", "scan_item_results", sql=f"""
WITH {_G}, {_BASE}, {_THEN}, l AS (SELECT signature, max(id) AS job_id, arg_max(status, id) AS status, arg_max(mode, id) AS mode FROM j GROUP BY 1), n AS (SELECT signature, max(id) AS baseline_id FROM b GROUP BY 1),
p AS (SELECT l.*, baseline_id, status IN ('pending', 'running', 'cooling', 'paused', 'partial', 'failed') AND (baseline_id IS NULL OR job_id > baseline_id) AS go FROM l LEFT JOIN n ON n.signature = l.signature)
SELECT signature, job_id, CASE WHEN go AND status IN ('pending', 'running', 'cooling') THEN 'existing' WHEN go THEN 'resume' ELSE 'create' END AS action, CASE WHEN go THEN mode WHEN baseline_id IS NULL THEN 'full' ELSE 'incremental' END AS next_mode, baseline_id FROM p""")
def automatic_plan(jobs: DataFrame, items: DataFrame) -> DataFrame:
    return J.automatic_plan(J.status_at(jobs, latest_start(jobs)), J.valid_baselines(jobs, J.generations(items)))


@query("scan_jobs", sql=f"""
WITH {_THEN}, c AS (SELECT unnest(['pause', 'stop', 'resume']) AS command), m AS (SELECT * FROM (VALUES ('pause', 'pending', 'paused'), ('pause', 'running', 'paused'), ('pause', 'cooling', 'paused'), ('stop', 'pending', 'stopped'), ('stop', 'running', 'stopped'), ('stop', 'paused', 'stopped'), ('stop', 'partial', 'stopped'), ('stop', 'cooling', 'stopped'), ('stop', 'failed', 'stopped'),
  ('resume', 'paused', 'pending'), ('resume', 'partial', 'pending'), ('resume', 'cooling', 'pending'), ('resume', 'failed', 'pending')) t(command, status, target)),
x AS (SELECT j.id, c.command, m.target, (SELECT count(*) FROM j k WHERE k.signature = j.signature AND k.id <> j.id AND k.status IN ('pending', 'running', 'cooling')) AS others, regexp_matches(coalesce(pause_reason, ''), '访问受限|HTTP 403|HTTP 429|验证码|访问频繁|安全冷却') AS cooling FROM j CROSS JOIN c LEFT JOIN m ON m.command = c.command AND m.status = j.status)
SELECT id, command, CASE WHEN target IS NULL OR (command = 'resume' AND (others > 0 OR cooling)) THEN NULL ELSE target END AS next_status, CASE WHEN target IS NULL THEN 'not allowed in this state' WHEN command = 'resume' AND others > 0 THEN 'another job of these sources is active' WHEN command = 'resume' AND cooling THEN 'cooling down' END AS violation FROM x""")
def job_commands(jobs: DataFrame) -> DataFrame:
    return J.commanded(J.status_at(jobs, latest_start(jobs)))


@query("scan_jobs", sql=f"WITH {_THEN} SELECT signature, CASE WHEN count(*) FILTER (status IN ('pending', 'running', 'cooling')) > 0 THEN 'existing' ELSE 'create' END AS action, max(id) FILTER (status IN ('pending', 'running', 'cooling')) AS job_id FROM j GROUP BY 1")
def job_starts(jobs: DataFrame) -> DataFrame:
    return J.started(J.status_at(jobs, latest_start(jobs)), full=False)


@query("scan_jobs", sql=f"WITH {_THEN} SELECT signature, CASE WHEN (SELECT count(*) FROM j k WHERE k.status IN ('pending', 'running', 'cooling')) > 0 THEN 'refused' ELSE 'create' END AS action, max(id) FILTER (status IN ('pending', 'running', 'cooling')) AS job_id FROM j GROUP BY 1")
def full_rebuild_starts(jobs: DataFrame) -> DataFrame:
    return J.started(J.status_at(jobs, latest_start(jobs)), full=True)


@query("scan_jobs", sql=f"WITH {_THEN} SELECT id, CASE WHEN status IN ('pending', 'running') THEN 'paused' ELSE status END AS status, CASE WHEN status IN ('pending', 'running') THEN 'interrupted' ELSE pause_reason END AS pause_reason, CASE WHEN status IN ('pending', 'running') THEN 'partial' ELSE coverage_status END AS coverage_status FROM j")
def recovered_jobs(jobs: DataFrame) -> DataFrame:
    return J.recovered(J.status_at(jobs, latest_start(jobs))).select("id", "status", "pause_reason", "coverage_status")


@query("scan_jobs", sql=f"WITH {_SCHEDULE} SELECT signature, last_job_id, last_status, epoch_us(last_full_at) AS last_full_at, epoch_us(last_incremental_at) AS last_incremental_at, epoch_us(next_full_at) AS next_full_at, epoch_us(next_incremental_at) AS next_incremental_at FROM s")
def job_schedules(jobs: DataFrame) -> DataFrame:
    return micros(J.schedules(jobs), *_MICROS)


@query("scan_jobs", "scan_item_results", sql=f"""
WITH {_G}, {_BASE}, {_THEN}, {_SCHEDULE}, n AS (SELECT signature, max(id) AS baseline_id FROM b GROUP BY 1)
SELECT s.signature, CASE WHEN next_full_at <= {_AT} THEN 'full' WHEN baseline_id IS NOT NULL THEN 'incremental' ELSE 'first full' END AS kind, baseline_id FROM s LEFT JOIN n ON n.signature = s.signature
WHERE (next_full_at <= {_AT} OR next_incremental_at <= {_AT}) AND s.signature NOT IN (SELECT signature FROM j WHERE status IN ('pending', 'running', 'cooling'))""")
def due_schedules(jobs: DataFrame, items: DataFrame) -> DataFrame:
    at = latest_start(jobs)
    return J.due(J.schedules(jobs), J.status_at(jobs, at), J.valid_baselines(jobs, J.generations(items)), at)


@query("scan_jobs", "scan_item_results", sql=f"""
WITH {_G}, {_BASE}, {_SCHEDULE}, l AS (SELECT {_SIG} AS signature, max(id) AS job_id, arg_max(status, id) AS status, arg_max(mode, id) AS mode FROM scan_jobs GROUP BY 1), n AS (SELECT signature, max(id) AS baseline_id FROM b GROUP BY 1), p AS (SELECT l.*, baseline_id, status IN ('pending', 'running', 'cooling', 'paused', 'partial', 'failed') AND (baseline_id IS NULL OR job_id > baseline_id) AS go FROM l LEFT JOIN n ON n.signature = l.signature)
SELECT p.signature, job_id, CASE WHEN go AND status IN ('pending', 'running', 'cooling') THEN 'existing' WHEN go THEN 'resume' ELSE 'create' END AS action, CASE WHEN go THEN mode WHEN baseline_id IS NULL THEN 'full' ELSE 'incremental' END AS next_mode, baseline_id, last_status, epoch_us(next_full_at) AS next_full_at, epoch_us(next_incremental_at) AS next_incremental_at FROM p LEFT JOIN s ON s.signature = p.signature""")
def site_status(jobs: DataFrame, items: DataFrame) -> DataFrame:
    sites = jobs.select(J.signature(F.col("source_signature")).alias("signature"))
    return micros(J.site_status(sites, J.automatic_plan(jobs, J.valid_baselines(jobs, J.generations(items))), J.schedules(jobs)), "next_full_at", "next_incremental_at")


@query("scan_jobs", "scan_item_results", sql=f"SELECT DISTINCT signature, j.target_key, source_label, level FROM (SELECT {_SIG} AS signature, unnest(source_signature) AS target_key, CASE WHEN len(source_signature) > 1 THEN 'district' ELSE 'city' END AS level FROM scan_jobs) j LEFT JOIN (SELECT target_key, min(source_label) AS source_label FROM scan_item_results GROUP BY 1) t ON t.target_key = j.target_key")
def site_targets(jobs: DataFrame, items: DataFrame) -> DataFrame:
    return J.site_targets(jobs, items)


@query("scan_jobs", sql="SELECT id, regexp_matches(coalesce(pause_reason, ''), '访问受限|HTTP 403|HTTP 429|验证码|访问频繁|安全冷却') AS cooling, starts_with(coalesce(pause_reason, ''), '页码') AS page_check_failed FROM scan_jobs")
def pause_reasons(jobs: DataFrame) -> DataFrame:
    return jobs.select("id", J.cooling_reason(F.col("pause_reason")).alias("cooling"), F.startswith(F.coalesce("pause_reason", F.lit("")), F.lit("页码")).alias("page_check_failed"))


@query("scan_jobs", "rule_findings", sql="SELECT j.id AS job_id, f.id AS finding_id, f.rule_code, j.mode FROM scan_jobs j JOIN rule_findings f ON f.job_id = j.id WHERE f.rule_code IN ('META-001', 'DATE-001')")
def events_of_jobs(jobs: DataFrame, findings: DataFrame) -> DataFrame:
    return jobs.select(F.col("id").alias("job_id"), "mode").join(findings.where(F.col("rule_code").isin("META-001", "DATE-001")).select("job_id", F.col("id").alias("finding_id"), "rule_code"), "job_id")


# --- entries ------------------------------------------------------------------------------------------------------

_EXCEPTIONS = """e AS (SELECT job_id, url, CASE WHEN NOT still THEN 'resolved' WHEN n_bad > 1 THEN 'review_required' ELSE 'pending' END AS status, n_bad - 1 AS retry_count, first_id, last_id, page_number, item_index FROM (
  SELECT job_id, url, count(*) FILTER (bad) AS n_bad, arg_min(id, (t, id)) FILTER (bad) AS first_id, arg_max(id, (t, id)) AS last_id, arg_max(bad, (t, id)) AS still, arg_max(CAST(page_number AS BIGINT), (t, id)) AS page_number, arg_max(CAST(item_index AS BIGINT), (t, id)) AS item_index
  FROM (SELECT *, detail_status = 'review_required' AS bad, coalesce(checked_at, TIMESTAMPTZ '1900-01-01') AS t FROM scan_item_results WHERE url IS NOT NULL) GROUP BY 1, 2) WHERE n_bad > 0)"""


@query("scan_item_results", sql=f"WITH {_EXCEPTIONS} SELECT * FROM e")
def scan_exceptions(items: DataFrame) -> DataFrame:
    return big(J.exceptions(items))


@query("scan_item_results", sql=f"WITH {_EXCEPTIONS} SELECT job_id, url, page_number, item_index FROM e WHERE status = 'pending'")
def exceptions_to_retest(items: DataFrame) -> DataFrame:
    return big(J.pending_exceptions(J.exceptions(items)).select("job_id", "url", "page_number", "item_index"))


@query("scan_item_results", "scan_jobs", sql="SELECT r.id, r.job_id, r.url FROM scan_item_results r JOIN scan_jobs j ON j.id = r.job_id WHERE j.id = (SELECT max(id) FROM scan_jobs) AND detail_status NOT IN ('exception', 'review_required')")
def sound_rows_of_last_job(items: DataFrame, jobs: DataFrame) -> DataFrame:
    last = jobs.agg(F.max("id").alias("job_id"))
    return items.where(~F.col("detail_status").isin("exception", "review_required")).join(F.broadcast(last), "job_id").select("id", "job_id", "url")


@query("scan_item_results", "scan_jobs", "link_checks", sql="""
WITH latest AS (SELECT * FROM (SELECT *, coalesce(nullif(document_id, 0), nullif(reused_document_id, 0)) AS doc, row_number() OVER (PARTITION BY job_id, target_key, url ORDER BY checked_at DESC NULLS LAST, id DESC) AS n FROM scan_item_results WHERE url IS NOT NULL) WHERE n = 1),
hidden AS (SELECT DISTINCT document_id, job_id FROM link_checks WHERE NOT coalesce(visible, FALSE) OR review_status = 'legacy_hidden' OR trim(coalesce(source_area, '')) = ''),
base AS (SELECT i.id FROM scan_item_results i JOIN scan_jobs j ON j.id = i.job_id AND j.baseline_job_id IS NOT NULL JOIN latest b ON b.job_id = j.baseline_job_id AND b.target_key = i.target_key AND b.url = i.url LEFT JOIN hidden h ON h.document_id = b.doc AND h.job_id = b.job_id
  WHERE trim(i.title, ' ') = trim(b.title, ' ') AND i.listed_date IS NOT DISTINCT FROM b.listed_date AND coalesce(b.link_check_version, 0) >= 1 AND b.detail_status NOT IN ('exception', 'review_required', 'checked_incomplete') AND h.document_id IS NULL AND (contains(b.detail_status, 'no_header') OR (len(b.missing_fields) = 0 AND b.doc IS NOT NULL))),
run AS (SELECT DISTINCT id FROM (SELECT *, first_value(id) OVER w AS first_id, min(target_key) OVER (PARTITION BY job_id, url) AS low, max(target_key) OVER (PARTITION BY job_id, url) AS high FROM scan_item_results WHERE url IS NOT NULL WINDOW w AS (PARTITION BY job_id, url ORDER BY target_key, coalesce(page_number, 0), coalesce(item_index, 0), id)) WHERE low <> high AND id <> first_id),
cur AS (SELECT job_id, url, id AS current_id, detail_status AS current_status FROM (SELECT *, row_number() OVER (PARTITION BY job_id, url ORDER BY detail_status IN ('checked_complete', 'checked_incomplete', 'no_header') DESC, checked_at DESC NULLS LAST, id DESC) AS n FROM scan_item_results WHERE url IS NOT NULL AND coalesce(link_check_version, 0) >= 1) WHERE n = 1 AND detail_status IN ('checked_complete', 'checked_incomplete', 'no_header')),
p AS (SELECT i.id, coalesce(i.header_detected, FALSE) AS header, current_status, CASE WHEN run.id IS NOT NULL THEN 'run' WHEN current_id = i.id THEN 'done' WHEN current_id IS NOT NULL THEN 'job' WHEN base.id IS NOT NULL THEN 'baseline' ELSE 'open' END AS path FROM scan_item_results i LEFT JOIN run ON run.id = i.id LEFT JOIN cur ON cur.job_id = i.job_id AND cur.url = i.url LEFT JOIN (SELECT DISTINCT id FROM base) base ON base.id = i.id WHERE i.url IS NOT NULL)
SELECT id, path, CASE WHEN path = 'done' THEN current_status WHEN path IN ('run', 'job') THEN 'reused_current_' || CASE WHEN header THEN 'detail' ELSE 'no_header' END WHEN path = 'baseline' THEN 'reused_baseline_' || CASE WHEN header THEN 'detail' ELSE 'no_header' END ELSE 'to_open' END AS next_status FROM p""")
def processing_precedence(items: DataFrame, jobs: DataFrame, links: DataFrame) -> DataFrame:
    return J.precedence(items, jobs, links)


@query("scan_item_results", "policy_documents", sql=rf"""
WITH t AS (SELECT max(last_detail_checked_at) AS as_of FROM policy_documents), s AS (SELECT i.id, i.listed_date, regexp_replace(i.title, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS title, d.id AS document_id, regexp_replace(d.title, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS d_title, d.published_date, d.last_detail_checked_at AS checked FROM scan_item_results i LEFT JOIN policy_documents d ON d.url = i.url WHERE i.url IS NOT NULL)
SELECT id, CASE WHEN document_id IS NULL THEN 'new' WHEN title IS DISTINCT FROM d_title THEN 'title changed' WHEN listed_date IS NOT NULL AND listed_date IS DISTINCT FROM published_date THEN 'date changed' WHEN checked IS NULL THEN 'never checked' WHEN checked < as_of - INTERVAL 30 DAY THEN 'checked too long ago' ELSE 'fresh' END AS reason, document_id FROM s, t""")
def refresh_decision(items: DataFrame, docs: DataFrame) -> DataFrame:
    return J.fresh_enough(items, docs, F.lit(docs.agg(F.max("last_detail_checked_at").alias("t")).first()["t"]))


@query("scan_item_results", "link_checks", sql="SELECT r.job_id, l.document_id, l.original_url, l.source_area, l.source_page_url, l.link_text, arg_max(l.result, l.id) AS result, CAST(arg_max({'s': l.status_code}, l.id).s AS BIGINT) AS status_code FROM (SELECT DISTINCT job_id, reused_document_id AS d, baseline_job_id AS b FROM scan_item_results WHERE reused_document_id IS NOT NULL AND baseline_job_id IS NOT NULL) r JOIN link_checks l ON l.job_id = r.b AND l.document_id = r.d WHERE visible AND review_status <> 'legacy_hidden' AND trim(coalesce(source_area, '')) <> '' AND trim(coalesce(source_page_url, '')) <> '' GROUP BY 1, 2, 3, 4, 5, 6")
def copied_links(items: DataFrame, links: DataFrame) -> DataFrame:
    return big(J.copied_links(items, links))


@query("scan_item_results", sql="""
WITH k AS (SELECT *, CASE WHEN coalesce(url, '') <> '' THEN 'url:' || url ELSE 'place:|' || page_number || '|' || item_index END AS entry FROM scan_item_results WHERE page_number IS NOT NULL AND item_index IS NOT NULL AND target_key IS NOT NULL), o AS (SELECT job_id, target_key, entry, max(id) AS id, arg_max(CAST(page_number AS BIGINT), id) AS page_number, arg_max(CAST(item_index AS BIGINT), id) AS item_index, arg_max(detail_status, id) AS detail_status FROM k GROUP BY 1, 2, 3)
SELECT job_id, target_key, entry, id, page_number, CASE WHEN id = max(id) OVER (PARTITION BY job_id, target_key, page_number, item_index) THEN item_index ELSE -id END AS item_index, detail_status FROM o""")
def upsert_items(items: DataFrame) -> DataFrame:
    return big(J.by_address_or_place(items))


@query("link_checks", sql="""
WITH r AS (SELECT id, link_kind AS key, lower(regexp_extract(original_url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM link_checks WHERE original_url IS NOT NULL AND link_kind IS NOT NULL), c AS (SELECT key, arg_max(host, (n, host)) AS expected FROM (SELECT key, host, count(*) AS n FROM r WHERE host <> '' GROUP BY 1, 2) GROUP BY 1)
SELECT id, nullif(host, '') AS host, expected FROM r JOIN c ON c.key = r.key WHERE nullif(host, '') IS DISTINCT FROM expected""")
def wrong_hosts(links: DataFrame) -> DataFrame:
    return J.wrong_hosts(links, "link_kind", "original_url")


@query("scan_item_results", sql="SELECT target_key, url, min(job_id) AS first_job_id, max(job_id) AS last_job_id, arg_max(document_id, (job_id, id)) FILTER (document_id IS NOT NULL) AS last_document_id, arg_max(detail_status, (job_id, id)) AS last_status FROM scan_item_results WHERE url IS NOT NULL AND target_key IS NOT NULL GROUP BY 1, 2")
def upsert_inventory(items: DataFrame) -> DataFrame:
    """Entries of each target over two deliveries: the first job stays, the last document that is known wins."""
    from sifthall.plans.merge import keyed_upsert

    rows = items.where("url IS NOT NULL AND target_key IS NOT NULL").select("target_key", "url", F.col("job_id").alias("first_job_id"), F.col("job_id").alias("last_job_id"), F.col("document_id").alias("last_document_id"), F.col("detail_status").alias("last_status"), "id")
    middle = rows.agg(F.percentile_approx("last_job_id", 0.5)).first()[0] or 0
    kinds = {"key": ["target_key", "url"], "order": [F.col("last_job_id"), F.col("id")], "keep": ["first_job_id"], "fill": ["last_document_id"]}
    old = keyed_upsert(rows.limit(0), rows.where(F.col("last_job_id") <= middle), **kinds)
    return keyed_upsert(old, rows.where(F.col("last_job_id") > middle), **kinds).drop("id")


# --- the report ---------------------------------------------------------------------------------------------------

_F = "f AS (SELECT f.*, d.district, d.source_id, d.source_site, d.title, d.url, d.issuing_agency, d.page_document_number, d.published_date, d.authored_date, d.number FROM rule_findings f JOIN (" + _NUMBERED + ") d ON d.id = f.document_id)"
_TYPE, _YEAR, _INDEX = (f"nullif(regexp_extract(number, '{_NUMBER}', {n}), '')" for n in (1, 2, 3))


@query("rule_findings", "policy_documents", sql=f"WITH {_F} SELECT id, coalesce(nullif(source_site, ''), '市级平台') AS source, district, title, authored_date, published_date, TRY_CAST(nullif(regexp_extract(detail, '相隔{_SPACE}*(\\d+){_SPACE}*个工作日', 1), '') AS BIGINT) AS workdays, CASE WHEN rule_code = 'DATE-002' THEN '日期倒置' ELSE '超期' END AS time_state, page_document_number, rule_code, detail, review_status, url FROM f WHERE category = '日期问题'")
def sheet_dates(findings: DataFrame, docs: DataFrame) -> DataFrame:
    return report.sheet_dates(findings, docs)


@query("rule_findings", "policy_documents", sql=f"WITH {_F} SELECT id, coalesce(nullif(source_site, ''), '市级平台') AS source, district, title, {_TYPE} AS number_type, CAST({_YEAR} AS BIGINT) AS number_year, CAST({_INDEX} AS BIGINT) AS number_index, number, issuing_agency, body_value, rule_code, detail, evidence, review_status FROM f WHERE category IN ('文号问题', '机构问题')")
def sheet_numbers(findings: DataFrame, docs: DataFrame) -> DataFrame:
    return big(report.sheet_numbers(findings, docs))


@query("link_checks", "policy_documents", sql="SELECT l.id, coalesce(nullif(source_site, ''), '市级平台') AS source, district, d.title, link_kind, source_area, link_text, source_page_url, original_url, final_url, CAST(status_code AS BIGINT) AS status_code, result, error_type, array_to_string(redirect_chain, ' ') AS chain, page_title, d.url AS document_url FROM link_checks l JOIN policy_documents d ON d.id = l.document_id WHERE visible AND review_status = 'confirmed' AND result IN ('broken', 'error') AND trim(coalesce(source_area, '')) <> '' AND trim(coalesce(source_page_url, '')) <> ''")
def sheet_links(links: DataFrame, docs: DataFrame) -> DataFrame:
    return big(report.sheet_links(links, docs))


@query("scan_item_results", "rule_findings", sql=f"""
WITH f AS (SELECT job_id, document_id, count(*) AS n, string_agg(rule_code, '、' ORDER BY id, rule_code, detail) AS codes, string_agg(detail, '；' ORDER BY id, rule_code, detail) AS details FROM rule_findings GROUP BY 1, 2),
i AS (SELECT *, {_GAP} AS gap FROM (SELECT *, CASE WHEN regexp_matches(solid, '{_NUMBER}') THEN regexp_replace(regexp_extract(solid, '{_NUMBER}', 1), '^(?:另见|参见|以及|及|见|根据|依据|文件)', '') || '〔' || regexp_extract(solid, '{_NUMBER}', 2) || '〕' || CAST(CAST(regexp_extract(solid, '{_NUMBER}', 3) AS INT) AS VARCHAR) || '号' ELSE solid END AS number FROM (SELECT *, translate(regexp_replace(translate(page_document_number, '【】[]（）', '〔〕〔〕〔〕'), '{_SPACE}+', '', 'g'), '０１２３４５６７８９', '0123456789') AS solid FROM scan_item_results)))
SELECT i.id, source_label, channel_id, CAST(page_number AS BIGINT) AS page_number, CAST(item_index + 1 AS BIGINT) AS place, listed_date, title, CASE WHEN NOT coalesce(header_detected, FALSE) THEN '无表头' WHEN len(missing_fields) > 0 THEN '表头不完整' ELSE '表头完整' END AS header_state, source_id, topic_category, disclosure_attribute, authored_date, page_document_number, published_date, issuing_agency, array_to_string(missing_fields, '、') AS missing,
CAST(gap AS BIGINT) AS workdays, CASE WHEN published_date IS NULL OR authored_date IS NULL THEN '待复核' WHEN published_date < authored_date THEN '日期倒置' WHEN gap > 20 THEN '超期' ELSE '合规' END AS time_state, {_TYPE} AS number_type, CAST({_YEAR} AS BIGINT) AS number_year, CAST({_INDEX} AS BIGINT) AS number_index, number,
coalesce(codes, '') AS codes, coalesce(details, '') AS details, coalesce(n, 0) AS n_findings, CASE detail_status WHEN 'checked_complete' THEN '表头完整，已检查' WHEN 'checked_incomplete' THEN '表头不完整，已记录问题' WHEN 'no_header' THEN '无表头 PASS' WHEN 'exception' THEN '详情异常，待复测' ELSE detail_status END AS outcome, baseline_job_id, reason, url
FROM i LEFT JOIN f ON f.job_id = i.job_id AND f.document_id = coalesce(nullif(i.document_id, 0), nullif(i.reused_document_id, 0))""")
def sheet_detail(items: DataFrame, findings: DataFrame) -> DataFrame:
    return big(report.sheet_detail(items, findings, days(items.select("authored_date", "published_date"))))


@query("scan_item_results", sql="SELECT job_id, url, source_label, channel_id, title, source_id, array_to_string(missing_fields, '、') AS missing, detail_status, reason FROM (SELECT *, row_number() OVER (PARTITION BY job_id, url ORDER BY CASE WHEN detail_status = 'checked_incomplete' THEN 2 ELSE 1 END DESC, source_label NULLS FIRST, coalesce(page_number, 0), coalesce(item_index, 0), id) AS n FROM scan_item_results WHERE len(missing_fields) > 0) WHERE n = 1")
def sheet_metadata(items: DataFrame) -> DataFrame:
    return report.sheet_metadata(items)


@query("scan_jobs", "scan_item_results", "rule_findings", sql=f"WITH {_G}, t AS (SELECT job_id, sum(terminal)::BIGINT AS examined, sum(greatest(observed, discovered))::BIGINT AS total FROM h GROUP BY 1), s AS (SELECT j.*, coalesce(examined, 0) AS examined, coalesce(total, 0) AS total FROM scan_jobs j LEFT JOIN t ON t.job_id = j.id) SELECT id AS job_id, 'job' AS kind, mode, status, CASE WHEN coverage_status = 'complete' THEN '完整' ELSE '未完成' END AS coverage, examined, total, greatest(total - examined, 0) AS remaining, CAST(access_count AS BIGINT) AS access_count, coalesce(nullif(pause_reason, ''), last_error) AS message, NULL::BIGINT AS event_id FROM s UNION ALL SELECT j.id, f.rule_code, mode, status, CASE WHEN coverage_status = 'complete' THEN '完整' ELSE '未完成' END, NULL, NULL, NULL, NULL, f.detail, f.id FROM s j JOIN rule_findings f ON f.job_id = j.id")
def sheet_runs(jobs: DataFrame, items: DataFrame, findings: DataFrame) -> DataFrame:
    return big(report.sheet_runs(jobs, J.progress(jobs, J.generations(items)), findings))


@query("scan_jobs", "scan_item_results", "rule_findings", "policy_documents", sql=f"""
WITH {_G}, p AS (SELECT g.source_label AS source, h.job_id, terminal, greatest(observed, discovered) AS total FROM h JOIN (SELECT DISTINCT job_id, target_key, first_value(source_label) OVER (PARTITION BY job_id, target_key ORDER BY source_label) AS source_label FROM scan_item_results WHERE source_label IS NOT NULL) g ON g.job_id = h.job_id AND g.target_key = h.target_key),
s AS (SELECT source, sum(terminal)::BIGINT AS examined, sum(total)::BIGINT AS total FROM p GROUP BY 1), i AS (SELECT DISTINCT job_id, source_label AS source, url, coalesce(nullif(document_id, 0), nullif(reused_document_id, 0)) AS document_id FROM scan_item_results), m AS (SELECT DISTINCT source, i.job_id, url, f.id, category FROM i JOIN rule_findings f USING (job_id, document_id)), c AS (SELECT source, category, count(*) AS n FROM m GROUP BY 1, 2)
SELECT s.source, coalesce(category, '{report.NO_ISSUE}') AS category, coalesce(n, 0) AS n, examined, total, greatest(total - examined, 0) AS remaining FROM s LEFT JOIN c ON s.source = c.source ORDER BY 1, 2""")
def sheet_summary(jobs: DataFrame, items: DataFrame, findings: DataFrame, docs: DataFrame) -> DataFrame:
    return report.sheet_summary(items, J.generations(items), findings, docs)


# --- records, counters, contracts ---------------------------------------------------------------------------------

_D = "d AS (SELECT * FROM policy_documents QUALIFY row_number() OVER (PARTITION BY url ORDER BY id) = 1)"


@query("scan_item_results", "policy_documents", sql=f"WITH {_D} SELECT r.id, d.id AS document_id, coalesce(nullif(d.title, ''), r.title) AS title, coalesce(nullif(d.district, ''), source_label) AS source, coalesce(d.issuing_agency, '') AS agency, coalesce(d.page_document_number, '') AS number, d.published_date, d.authored_date, CASE WHEN d.id IS NULL THEN 'exception' WHEN coalesce(d.issuing_agency, '') = '' OR d.published_date IS NULL THEN 'review_required' ELSE 'checked_complete' END AS outcome FROM scan_item_results r LEFT JOIN d ON d.url = r.url WHERE r.url IS NOT NULL")
def opened_details(items: DataFrame, docs: DataFrame) -> DataFrame:
    return J.opened(items, docs)


@query("scan_item_results", "rule_findings", sql=f"WITH {_G}, w AS (SELECT job_id, count(*) AS examined, count(*) FILTER (detail_status IN ('checked_complete', 'checked_incomplete', 'no_header')) AS processed, count(*) FILTER (state = 'reused') AS skipped, count(*) FILTER (state = 'review') AS exceptions FROM g GROUP BY 1), f AS (SELECT job_id, count(DISTINCT id) AS findings FROM rule_findings GROUP BY 1) SELECT w.*, coalesce(findings, 0) AS findings FROM w LEFT JOIN f ON f.job_id = w.job_id")
def job_counters(items: DataFrame, findings: DataFrame) -> DataFrame:
    return J.counters(items, findings)


@query("scan_item_results", sql=f"WITH {_G}, n AS (SELECT job_id, sum(discovered)::BIGINT AS n FROM h GROUP BY 1) SELECT job_id, (n + 9) // 10 AS n_batches, n - ((n + 9) // 10 - 1) * 10 AS in_last, CASE WHEN n > 10 THEN 'partial' ELSE 'completed' END AS state FROM n")
def batch_limits(items: DataFrame) -> DataFrame:
    return J.batches(J.generations(items), 10)


@query("scan_jobs", "scan_item_results", sql="WITH v AS (SELECT job_id, CAST(min(coalesce(link_check_version, 0)) AS BIGINT) AS version FROM scan_item_results GROUP BY 1) SELECT id, version, coalesce(version >= 2, TRUE) AND status IN ('pending', 'running', 'cooling', 'paused', 'partial', 'failed') AS may_resume, coalesce(version >= 2, FALSE) AND status = 'completed' AND mode = 'full' AS may_be_baseline FROM scan_jobs LEFT JOIN v ON v.job_id = id")
def contract_gate(jobs: DataFrame, items: DataFrame) -> DataFrame:
    return big(J.contracts(jobs, items, 2))


@query("scan_jobs", sql=f"WITH t AS (SELECT id, {_SIG} AS signature, started_at AS s, finished_at AS f FROM scan_jobs WHERE started_at IS NOT NULL AND finished_at >= started_at) SELECT a.id, count(*) AS n_running, count(*) FILTER (b.signature = a.signature) AS n_of_site FROM t a JOIN t b ON (b.s < a.s OR (b.s = a.s AND b.id <= a.id)) AND b.f > a.s OR b.id = a.id GROUP BY 1")
def job_concurrency(jobs: DataFrame) -> DataFrame:
    return J.concurrency(jobs)


@query("policy_documents", "scan_item_results", sql="WITH s AS (SELECT coalesce(nullif(document_id, 0), nullif(reused_document_id, 0)) AS id, max(job_id) AS seen FROM scan_item_results GROUP BY 1) SELECT d.id, first_seen_job_id, greatest(last_seen_job_id, seen) AS last_seen_job_id FROM policy_documents d LEFT JOIN s ON s.id = d.id")
def last_seen_jobs(docs: DataFrame, items: DataFrame) -> DataFrame:
    return J.last_seen(docs, items)


@query("policy_documents", sql="SELECT id, sha256(CAST(json_object('agency', issuing_agency, 'authored', CAST(authored_date AS VARCHAR), 'district', district, 'published', CAST(published_date AS VARCHAR), 'url', url) AS VARCHAR)) AS hash FROM policy_documents")
def content_hashes(docs: DataFrame) -> DataFrame:
    return docs.select("id", T.content_hash(agency=F.col("issuing_agency"), url=F.col("url"), district=F.col("district"), published=F.col("published_date"), authored=F.col("authored_date")).alias("hash"))


@query("scan_jobs", sql="SELECT id, CASE WHEN status = 'completed' AND coverage_status <> 'complete' THEN 'partial' ELSE status END AS status, 0::BIGINT AS resumed_count, coalesce(pause_reason, '') AS pause_reason FROM scan_jobs")
def migrated_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs in the current form: columns that older ones lack, and those that count as completed without being complete repaired."""
    from sifthall.plans.merge import conformed, patched

    form = {"resumed_count": ("bigint", F.lit(0)), "pause_reason": ("string", F.lit(""))}
    repaired = patched(conformed(conformed(jobs, form), form), (F.col("status") == "completed") & (F.col("coverage_status") != "complete"), {"status": F.lit("partial")})
    return repaired.select("id", "status", "resumed_count", "pause_reason")


@query("scan_item_results", "scan_jobs", sql="WITH t AS (SELECT target_key, min(source_label) AS label FROM scan_item_results WHERE target_key IS NOT NULL GROUP BY 1), n AS (SELECT target_key AS name, target_key, 0 AS level FROM t UNION ALL SELECT label, target_key, 1 FROM t UNION ALL SELECT split_part(label, '-', 1), target_key, 2 FROM t), m AS (SELECT name, arg_min(target_key, (level, target_key)) AS target_key FROM n WHERE name <> '' GROUP BY 1), v AS (SELECT DISTINCT unnest(source_signature) AS value FROM scan_jobs UNION SELECT DISTINCT source_label FROM scan_item_results UNION SELECT DISTINCT split_part(source_label, '-', 1) FROM scan_item_results UNION SELECT 'nowhere') SELECT value, m.target_key FROM v LEFT JOIN m ON m.name = v.value")
def resolved_targets(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """What a value of a selection means: a target's key, else its label, else its district, for which the first target stands."""
    from sifthall.operators import inventory

    district = lambda c: F.substring_index(c, "-", 1)
    targets = items.where("target_key IS NOT NULL").groupBy("target_key").agg(F.min("source_label").alias("label"))
    names = inventory.synonyms(targets, "target_key", [F.array("target_key"), F.array("label"), F.array(district("label"))])
    values = jobs.select(F.explode("source_signature").alias("value")).union(items.select("source_label")).union(items.select(district("source_label"))).union(jobs.sparkSession.range(1).select(F.lit("nowhere"))).distinct()
    return inventory.resolved(values, "value", names, "target_key")


@query("scan_item_results", sql=f"WITH {_G} SELECT split_part(l.label, '-', 1) AS district, h.job_id, CAST(sum(observed) AS BIGINT) AS declared, CAST(sum(discovered) AS BIGINT) AS observed, sum(observed) <> sum(discovered) AS differs FROM h JOIN (SELECT target_key, min(source_label) AS label FROM scan_item_results GROUP BY 1) l ON l.target_key = h.target_key GROUP BY 1, 2")
def declared_totals(items: DataFrame) -> DataFrame:
    """What the lists of a district showed and what is known of them, by job."""
    labels = items.groupBy("target_key").agg(F.substring_index(F.min("source_label"), "-", 1).alias("district"))
    sums = J.generations(items).join(labels, "target_key").groupBy("district", "job_id").agg(F.sum("observed").alias("declared"), F.sum("discovered").alias("observed"))
    return sums.withColumn("differs", F.col("declared") != F.col("observed"))


_FAILS = "WITH l AS (SELECT user_id AS run_id, event_id, ts, event_type = 'error' AS failed FROM events), r AS (SELECT event_id, run_id, ts, row_number() OVER (PARTITION BY run_id, failed, island ORDER BY ts, event_id) AS length, failed FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY run_id, failed ORDER BY ts, event_id) AS island FROM l)) "


@query("events", sql=_FAILS + "SELECT event_id, run_id, length AS attempt, CASE length WHEN 1 THEN 30 ELSE 120 END::BIGINT AS least, CASE length WHEN 1 THEN 60 ELSE 300 END::BIGINT AS most FROM r WHERE failed AND length <= 2")
def retry_waits(events: DataFrame) -> DataFrame:
    return A.retries(A.accesses(events))


@query("events", sql=_FAILS + "SELECT event_id, run_id, length, epoch_us(ts) + 1800000000 AS until_us FROM r WHERE failed AND length >= 2")
def cooling_times(events: DataFrame) -> DataFrame:
    return A.cooling(A.accesses(events), 2)
