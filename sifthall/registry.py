"""All queries of the core by name, and the SQL of those that SQL can say.

Every query runs over its whole tables. A query's SQL says the same in another engine's dialect and is how its result is
checked; operators that SQL cannot say are checked by brute force in the tests.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sifthall.functions import text as T
from sifthall.functions import web
from sifthall.functions import workdays as W
from sifthall.operators import accesslog as A
from sifthall.operators import relational as R
from sifthall.operators import inventory, report, review, rules, snapshots
from sifthall.plans.merge import keyed_upsert, positions_marked, replaced
from sifthall.streaming import jobs as S

FLAGSHIP = "issue_summary"
AS_OF = date(2026, 12, 31)
DONE = ["checked_complete", "checked_incomplete", "no_header", "reused", "skipped"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(*tables: str, sql: str | None = None) -> Callable:
    """Register a function of the named tables, and the SQL that says the same."""

    def register(f: Callable[..., DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(table(spark, sf_dir, t) for t in tables))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def days(df: DataFrame) -> DataFrame:
    """A calendar from the least to the greatest date of ``df``."""
    return W.calendar_of(df, "authored_date", "published_date")


def big(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, so that two engines' counts have one type."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


_P4_KEYS = ("district", "title", "url", "source_id", "issuing_agency", "page_document_number", "published_date", "authored_date", "body_text", "source_site", "topic_category", "disclosure_attribute", "header_detected")
_P4_VALUE = " || '~' || ".join(f"coalesce(json_extract_string(raw_json, '$.{k}'), '<null>')" for k in _P4_KEYS) + " || '~' || " + " || '~' || ".join(f"coalesce(CAST(json_extract_string(raw_json, '$.{k}[*]') AS VARCHAR), '')" for k in ("body_document_numbers", "missing_metadata_fields"))
_SPACE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_DIGITS = "translate({}, '０１２３４５６７８９', '0123456789')"
_NUMBER = r"([\x{4e00}-\x{9fff}]{1,12}(?:办|发|规|字|令)?)" + rf"{_SPACE}*[〔\[【(（]{_SPACE}*((?:20|19)\d{{2}}){_SPACE}*[〕\]】)）]{_SPACE}*(\d{{1,4}}){_SPACE}*号"
_SOLID = _DIGITS.format(f"regexp_replace(translate(page_document_number, '【】[]（）', '〔〕〔〕〔〕'), '{_SPACE}+', '', 'g')")
_JOINED = "regexp_replace({p}, '^(?:另见|参见|以及|及|见|根据|依据|文件)', '') || '〔' || {y} || '〕' || CAST(CAST({i} AS INT) AS VARCHAR) || '号'"
_ONE = _JOINED.format(**{k: f"regexp_extract(solid, '{_NUMBER}', {n})" for k, n in (("p", 1), ("y", 2), ("i", 3))})
_NUMBERED = f"SELECT *, CASE WHEN regexp_matches(solid, '{_NUMBER}') THEN {_ONE} ELSE solid END AS number FROM (SELECT *, {_SOLID} AS solid FROM policy_documents)"
_EXTRACTED = (
    "list_transform(range(1, len(regexp_extract_all(plain, '{n}', 1)) + 1), lambda k: " + _JOINED.format(**{k: f"regexp_extract_all(plain, '{{n}}', {n})[k]" for k, n in (("p", 1), ("y", 2), ("i", 3))}) + ")"
).replace("{n}", _NUMBER)
_ORDERED = "list_filter({x}, lambda v, k: list_position({x}, v) = k)"
_GAP = "CASE WHEN published_date IS NULL OR authored_date IS NULL THEN NULL WHEN published_date <= authored_date THEN 0 ELSE (SELECT count(*) FROM range(authored_date + 1, published_date + INTERVAL 1 DAY, INTERVAL 1 DAY) AS r(d) WHERE isodow(d) < 6) END"


# --- snapshots ----------------------------------------------------------------------------------------------------


@query(
    "scan_item_results", "document_snapshots", "scan_jobs",
    sql=rf"""
WITH chain AS (SELECT id AS job_id, lag(id) OVER w AS prev, lead(id) OVER w AS next FROM scan_jobs WHERE mode = 'full' AND status = 'completed' WINDOW w AS (PARTITION BY source_signature ORDER BY started_at NULLS FIRST, id)),
items AS (SELECT * EXCLUDE n FROM (SELECT c.*, target_key AS t, url AS k, regexp_replace(title, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS title, listed_date, row_number() OVER (PARTITION BY r.job_id, target_key, url ORDER BY checked_at DESC NULLS LAST, r.id DESC) AS n
  FROM scan_item_results r JOIN chain c USING (job_id) WHERE target_key IS NOT NULL AND url IS NOT NULL) WHERE n = 1),
docs AS (SELECT c.*, '' AS t, CAST(document_id AS VARCHAR) AS k, {_P4_VALUE} AS v FROM document_snapshots r JOIN chain c USING (job_id) WHERE document_id IS NOT NULL),
rows AS (SELECT 'scan_item_results' AS record_table, job_id, prev, next, t, k, coalesce(title, '<null>') || '~' || coalesce(CAST(listed_date AS VARCHAR), '<null>') AS v FROM items UNION ALL SELECT 'document_snapshots', job_id, prev, next, t, k, v FROM docs),
met AS (SELECT coalesce(a.record_table, b.record_table) AS record_table, coalesce(a.job_id, b.next) AS job_id, coalesce(a.t, b.t) AS target_key, coalesce(a.k, b.k) AS record_key,
  CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' END AS change_kind
  FROM (SELECT * FROM rows WHERE prev IS NOT NULL) a FULL JOIN (SELECT * FROM rows WHERE next IS NOT NULL) b ON a.record_table = b.record_table AND a.job_id = b.next AND a.t = b.t AND a.k = b.k)
SELECT * FROM met WHERE change_kind IS NOT NULL""",
)
def p4_found(items: DataFrame, records: DataFrame, jobs: DataFrame) -> DataFrame:
    return snapshots.found(items, records, jobs)


# --- functions on text --------------------------------------------------------------------------------------------


@query("policy_documents", sql=f"SELECT id, number, CAST(nullif(regexp_extract(number, '{_NUMBER}', 2), '') AS BIGINT) AS year, CAST(nullif(regexp_extract(number, '{_NUMBER}', 3), '') AS BIGINT) AS index_no FROM ({_NUMBERED})")
def docnum_normalize(docs: DataFrame) -> DataFrame:
    rows = docs.select("id", T.document_number(F.col("page_document_number")).alias("number"))
    parts = T.document_number_parts(F.col("number"))
    return rows.select("id", "number", parts["year"].cast("bigint").alias("year"), parts["index"].cast("bigint").alias("index_no"))


@query("policy_documents", sql=f"SELECT id, array_to_string({_ORDERED.format(x='found')}, '|') AS numbers FROM (SELECT id, {_EXTRACTED} AS found FROM (SELECT id, {_DIGITS.format("coalesce(body_text, '')")} AS plain FROM policy_documents))")
def docnum_extract(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.array_join(T.document_numbers(F.col("body_text")), "|").alias("numbers"))


@query("policy_documents", sql=f"SELECT id, CAST(gap AS BIGINT) AS workday_gap, CASE WHEN published_date IS NULL OR authored_date IS NULL THEN '待复核' WHEN published_date < authored_date THEN '日期倒置' WHEN gap > 20 THEN '超期' ELSE '合规' END AS label FROM (SELECT *, {_GAP} AS gap FROM policy_documents)")
def workday_gap(docs: DataFrame) -> DataFrame:
    gaps = W.with_gap(docs.select("id", "authored_date", "published_date"), "authored_date", "published_date", days(docs))
    return gaps.select("id", "workday_gap", W.timeliness(F.col("workday_gap"), F.col("authored_date"), F.col("published_date")).alias("label"))


_DATE_LINE = "^(?:((?:19|20)[0-9]{2})[ \\t\\n\\f\\r]*[年./-][ \\t\\n\\f\\r]*([0-9]{1,2})[ \\t\\n\\f\\r]*[月./-][ \\t\\n\\f\\r]*([0-9]{1,2})[ \\t\\n\\f\\r]*日?)$"
_WHOLE = f"TRY_CAST(regexp_extract(lines[i], '{_DATE_LINE}', 1) || '-' || regexp_extract(lines[i], '{_DATE_LINE}', 2) || '-' || regexp_extract(lines[i], '{_DATE_LINE}', 3) AS DATE)"
_BLOCK = "list_reverse(lines[greatest(i - 6, 1) : i - 1])"
_FROM = f"({_BLOCK})[coalesce(list_position(list_transform({_BLOCK}, lambda x: x <> ''), TRUE), 100) :]"
_SIGNED = f"array_to_string(CASE WHEN coalesce(list_position({_FROM}, ''), 0) > 0 THEN ({_FROM})[1 : list_position({_FROM}, '') - 1] ELSE {_FROM} END, ' ')"


@query("policy_documents", sql=rf"""
WITH l AS (SELECT id, coalesce(issuing_agency, '') AS agency, list_transform(regexp_split_to_array(coalesce(body_text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS lines FROM policy_documents)
SELECT id, (list_filter(list_transform(range(1, len(lines) + 1), lambda i: CASE WHEN regexp_matches(lines[i], '{_DATE_LINE}') AND NOT regexp_matches(array_to_string(lines[greatest(i - 2, 1) : i], ' '), '{"|".join(T.NOT_A_SIGNATURE)}')
  AND ((agency <> '' AND contains({_SIGNED}, agency)) OR regexp_matches({_SIGNED}, '{"|".join(T.SIGNING_BODIES)}')) AND {_WHOLE} BETWEEN DATE '1990-01-01' AND DATE '{AS_OF}' + 366 THEN {_WHOLE} END), lambda d: d IS NOT NULL))[1] AS signed FROM l""")
def signature_date(docs: DataFrame) -> DataFrame:
    return docs.select("id", T.signature_date(F.col("body_text"), F.col("issuing_agency"), AS_OF).alias("signed"))


@query("policy_documents", sql=rf"SELECT id, regexp_replace(regexp_extract(body_text, '来源{_SPACE}*[:：]?{_SPACE}*([^\n]+)', 1), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS source_line FROM policy_documents")
def labelled_value(docs: DataFrame) -> DataFrame:
    return docs.select("id", T.labelled_value(F.col("body_text"), "来源").alias("source_line"))


_STRIPPED = "regexp_replace({x}, '^" + _SPACE + "+|" + _SPACE + "+$', '', 'g')"
_HEADER = [_STRIPPED.replace("{x}", rf"regexp_extract(coalesce(body_text, ''), '(?m)^[ \t]*{x}[ \t]*[:：][ \t]*([^\n\r\x{{85}}\x{{2028}}\x{{2029}}]*)', 1)") + f" AS v{i}" for i, x in enumerate(("来源", "责任编辑", "浏览次数"))]


@query("policy_documents", sql=rf"""
WITH v AS (SELECT id, {", ".join(_HEADER)}, coalesce(regexp_matches(body_text, '(?:来源|责任编辑|浏览次数)[ \t]*[:：]'), FALSE) AS has_header FROM policy_documents)
SELECT id, v0 AS origin, has_header, concat_ws('、', CASE WHEN v0 = '' THEN '来源' END, CASE WHEN v1 = '' THEN '责任编辑' END, CASE WHEN v2 = '' THEN '浏览次数' END) AS missing FROM v""")
def header_values(docs: DataFrame) -> DataFrame:
    labels = ("来源", "责任编辑", "浏览次数")
    values = {x: T.header_value(F.coalesce("body_text", F.lit("")), x) for x in labels}
    return docs.select("id", values["来源"].alias("origin"), F.coalesce(T.has_header(F.col("body_text"), labels), F.lit(False)).alias("has_header"), F.array_join(T.missing_labels(values), "、").alias("missing"))


@query("rule_findings", sql=r"""
WITH d AS (SELECT id, page_value, regexp_extract(page_value, '(?:19|20)[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}', 0) AS iso, regexp_extract(body_value, '((?:19|20)[0-9]{2})年([0-9]{1,2})月([0-9]{1,2})日', 1) || '-' || regexp_extract(body_value, '((?:19|20)[0-9]{2})年([0-9]{1,2})月([0-9]{1,2})日', 2) || '-' || regexp_extract(body_value, '((?:19|20)[0-9]{2})年([0-9]{1,2})月([0-9]{1,2})日', 3) AS long FROM rule_findings)
SELECT id, CASE WHEN length(iso) = 10 THEN TRY_CAST(iso AS DATE) END AS page_date, CASE WHEN length(iso) = 10 AND TRY_CAST(iso AS DATE) IS NOT NULL THEN CAST(TRY_CAST(iso AS DATE) AS VARCHAR) ELSE page_value END AS shown FROM d""")
def dates_read(findings: DataFrame) -> DataFrame:
    """The date of a value, and the value as it is shown: its date, or as it stands where it has none."""
    d = T.iso_date(F.col("page_value"))
    return findings.select("id", d.alias("page_date"), F.coalesce(d.cast("string"), "page_value").alias("shown"))


_RECORD = ("district", "title", "url", "source_id", "issuing_agency", "page_document_number", "body_text", "source_site", "topic_category", "disclosure_attribute")


@query("document_snapshots", sql=f"""SELECT id, {", ".join(f"json_extract_string(raw_json, '$.{k}') AS {k}" for k in _RECORD)}, TRY_CAST(json_extract_string(raw_json, '$.published_date') AS DATE) AS published, TRY_CAST(json_extract_string(raw_json, '$.authored_date') AS DATE) AS authored, CAST(json_extract(raw_json, '$.header_detected') AS BOOLEAN) AS header_detected,
coalesce(array_to_string(CAST(json_extract_string(raw_json, '$.body_document_numbers[*]') AS VARCHAR[]), '、'), '') AS numbers, coalesce(array_to_string(CAST(json_extract_string(raw_json, '$.missing_metadata_fields[*]') AS VARCHAR[]), '、'), '') AS missing FROM document_snapshots""")
def json_records(records: DataFrame) -> DataFrame:
    r = F.from_json("raw_json", ", ".join(f"{k} string" for k in _RECORD) + ", published_date string, authored_date string, header_detected boolean, body_document_numbers array<string>, missing_metadata_fields array<string>")
    joined = lambda c: F.coalesce(F.array_join(r[c], "、"), F.lit(""))
    return records.select("id", *[r[k].alias(k) for k in _RECORD], T.iso_date(r["published_date"]).alias("published"), T.iso_date(r["authored_date"]).alias("authored"), r["header_detected"].alias("header_detected"), joined("body_document_numbers").alias("numbers"), joined("missing_metadata_fields").alias("missing"))


@query("events", sql="SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


_TITLE, _URL, _OWN_ID = (_STRIPPED.replace("{x}", f"coalesce({x}, '')") for x in ("title", "url", "source_id"))


@query("scan_item_results", sql=f"SELECT id, sha256({_TITLE} || '|' || coalesce(CAST(listed_date AS VARCHAR), '') || '|' || {_URL} || '|' || '1') AS fingerprint, CASE WHEN {_OWN_ID} <> '' THEN target_key || '|id:' || {_OWN_ID} WHEN {_URL} <> '' THEN target_key || '|url:' || {_URL} END AS stable_id FROM scan_item_results")
def fingerprints(items: DataFrame) -> DataFrame:
    return items.select("id", T.fingerprint(F.col("title"), F.col("listed_date"), F.col("url"), F.lit("1")).alias("fingerprint"), T.stable_identity(F.col("target_key"), F.col("source_id"), F.col("url")).alias("stable_id"))


@query("link_checks", sql=r"""
SELECT id, regexp_extract(original_url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_matches(lower(regexp_extract(original_url, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '\.(?:pdf|docx?|xlsx?)$') AS attachment,
CASE WHEN contains(coalesce(link_text, ''), '政策解读') THEN '政策解读' WHEN contains(coalesce(link_text, ''), '阅办联动') THEN '阅办联动' WHEN regexp_matches(lower(regexp_extract(original_url, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '\.(?:pdf|docx?|xlsx?)$') OR contains(coalesce(link_text, ''), '附件') THEN '附件' ELSE '' END AS kind FROM link_checks""")
def url_parts(links: DataFrame) -> DataFrame:
    u = F.col("original_url")
    return links.select("id", web.host(u).alias("host"), web.is_attachment(u).alias("attachment"), web.link_kind(F.col("link_text"), u).alias("kind"))


@query("link_checks", sql="""
WITH f AS (SELECT id, status_code AS s, coalesce(s IN (403, 429), FALSE) OR regexp_matches(coalesce(page_title, ''), '访问频繁|请求过于频繁|安全验证|请输入验证码|人机验证|访问受限') AS restricted, regexp_matches(coalesce(page_title, ''), '页面不存在|内容不存在|访问出错|系统错误') AS failed, trim(coalesce(page_title, '')) = '' AS empty FROM link_checks)
SELECT id, CASE WHEN s BETWEEN 200 AND 399 AND NOT empty AND NOT failed AND NOT restricted THEN 'ok' WHEN restricted THEN 'review_required' ELSE 'broken' END AS http_result, CASE WHEN empty THEN 'empty_page' WHEN restricted THEN 'access_restricted' WHEN failed THEN 'business_error' WHEN s >= 400 THEN 'http_error' ELSE '' END AS http_error,
CASE WHEN restricted THEN 'review_required' WHEN empty OR failed OR s >= 400 THEN 'broken' ELSE 'ok' END AS rendered_result FROM f""")
def response_classes(links: DataFrame) -> DataFrame:
    http = web.fetched_result(F.col("status_code"), F.col("page_title"), F.lit(True), F.lit(False))
    shown = web.rendered_result(F.col("status_code"), F.col("page_title"), F.lit(False))
    return links.select("id", http["result"].alias("http_result"), http["error_type"].alias("http_error"), shown["result"].alias("rendered_result"))


# --- rules --------------------------------------------------------------------------------------------------------


@query("policy_documents", sql=f"""
WITH d AS (SELECT *, {_GAP} AS gap, list_distinct(found) AS numbers FROM (SELECT *, {_EXTRACTED} AS found FROM (SELECT *, {_DIGITS.format("coalesce(body_text, '')")} AS plain FROM ({_NUMBERED}))))
SELECT id AS document_id, 'DOC-003' AS rule_code, 'pending' AS review_status FROM d WHERE number <> '' AND len(numbers) > 1 AND NOT list_contains(numbers, number)
UNION ALL SELECT id, 'DOC-001', 'confirmed' FROM d WHERE number <> '' AND len(numbers) = 1 AND NOT list_contains(numbers, number)
UNION ALL SELECT id, 'DOC-002', 'confirmed' FROM d WHERE CAST(nullif(regexp_extract(number, '{_NUMBER}', 2), '') AS INT) <> year(authored_date)
UNION ALL SELECT id, 'DATE-002', 'confirmed' FROM d WHERE published_date < authored_date
UNION ALL SELECT id, 'DATE-001', 'confirmed' FROM d WHERE published_date >= authored_date AND gap > 20""")
def rule_findings_numbers_dates(docs: DataFrame) -> DataFrame:
    rows = W.with_gap(docs.select("id", "authored_date", "published_date", T.document_number(F.col("page_document_number")).alias("number"), T.document_numbers(F.col("body_text")).alias("numbers")), "authored_date", "published_date", days(docs))
    return rules.unfolded(rows, rules.number_and_date_findings()).select("document_id", "rule_code", "review_status")


_AGENCY = """SELECT d.id, min(a.id) AS agency_id FROM policy_documents d JOIN agency_rules a ON d.district = a.district AND d.issuing_agency <> '' AND len(list_filter(list_prepend(a.agency_name, a.aliases), lambda n: contains(d.issuing_agency, n) OR contains(n, d.issuing_agency))) > 0 GROUP BY d.id"""


@query("policy_documents", "agency_rules", sql=_AGENCY)
def agency_match(docs: DataFrame, agencies: DataFrame) -> DataFrame:
    return R.first_agency(docs, agencies)


@query("policy_documents", "agency_rules", sql=f"""
WITH m AS ({_AGENCY}), d AS (SELECT n.*, list_prepend(a.agency_name, a.aliases) AS names, a.document_prefixes, regexp_extract(number, '{_NUMBER}', 1) AS prefix FROM ({_NUMBERED}) n JOIN m USING (id) JOIN agency_rules a ON a.id = m.agency_id WHERE number <> '' AND issuing_agency <> ''),
t AS (SELECT *, list_filter(names, lambda n: contains(right(coalesce(body_text, ''), 800), n)) AS tail, regexp_extract(coalesce(title, ''), '[\\x{{4e00}}-\\x{{9fff}}]{{1,3}}市[^\\s，。；]{{2,24}}(?:委员会|局|办公室|中心)', 0) AS other FROM d)
SELECT id AS document_id, 'AGENCY-001' AS rule_code FROM t WHERE prefix <> '' AND len(list_filter(document_prefixes, lambda p: starts_with(prefix, p))) = 0
UNION ALL SELECT id, 'AGENCY-002' FROM t WHERE len(list_filter(names, lambda n: contains(coalesce(title, ''), n))) = 0 AND len(list_filter(names, lambda n: contains(n, '人民政府'))) > 0 AND other <> ''
UNION ALL SELECT id, 'AGENCY-003' FROM t WHERE len(tail) > 0 AND len(list_filter(tail, lambda n: contains(issuing_agency, n))) = 0""")
def rule_findings_agency(docs: DataFrame, agencies: DataFrame) -> DataFrame:
    return rules.agency_findings(docs, agencies, city="[一-鿿]{1,3}市").select("document_id", "rule_code")


@query("scan_item_results", sql="SELECT id AS document_id, 'META-001' AS rule_code, array_to_string(missing_fields, '、') AS missing FROM scan_item_results WHERE header_detected AND len(missing_fields) > 0")
def rule_findings_metadata(items: DataFrame) -> DataFrame:
    return rules.unfolded(items, rules.metadata_finding(F.col("missing_fields"), F.col("header_detected"), F.col("url"))).select("document_id", "rule_code", F.col("page_value").alias("missing"))


# --- joins --------------------------------------------------------------------------------------------------------


@query("rule_findings", "policy_documents", sql="SELECT f.id, f.job_id, f.rule_code, f.category, d.title, d.url, d.district FROM rule_findings f JOIN policy_documents d ON d.id = f.document_id")
def findings_docs(findings: DataFrame, docs: DataFrame) -> DataFrame:
    return R.findings_with_documents(findings, docs).select("id", "job_id", "rule_code", "category", "title", "url", "district")


@query("link_checks", "policy_documents", sql="SELECT l.id, l.original_url, l.result, d.title AS document_title, d.district FROM link_checks l JOIN policy_documents d ON d.id = l.document_id WHERE visible AND review_status = 'confirmed' AND result IN ('broken', 'error') AND trim(coalesce(source_area, '')) <> '' AND trim(coalesce(source_page_url, '')) <> ''")
def link_problems(links: DataFrame, docs: DataFrame) -> DataFrame:
    return R.link_problems(links, docs).select("id", "original_url", "result", "document_title", "district")


@query("scan_jobs", "scan_item_results", sql="SELECT id, CAST(access_count AS BIGINT) AS access_count FROM scan_jobs j WHERE mode = 'full' AND status = 'completed' AND coverage_status = 'complete' AND EXISTS (SELECT 1 FROM scan_item_results r WHERE r.job_id = j.id)")
def baseline_semi(jobs: DataFrame, items: DataFrame) -> DataFrame:
    return big(R.baselines(jobs, items).select("id", "access_count"))


@query("scan_jobs", "scan_item_results", sql="SELECT array_to_string(list_sort(source_signature), '|') AS signature, max(id) AS id FROM scan_jobs j WHERE mode = 'full' AND status = 'completed' AND coverage_status = 'complete' AND id IN (SELECT job_id FROM scan_item_results) GROUP BY 1")
def newest_baseline(jobs: DataFrame, items: DataFrame) -> DataFrame:
    return R.newest_baseline(jobs, items)


@query("scan_item_results", "link_checks", sql="SELECT id, coalesce(coalesce(nullif(document_id, 0), nullif(reused_document_id, 0)) IN (SELECT document_id FROM link_checks WHERE review_status = 'legacy_hidden' AND document_id IS NOT NULL), FALSE) AS has_hidden FROM scan_item_results")
def legacy_mark(items: DataFrame, links: DataFrame) -> DataFrame:
    rows = items.select("id", R.effective_document().alias("document_id"))
    return R.mark(rows, links.where("review_status = 'legacy_hidden'"), "document_id", "has_hidden").select("id", "has_hidden")


@query("scan_jobs", "scan_item_results", sql="SELECT id, (SELECT count(*) FROM scan_item_results r WHERE r.job_id = j.id) AS n_items FROM scan_jobs j")
def job_counts(jobs: DataFrame, items: DataFrame) -> DataFrame:
    return R.with_count(jobs.select("id"), items, "id", "job_id", "n_items")


@query("policy_documents", "document_snapshots", sql="SELECT d.id, length(s.raw_json) AS last_length FROM policy_documents d LEFT JOIN (SELECT document_id, arg_max(raw_json, id) AS raw_json FROM document_snapshots GROUP BY 1) s ON s.document_id = d.id")
def latest_record(docs: DataFrame, records: DataFrame) -> DataFrame:
    return R.with_latest(docs.select("id"), records, "id", "document_id", "raw_json", "id", "last").select("id", F.length("last").cast("bigint").alias("last_length"))


@query("policy_documents", "document_snapshots", "rule_findings", sql="WITH j AS (SELECT max(job_id) AS j FROM rule_findings) SELECT d.id, d.district, d.title, s.document_id IS NOT NULL AS captured, coalesce(f.n, 0) AS n_findings FROM policy_documents d LEFT JOIN (SELECT DISTINCT document_id FROM document_snapshots, j WHERE job_id = j) s ON s.document_id = d.id LEFT JOIN (SELECT document_id, count(*) AS n FROM rule_findings, j WHERE job_id = j GROUP BY 1) f ON f.document_id = d.id WHERE s.document_id IS NOT NULL OR d.last_seen_job_id = (SELECT j FROM j)")
def documents_overview(docs: DataFrame, records: DataFrame, findings: DataFrame) -> DataFrame:
    job = findings.agg(F.max("job_id")).first()[0]
    return R.documents_overview(docs, records, findings, -1 if job is None else job)


@query("scan_item_results", "rule_findings", sql="SELECT id, rule_code FROM rule_findings f WHERE NOT EXISTS (SELECT 1 FROM scan_item_results r WHERE r.job_id = f.job_id AND coalesce(nullif(r.document_id, 0), nullif(r.reused_document_id, 0)) = f.document_id)")
def unmapped_anti(items: DataFrame, findings: DataFrame) -> DataFrame:
    return R.unmapped_findings(items, findings).select("id", "rule_code")


@query("scan_item_results", sql="SELECT id, job_id, url, target_key, first_target FROM (SELECT *, first_value(id) OVER w AS first_id, first_value(target_key) OVER w AS first_target, min(target_key) OVER (PARTITION BY job_id, url) AS low, max(target_key) OVER (PARTITION BY job_id, url) AS high FROM scan_item_results WHERE url IS NOT NULL WINDOW w AS (PARTITION BY job_id, url ORDER BY target_key, coalesce(page_number, 0), coalesce(item_index, 0), id)) WHERE low <> high AND id <> first_id")
def url_reuse(items: DataFrame) -> DataFrame:
    return R.shared_addresses(items)


@query("scan_item_results", "rule_findings", sql="SELECT r.job_id, f.document_id, f.rule_code, arg_min(f.category, f.id) AS category, arg_min(f.severity, f.id) AS severity, arg_min(f.detail, f.id) AS detail FROM (SELECT DISTINCT job_id, reused_document_id AS d, baseline_job_id AS b FROM scan_item_results WHERE reused_document_id IS NOT NULL AND baseline_job_id IS NOT NULL) r JOIN rule_findings f ON f.job_id = r.b AND f.document_id = r.d GROUP BY 1, 2, 3")
def copied_findings(items: DataFrame, findings: DataFrame) -> DataFrame:
    return R.copied_findings(items, findings)


@query("scan_item_results", "scan_jobs", "link_checks", sql="""
WITH latest AS (SELECT * FROM (SELECT *, coalesce(nullif(document_id, 0), nullif(reused_document_id, 0)) AS doc, row_number() OVER (PARTITION BY job_id, target_key, url ORDER BY checked_at DESC NULLS LAST, id DESC) AS n FROM scan_item_results WHERE url IS NOT NULL) WHERE n = 1),
hidden AS (SELECT DISTINCT document_id, job_id FROM link_checks WHERE NOT coalesce(visible, FALSE) OR review_status = 'legacy_hidden' OR trim(coalesce(source_area, '')) = ''),
met AS (SELECT i.id, i.title, i.listed_date, b.title AS bt, b.listed_date AS bd, b.detail_status AS bs, b.link_check_version AS bv, len(b.missing_fields) AS bm, b.doc, h.document_id AS hid FROM scan_item_results i JOIN scan_jobs j ON j.id = i.job_id AND j.baseline_job_id IS NOT NULL LEFT JOIN latest b ON b.job_id = j.baseline_job_id AND b.target_key = i.target_key AND b.url = i.url LEFT JOIN hidden h ON h.document_id = b.doc AND h.job_id = b.job_id WHERE i.url IS NOT NULL)
SELECT id, reason, reason IN ('no header, unchanged', 'unchanged') AS can_reuse FROM (SELECT id, CASE WHEN bs IS NULL THEN 'new' WHEN trim(title, ' ') <> trim(bt, ' ') THEN 'title changed' WHEN listed_date IS DISTINCT FROM bd THEN 'date changed' WHEN coalesce(bv, 0) < 1 THEN 'links not checked' WHEN bs IN ('exception', 'review_required', 'checked_incomplete') THEN 'baseline incomplete' WHEN hid IS NOT NULL THEN 'links without evidence' WHEN contains(bs, 'no_header') THEN 'no header, unchanged' WHEN bm > 0 THEN 'fields missing' WHEN doc IS NULL THEN 'no document' ELSE 'unchanged' END AS reason FROM met)""")
def reuse_decision(items: DataFrame, jobs: DataFrame, links: DataFrame) -> DataFrame:
    return R.reuse_decision(items, jobs, links)


# --- aggregates, windows, sets ------------------------------------------------------------------------------------


@query("scan_item_results", sql="SELECT job_id, count(*) AS total, count(*) FILTER (detail_status = 'checked_complete') AS complete_header, count(*) FILTER (detail_status = 'checked_incomplete') AS incomplete_header, count(*) FILTER (contains(detail_status, 'no_header')) AS no_header_pass, count(*) FILTER (starts_with(detail_status, 'reused')) AS reused, count(*) FILTER (detail_status IN ('exception', 'review_required')) AS exception FROM scan_item_results GROUP BY 1")
def item_stats(items: DataFrame) -> DataFrame:
    return review.item_stats(items)


@query("scan_item_results", sql="SELECT source_label, count(*) FILTER (detail_status = 'pending') AS pending, count(*) FILTER (detail_status = 'skipped') AS skipped, count(*) FILTER (detail_status = 'reused') AS reused FROM scan_item_results GROUP BY 1")
def status_pivot(items: DataFrame) -> DataFrame:
    return items.groupBy("source_label").pivot("detail_status", ["pending", "skipped", "reused"]).count().na.fill(0, ["pending", "skipped", "reused"])


@query("rule_findings", sql="SELECT job_id, count(*) AS total, count(*) FILTER (review_status = 'pending') AS n_pending, count(*) FILTER (review_status = 'confirmed') AS n_confirmed, count(*) FILTER (review_status = 'dismissed') AS n_dismissed FROM rule_findings GROUP BY 1")
def review_counts(findings: DataFrame) -> DataFrame:
    return review.counts(findings)


@query("scan_item_results", sql="WITH f AS (SELECT DISTINCT job_id, url FROM scan_item_results WHERE detail_status = 'review_required' AND url IS NOT NULL), l AS (SELECT job_id, url, detail_status FROM (SELECT *, row_number() OVER (PARTITION BY job_id, url ORDER BY checked_at DESC NULLS LAST, id DESC) AS n FROM scan_item_results WHERE url IS NOT NULL) WHERE n = 1) SELECT job_id, count(*) FILTER (detail_status = 'review_required') AS n_pending, count(*) FILTER (detail_status <> 'review_required') AS n_resolved FROM f JOIN l USING (job_id, url) GROUP BY 1")
def exception_counts(items: DataFrame) -> DataFrame:
    return review.exception_counts(items)


@query("scan_item_results", "rule_findings", "policy_documents", sql="""
WITH i AS (SELECT DISTINCT job_id, source_label, url, coalesce(nullif(document_id, 0), nullif(reused_document_id, 0)) AS document_id FROM scan_item_results), m AS (SELECT DISTINCT i.source_label AS source, i.job_id, i.url, f.id, f.category FROM i JOIN rule_findings f USING (job_id, document_id)),
u AS (SELECT coalesce(nullif(d.source_site, ''), d.district) AS source, f.category FROM rule_findings f JOIN policy_documents d ON d.id = f.document_id WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.job_id = f.job_id AND i.document_id = f.document_id))
SELECT source, category, count(*) AS n FROM (SELECT source, category FROM m UNION ALL SELECT source, category FROM u) GROUP BY 1, 2""")
def issue_summary(items: DataFrame, findings: DataFrame, docs: DataFrame) -> DataFrame:
    return R.issue_summary(items, findings, docs)


_ROW = "* REPLACE (array_to_string(missing_fields, '、') AS missing_fields, epoch_us(checked_at) AS checked_at, CAST(page_number AS BIGINT) AS page_number, CAST(item_index AS BIGINT) AS item_index, CAST(link_check_version AS BIGINT) AS link_check_version)"


def whole(items: DataFrame) -> DataFrame:
    """Rows in types that two engines show alike."""
    return big(items.withColumns({"missing_fields": F.array_join("missing_fields", "、"), "checked_at": F.unix_micros("checked_at")}))


@query("scan_item_results", sql=f"SELECT {_ROW} FROM (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY job_id, url ORDER BY CASE WHEN detail_status = 'checked_incomplete' THEN 2 ELSE 1 END DESC, coalesce(page_number, 0), coalesce(item_index, 0), id) AS n FROM scan_item_results WHERE len(missing_fields) > 0 OR detail_status = 'checked_incomplete') WHERE n = 1)")
def metadata_argmax(items: DataFrame) -> DataFrame:
    return whole(R.metadata_issues(items))


@query("rule_findings", sql="SELECT job_id, document_id, string_agg(rule_code, '、' ORDER BY id, rule_code, detail) AS codes, string_agg(detail, '；' ORDER BY id, rule_code, detail) AS details FROM rule_findings GROUP BY 1, 2")
def codes_concat(findings: DataFrame) -> DataFrame:
    return R.ordered_concat(findings, ["job_id", "document_id"], "id", {"codes": ("rule_code", "、"), "details": ("detail", "；")})


@query("scan_item_results", sql=f"SELECT {_ROW} FROM (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY job_id, target_key, url ORDER BY checked_at DESC NULLS LAST, id DESC) AS n FROM scan_item_results) WHERE n = 1)")
def latest_row(items: DataFrame) -> DataFrame:
    return whole(R.latest_rows(items))


@query("scan_item_results", sql=f"SELECT {_ROW} FROM (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY job_id, url ORDER BY detail_status IN ('checked_complete', 'checked_incomplete', 'no_header') DESC, checked_at DESC NULLS LAST, id DESC) AS n FROM scan_item_results) WHERE n = 1)")
def best_row(items: DataFrame) -> DataFrame:
    return whole(R.best_rows(items, ["checked_complete", "checked_incomplete", "no_header"]))


@query("scan_item_results", sql="SELECT target_key, url, min(job_id) AS job_id FROM scan_item_results WHERE url IS NOT NULL GROUP BY 1, 2")
def first_seen(items: DataFrame) -> DataFrame:
    return R.first_seen(items)


@query("scan_item_results", sql="WITH l AS (SELECT job_id, target_key, url, title, listed_date FROM (SELECT *, row_number() OVER (PARTITION BY job_id, target_key, url ORDER BY checked_at DESC NULLS LAST, id DESC) AS n FROM scan_item_results) WHERE n = 1), p AS (SELECT job_id, target_key, url, sha256(trim(coalesce(title, ''), ' ') || '|' || coalesce(CAST(listed_date AS VARCHAR), '')) AS fp FROM l) SELECT job_id, target_key, url, fp AS fingerprint FROM (SELECT *, lag(fp) OVER (PARTITION BY target_key, url ORDER BY job_id) AS before FROM p) WHERE before <> fp")
def changed(items: DataFrame) -> DataFrame:
    return R.changed_versions(items, F.sha2(F.concat_ws("|", F.trim(F.coalesce("title", F.lit(""))), F.coalesce(F.col("listed_date").cast("string"), F.lit(""))), 256))


@query("scan_item_results", "scan_jobs", sql="WITH n AS (SELECT array_to_string(list_sort(source_signature), '|') AS s, max(id) AS id FROM scan_jobs WHERE mode = 'full' AND status = 'completed' GROUP BY 1), seen AS (SELECT DISTINCT target_key, url FROM scan_item_results), now AS (SELECT DISTINCT target_key, url FROM scan_item_results WHERE job_id IN (SELECT id FROM n)) SELECT target_key, url FROM seen WHERE NOT EXISTS (SELECT 1 FROM now WHERE now.target_key = seen.target_key AND now.url = seen.url)")
def inventory_diff(items: DataFrame, jobs: DataFrame) -> DataFrame:
    newest = jobs.where("mode = 'full' AND status = 'completed'").groupBy(F.array_join(F.array_sort("source_signature"), "|").alias("s")).agg(F.max("id").alias("job_id"))
    return R.removed_since(items, items.join(newest.select("job_id"), "job_id", "left_semi"), ["target_key", "url"])


@query("scan_item_results", "scan_jobs", sql="""
WITH f AS (SELECT DISTINCT r.target_key, r.url, r.job_id FROM scan_item_results r JOIN scan_jobs j ON j.id = r.job_id AND j.mode = 'full' AND j.status = 'completed' WHERE r.url IS NOT NULL), n AS (SELECT target_key, max(job_id) AS job_id FROM f GROUP BY 1), s AS (SELECT target_key, url, min(job_id) AS first_job_id, max(job_id) AS last_job_id FROM scan_item_results WHERE url IS NOT NULL GROUP BY 1, 2)
SELECT s.*, n.job_id IS NULL OR EXISTS (SELECT 1 FROM f WHERE f.target_key = s.target_key AND f.url = s.url AND f.job_id = n.job_id) AS is_present FROM s LEFT JOIN n ON n.target_key = s.target_key""")
def inventory_state(items: DataFrame, jobs: DataFrame) -> DataFrame:
    return inventory.state(items, jobs.where("mode = 'full' AND status = 'completed'"))


@query("policy_documents", "agency_rules", sql="""
WITH n AS (SELECT agency_name AS name, id, 0 AS level FROM agency_rules UNION ALL SELECT unnest(aliases), id, 1 FROM agency_rules), m AS (SELECT name, arg_min(id, level * 1000000 + id) AS agency_id FROM n WHERE name <> '' GROUP BY 1)
SELECT d.id, m.agency_id FROM policy_documents d LEFT JOIN m ON m.name = d.issuing_agency""")
def resolved_names(docs: DataFrame, agencies: DataFrame) -> DataFrame:
    names = inventory.synonyms(agencies, "id", [F.array("agency_name"), F.coalesce("aliases", F.array().cast("array<string>"))])
    return inventory.resolved(docs.select("id", "issuing_agency"), "issuing_agency", names, "agency_id").select("id", "agency_id")


@query("scan_item_results", sql=rf"""
WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, target_key, page_number, item_index ORDER BY id) AS n FROM scan_item_results WHERE page_number IS NOT NULL AND item_index IS NOT NULL AND target_key IS NOT NULL) WHERE n = 1), j AS (SELECT target_key, job_id, lag(job_id) OVER w AS prev, lead(job_id) OVER w AS next FROM (SELECT DISTINCT target_key, job_id FROM l) WINDOW w AS (PARTITION BY target_key ORDER BY job_id)),
a AS (SELECT l.*, next AS later FROM l JOIN j USING (target_key, job_id) WHERE next IS NOT NULL), b AS (SELECT l.* FROM l JOIN j USING (target_key, job_id) WHERE prev IS NOT NULL)
SELECT coalesce(a.target_key, b.target_key) AS target_key, coalesce(a.later, b.job_id) AS job_id, CAST(coalesce(a.page_number, b.page_number) AS BIGINT) AS page_number, CAST(coalesce(a.item_index, b.item_index) AS BIGINT) AS item_index, a.title AS left_value, b.title AS right_value FROM a FULL JOIN b ON a.target_key = b.target_key AND a.later = b.job_id AND a.page_number = b.page_number AND a.item_index = b.item_index
WHERE a.id IS NULL OR b.id IS NULL OR regexp_replace(a.title, '{_SPACE}+', '', 'g') IS DISTINCT FROM regexp_replace(b.title, '{_SPACE}+', '', 'g')""")
def shifted_positions(items: DataFrame) -> DataFrame:
    """Places of each job's list that hold another title than in the job before it over the same target."""
    place = ["target_key", "page_number", "item_index"]
    rows = R.best_per_key(items.where("page_number IS NOT NULL AND item_index IS NOT NULL AND target_key IS NOT NULL").select("job_id", *place, "title", "id"), ["job_id", *place], [-F.col("id")])
    chain = Window.partitionBy("target_key").orderBy("job_id")
    jobs = rows.select("target_key", "job_id").distinct().select("target_key", "job_id", F.lag("job_id").over(chain).alias("prev"), F.lead("job_id").over(chain).alias("next"))
    before = rows.join(jobs.where("next IS NOT NULL"), ["target_key", "job_id"]).withColumn("job_id", F.col("next"))
    now = rows.join(jobs.where("prev IS NOT NULL"), ["target_key", "job_id"])
    return big(inventory.by_position(before, now, ["job_id", *place], "title"))


@query("scan_jobs", "scan_item_results", sql="""
WITH n AS (SELECT j.id, j.status, count(r.id) AS n_items, count(DISTINCT r.target_key || '~' || r.url) AS n_unique, count(*) FILTER (detail_status IN ('checked_complete', 'checked_incomplete', 'no_header', 'reused', 'skipped')) AS n_done, count(*) FILTER (detail_status IN ('exception', 'review_required')) AS n_exceptions, count(*) FILTER (r.id IS NOT NULL AND checked_at IS NULL) AS n_unchecked FROM scan_jobs j LEFT JOIN scan_item_results r ON r.job_id = j.id GROUP BY 1, 2)
SELECT id, status, n_items, n_unique, n_done, n_exceptions, concat_ws('; ', CASE WHEN n_items = 0 THEN 'no entries' END, CASE WHEN n_items <> n_unique THEN 'entries repeat' END, CASE WHEN n_done < n_items THEN 'entries are open' END, CASE WHEN n_exceptions > 0 THEN 'exceptions are left' END, CASE WHEN n_unchecked > 0 THEN 'entries were not checked' END) AS mismatches FROM n""")
def coverage(jobs: DataFrame, items: DataFrame) -> DataFrame:
    return R.coverage(jobs, items, DONE).select("id", "status", "n_items", "n_unique", "n_done", "n_exceptions", "mismatches")


@query("scan_item_results", sql="""
WITH p AS (SELECT job_id, target_key, page_number, count(*) AS n_rows, count(DISTINCT url) AS n_urls, count(DISTINCT item_index) AS places, max(item_index) AS last_place FROM scan_item_results WHERE page_number IS NOT NULL GROUP BY 1, 2, 3), l AS (SELECT job_id, target_key, max(page_number) AS last_page FROM p GROUP BY 1, 2)
SELECT p.job_id, p.target_key, CAST(page_number AS BIGINT) AS page_number, n_rows, n_urls, concat_ws('; ', CASE WHEN n_urls < n_rows THEN 'entries repeat' END, CASE WHEN places < n_rows THEN 'places repeat' END, CASE WHEN page_number < last_page AND places < 15 THEN 'page not full' END, CASE WHEN last_place >= 15 THEN 'place beyond the size' END) AS problems FROM p JOIN l ON p.job_id = l.job_id AND p.target_key = l.target_key""")
def page_validation(items: DataFrame) -> DataFrame:
    return big(R.page_checks(items))


@query("link_checks", sql="SELECT link_kind, original_url, source_area, link_text, source_page_url, min(id) AS id FROM link_checks GROUP BY ALL")
def distinct_links(links: DataFrame) -> DataFrame:
    return R.distinct_links(links.where("visible"), links.where("NOT visible OR visible IS NULL"))


@query("scan_jobs", "rule_findings", sql="SELECT id AS job_id, 'job' AS kind, status AS message, pause_reason AS reason, NULL::BIGINT AS finding_id FROM scan_jobs UNION ALL SELECT job_id, 'finding', rule_code, NULL, id FROM rule_findings")
def union_runs(jobs: DataFrame, findings: DataFrame) -> DataFrame:
    return report.run_record(jobs, findings)


# --- review and report --------------------------------------------------------------------------------------------


@query("rule_findings", "policy_documents", sql="SELECT f.id, f.rule_code, f.review_status, d.title, CASE WHEN f.review_status <> 'pending' THEN f.review_status || ' at severity ' || f.severity ELSE '' END AS note FROM (SELECT * FROM rule_findings QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) = 1) f JOIN policy_documents d ON d.id = f.document_id ORDER BY f.id DESC LIMIT 50 OFFSET 50")
def review_page(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """The second page of findings, each once, with the notes of decisions that were made."""
    one = R.best_per_key(findings, ["id"], [F.col("created_at")])
    decisions = one.where("review_status <> 'pending'").select(F.col("id").alias("finding_id"), F.concat("review_status", F.lit(" at severity "), "severity").alias("note"))
    return review.queue(one, docs, decisions, page=2, size=50).select("id", "rule_code", "review_status", "title", "note")


@query("rule_findings", "policy_documents", sql="SELECT f.id, f.rule_code, d.title FROM (SELECT * FROM rule_findings QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) = 1) f JOIN policy_documents d ON d.id = f.document_id ORDER BY f.id DESC LIMIT 500")
def newest_findings(findings: DataFrame, docs: DataFrame) -> DataFrame:
    return R.findings_with_documents(R.best_per_key(findings, ["id"], [F.col("created_at")]), docs).orderBy(F.desc("id")).limit(500).select("id", "rule_code", "title")


@query("rule_findings", sql="SELECT id, CASE WHEN severity = 'high' THEN 'confirmed' ELSE review_status END AS review_status FROM (SELECT * FROM rule_findings QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST) = 1)")
def decided_findings(findings: DataFrame) -> DataFrame:
    """Findings after decisions: all of high severity are confirmed, in two rounds of which the later counts."""
    one = R.best_per_key(findings, ["id"], [F.col("created_at")])
    rows = lambda decision, day: one.where("severity = 'high'").select(F.col("id").alias("finding_id"), F.lit(decision).alias("decision"), F.lit("").alias("note"), F.lit(date(2026, 1, day)).cast("timestamp").alias("decided_at"))
    return review.decided(one, rows("dismissed", 1), rows("confirmed", 2))[0].select("id", "review_status")


@query("scan_jobs", "scan_item_results", "rule_findings", "policy_documents", sql=f"""
WITH s AS (SELECT source_label AS source, count(*) AS n_items FROM scan_item_results WHERE source_label IS NOT NULL GROUP BY 1), i AS (SELECT DISTINCT job_id, source_label AS source, url, coalesce(nullif(document_id, 0), nullif(reused_document_id, 0)) AS document_id FROM scan_item_results), m AS (SELECT DISTINCT source, i.job_id, url, f.id, category FROM i JOIN rule_findings f USING (job_id, document_id)), c AS (SELECT source, category, count(*) AS n FROM m GROUP BY 1, 2)
SELECT s.source, coalesce(category, '{report.NO_ISSUE}') AS category, coalesce(n, 0) AS n, n_items FROM s LEFT JOIN c ON s.source = c.source""")
def report_summary(jobs: DataFrame, items: DataFrame, findings: DataFrame, docs: DataFrame) -> DataFrame:
    return report.summary(jobs, items, findings, docs)


@query("scan_item_results", "rule_findings", sql="""
WITH f AS (SELECT job_id, document_id, count(*) AS n, string_agg(rule_code, '、' ORDER BY id, rule_code, detail) AS codes FROM rule_findings GROUP BY 1, 2)
SELECT r.id, r.job_id, CASE WHEN NOT coalesce(header_detected, FALSE) THEN '无表头' WHEN len(missing_fields) > 0 THEN '表头不完整' ELSE '表头完整' END AS header_state, coalesce(nullif(topic_category, ''), '市级平台') AS topic, coalesce(codes, '') AS codes, coalesce(n, 0) AS n_findings FROM scan_item_results r LEFT JOIN f ON f.job_id = r.job_id AND f.document_id = coalesce(nullif(r.document_id, 0), nullif(r.reused_document_id, 0))""")
def report_detail(items: DataFrame, findings: DataFrame) -> DataFrame:
    return report.full_detail(items, findings).select("id", "job_id", "header_state", "topic", "codes", "n_findings")


# --- upserts ------------------------------------------------------------------------------------------------------


@query("link_checks", sql="SELECT job_id, document_id, original_url, source_area, source_page_url, link_text, arg_max(id, (coalesce(checked_at, TIMESTAMPTZ '1900-01-01'), id)) AS id FROM link_checks GROUP BY ALL")
def upsert_links(links: DataFrame) -> DataFrame:
    key = ["job_id", "document_id", "original_url", "source_area", "source_page_url", "link_text"]
    rows = links.select(*key, "id", "checked_at")
    middle = rows.agg(F.percentile_approx("id", 0.5)).first()[0] or 0
    first = keyed_upsert(rows.limit(0), rows.where(F.col("id") <= middle), key, [F.col("checked_at"), F.col("id")])
    return keyed_upsert(first, rows.where(F.col("id") > middle), key, [F.col("checked_at"), F.col("id")]).select(*key, "id")


@query("document_snapshots", sql="SELECT document_id, min(job_id) AS first_job_id, max(job_id) AS last_job_id, arg_max({'v': json_extract_string(raw_json, '$.title')}, (job_id, id)).v AS title, arg_max(json_extract_string(raw_json, '$.authored_date'), (job_id, id)) FILTER (json_extract_string(raw_json, '$.authored_date') IS NOT NULL) AS authored, CASE WHEN max(job_id) > (SELECT quantile_disc(job_id, 0.5) FROM document_snapshots) THEN 'seen again' ELSE 'seen' END AS state FROM document_snapshots GROUP BY 1")
def upsert_documents(records: DataFrame) -> DataFrame:
    """Documents over two deliveries: the first job stays, the newest title wins, the last date that is known is kept, and those of
    the second delivery are marked."""
    rows = records.select("document_id", F.col("job_id").alias("first_job_id"), F.col("job_id").alias("last_job_id"), F.get_json_object("raw_json", "$.title").alias("title"), F.get_json_object("raw_json", "$.authored_date").alias("authored"), "id", F.lit("seen").alias("state"))
    middle = rows.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY last_job_id)")).first()[0] or 0
    kinds = {"key": ["document_id"], "order": [F.col("last_job_id"), F.col("id")], "keep": ["first_job_id"], "fill": ["authored"]}
    old = keyed_upsert(rows.limit(0), rows.where(F.col("last_job_id") <= F.lit(middle)), **kinds)
    return keyed_upsert(old, rows.where(F.col("last_job_id") > F.lit(middle)), **kinds, last={"state": F.lit("seen again")}).drop("id")


@query("rule_findings", sql="SELECT id, job_id, document_id, rule_code, CASE WHEN review_status = 'pending' THEN 'reviewed' ELSE review_status END AS review_status FROM rule_findings f WHERE review_status = 'pending' OR NOT EXISTS (SELECT 1 FROM rule_findings p WHERE p.review_status = 'pending' AND p.job_id = f.job_id AND p.document_id = f.document_id)")
def replace_set(findings: DataFrame) -> DataFrame:
    """Findings after the sets of all documents with pending ones are delivered anew, without those that were decided."""
    rows = findings.select("id", "job_id", "document_id", "rule_code", "review_status")
    return replaced(rows, rows.where("review_status = 'pending'").withColumn("review_status", F.lit("reviewed")), ["job_id", "document_id"])


@query("scan_item_results", sql="SELECT id, job_id, target_key, CAST(page_number AS BIGINT) AS page_number, CASE WHEN id = max(id) OVER (PARTITION BY job_id, target_key, page_number, item_index) THEN item_index ELSE -id END AS item_index FROM scan_item_results WHERE page_number IS NOT NULL AND item_index IS NOT NULL")
def position_conflicts(items: DataFrame) -> DataFrame:
    rows = items.where("page_number IS NOT NULL AND item_index IS NOT NULL").select("id", "job_id", "target_key", "page_number", F.col("item_index").cast("bigint").alias("item_index"))
    return big(positions_marked(rows, ["job_id", "target_key", "page_number", "item_index"]))


# --- access log and streams ---------------------------------------------------------------------------------------

_LOG = "WITH l AS (SELECT user_id AS run_id, event_id, ts, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN 403 ELSE 200 END AS status, event_type = 'error' AS failed FROM events) "
_RUNS = _LOG + "SELECT event_id, run_id, length FROM (SELECT *, row_number() OVER (PARTITION BY run_id, failed, island ORDER BY ts, event_id) AS length FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY run_id, failed ORDER BY ts, event_id) AS island FROM l)) WHERE failed AND length >= 2"


@query("events", sql=_RUNS)
def fail_runs(events: DataFrame) -> DataFrame:
    return A.failure_runs(A.accesses(events), 2)


@query("events", sql=_LOG + "SELECT event_id, run_id, n FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS n FROM l WHERE NOT failed) WHERE n % 5 = 0")
def rest_points(events: DataFrame) -> DataFrame:
    return A.rest_points(A.accesses(events), 5)


@query("events", sql=_LOG + "SELECT event_id, run_id, 3600000000 - gap AS wait_us FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS gap FROM l) WHERE gap < 3600000000")
def access_gap(events: DataFrame) -> DataFrame:
    return A.short_gaps(A.accesses(events), 3600)


@query("events", sql=_LOG + "SELECT run_id, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS elapsed_us FROM l GROUP BY 1")
def run_elapsed(events: DataFrame) -> DataFrame:
    return A.elapsed(A.accesses(events))


@query("events", sql=_LOG + "SELECT run_id, count(*) AS n_accesses, count(*) FILTER (failed) AS n_failed, count(*) FILTER (status IN (403, 429)) AS n_refused, count(*) FILTER (status IN (403, 429) OR failed) AS n_events FROM l GROUP BY 1")
def access_counters(events: DataFrame) -> DataFrame:
    return A.counters(A.accesses(events))


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return S.read_stream(spark, f"{sf_dir}/{name}.parquet*", table(spark, sf_dir, name).schema)


def stream_failure_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(S.failure_alarms(A.accesses(_stream(spark, sf_dir, "events")), 2), "alarms").select("event_id", "run_id", "length")


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _stream(spark, sf_dir, "scan_item_results").where("url IS NOT NULL").select("target_key", "url")
    return S.drained(S.first_seen(stream, ["target_key", "url"]), "first-seen")


QUERIES |= {"stream_failure_alarms": stream_failure_alarms, "stream_first_seen": stream_first_seen}
SQL |= {"stream_failure_alarms": _RUNS, "stream_first_seen": "SELECT DISTINCT target_key, url FROM scan_item_results WHERE url IS NOT NULL"}

from sifthall import registry_captures, registry_runs  # noqa: E402, F401  (they register their queries)
