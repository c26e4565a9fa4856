"""Queries on captured pages, responses, links and queues, built from tables, and their SQL.

Captures are made of tables here (a page of a list is a JSON text of its entries), so that what is read from them can be said in
SQL as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifthall.functions import text as T
from sifthall.functions import web
from sifthall.operators import inventory
from sifthall.operators import relational as R
from sifthall.operators import runs as J
from sifthall.registry import _STRIPPED, big, query
from sifthall.registry_runs import _G
from sifthall.sources import captures as C

SIZE = 15
_LISTS = "l AS (SELECT * REPLACE (CAST(job_id AS VARCHAR) || '~' || target_key AS channel_id) FROM scan_item_results WHERE page_number IS NOT NULL AND target_key IS NOT NULL)"
_PAGES = f"{_LISTS}, t AS (SELECT channel_id, count(*) AS total, CAST(max(page_number) AS BIGINT) AS declared FROM l GROUP BY 1), q AS (SELECT l.channel_id, CAST(page_number AS BIGINT) AS requested_page, count(*) AS n, any_value(total) AS total, any_value(declared) AS declared FROM l JOIN t ON t.channel_id = l.channel_id GROUP BY 1, 2)"
_IDENT = "CASE WHEN trim(coalesce(source_id, '')) <> '' THEN '|id:' || source_id WHEN url <> '' THEN '|url:' || url END"


def pages(items: DataFrame) -> DataFrame:
    """(requested_page, channel_id, body) of each list page of each job, as the list interface answers. An entry's flag is 1 unless it
    was skipped; every second way of naming a field is used where the first is empty."""
    rows = items.where("page_number IS NOT NULL AND target_key IS NOT NULL").withColumn("channel_id", F.concat_ws("~", F.col("job_id").cast("string"), "target_key"))
    total = rows.groupBy("channel_id").agg(F.count(F.lit(1)).alias("total"), F.max("page_number").cast("bigint").alias("declared"))
    flag = F.when(F.col("detail_status") == "skipped", "").otherwise("1")
    entry = F.struct(F.struct("item_index", "id").alias("at"), F.struct(F.col("source_id").alias("id"), flag.alias("doc_flag"), F.col("title").alias("name"), F.col("url").alias("link"), F.col("listed_date").cast("string").alias("displayDate")).alias("r"))
    lists = rows.groupBy("channel_id", F.col("page_number").cast("bigint").alias("requested_page")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["r"]).alias("list"))
    data = F.struct(F.struct("list", F.col("requested_page").alias("pageNo"), F.col("declared").alias("totalPage"), F.col("total").alias("totalCount")).alias("data"))
    return lists.join(total, "channel_id").select("requested_page", "channel_id", F.to_json(data).alias("body"))


@query("scan_item_results", sql=f"""
WITH {_PAGES}, c AS (SELECT channel_id, CAST(page_number AS BIGINT) AS requested_page, count(*) FILTER (detail_status = 'skipped') AS unflagged, count(*) FILTER (coalesce(title, '') = '' OR coalesce(url, '') = '') AS blank, count(DISTINCT coalesce(nullif(source_id, ''), '')) AS n_ids FROM l GROUP BY 1, 2),
v AS (SELECT q.*, unflagged, blank, n_ids, CASE WHEN q.requested_page < declared THEN {SIZE} ELSE total - (declared - 1) * {SIZE} END AS want FROM q JOIN c ON c.channel_id = q.channel_id AND c.requested_page = q.requested_page),
i AS (SELECT channel_id, CAST(page_number AS BIGINT) AS requested_page, {_IDENT} AS ident FROM l), f AS (SELECT channel_id, ident, min(requested_page) AS first_page FROM i GROUP BY 1, 2), a AS (SELECT i.channel_id, i.requested_page, count(*) AS n, count(*) FILTER (first_page < i.requested_page) AS again FROM i JOIN f ON f.channel_id = i.channel_id AND f.ident = i.ident GROUP BY 1, 2)
SELECT requested_page, channel_id, 'number of pages' AS violation FROM v WHERE declared <> CAST(ceil(total / {SIZE}.0) AS BIGINT) UNION ALL SELECT requested_page, channel_id, 'number of rows' FROM v WHERE total < 10000 AND n <> want UNION ALL SELECT requested_page, channel_id, 'flag' FROM v WHERE unflagged > 0
UNION ALL SELECT requested_page, channel_id, 'row without title or address' FROM v WHERE blank > 0 UNION ALL SELECT requested_page, channel_id, CASE WHEN again = n THEN 'page repeats' ELSE 'rows repeat across pages' END FROM a WHERE again > 0""")
def captured_pages(items: DataFrame) -> DataFrame:
    """Violations of pages; entries repeated within a page are those of ``captured_repeats``."""
    found = C.page_violations(C.list_pages(pages(items)), SIZE)
    return found.where("violation <> 'row twice in a page'").select("requested_page", "channel_id", "violation")


@query("scan_item_results", sql=rf"""WITH {_LISTS} SELECT CAST(page_number AS BIGINT) AS requested_page, channel_id, id_or_none AS api_id, title, url, listed_date, doc_flag, stable_id FROM (SELECT *, {_STRIPPED.replace("{x}", "coalesce(source_id, '')")} AS id_or_none, CASE WHEN detail_status = 'skipped' THEN '' ELSE '1' END AS doc_flag,
CASE WHEN {_STRIPPED.replace("{x}", "coalesce(source_id, '')")} <> '' THEN 't|id:' || {_STRIPPED.replace("{x}", "source_id")} WHEN {_STRIPPED.replace("{x}", "coalesce(url, '')")} <> '' THEN 't|url:' || {_STRIPPED.replace("{x}", "url")} END AS stable_id FROM (SELECT * REPLACE ({_STRIPPED.replace("{x}", "coalesce(title, '')")} AS title, {_STRIPPED.replace("{x}", "coalesce(url, '')")} AS url) FROM l))""")
def captured_items(items: DataFrame) -> DataFrame:
    return C.list_items(C.list_pages(pages(items)), "t", "").select("requested_page", "channel_id", "api_id", "title", "url", "listed_date", "doc_flag", "stable_id")


@query("scan_item_results", sql=f"WITH {_PAGES} SELECT channel_id, CAST(page_number AS BIGINT) AS requested_page, count(*) AS n FROM l WHERE page_number BETWEEN 1 AND 2 GROUP BY 1, 2")
def head_entries(items: DataFrame) -> DataFrame:
    return C.head_pages(C.list_items(C.list_pages(pages(items)), "t", "")).groupBy("channel_id", "requested_page").agg(F.count(F.lit(1)).alias("n"))


@query("scan_item_results", sql=f"WITH {_LISTS}, n AS (SELECT *, row_number() OVER (PARTITION BY channel_id, page_number ORDER BY item_index NULLS FIRST, id) - 1 AS place FROM l) SELECT channel_id, CAST(page_number AS BIGINT) AS requested_page, place AS item_index FROM n WHERE page_number > 2 OR (page_number = 2 AND place >= 3)")
def resumed_entries(items: DataFrame) -> DataFrame:
    """Entries from a cursor on."""
    return big(C.after(C.list_items(C.list_pages(pages(items)), "t", ""), 2, 3).select("channel_id", "requested_page", "item_index"))


@query("scan_item_results", sql=f"WITH {_PAGES}, i AS (SELECT channel_id, count(DISTINCT {_IDENT}) AS unique_rows FROM l GROUP BY 1), w AS (SELECT t.channel_id, declared, total, total = 45 AND coalesce((SELECT max(n) FROM q WHERE q.channel_id = t.channel_id AND q.requested_page = declared), 0) > total - (declared - 1) * {SIZE} AS capped, unique_rows FROM t JOIN i ON i.channel_id = t.channel_id) SELECT *, CASE WHEN capped THEN unique_rows ELSE total END AS real_total FROM w")
def capped_lists(items: DataFrame) -> DataFrame:
    return C.capped_lists(C.list_pages(pages(items)), SIZE, 45)


@query("scan_item_results", sql="""
WITH n AS (SELECT target_key, job_id, count(*) AS total, count(*) FILTER (detail_status IN ('checked_complete', 'checked_incomplete', 'no_header')) AS examined FROM scan_item_results WHERE target_key IS NOT NULL GROUP BY 1, 2), j AS (SELECT *, max(job_id) OVER (PARTITION BY target_key) AS last FROM n), b AS (SELECT target_key, arg_max(total, job_id) AS previous FROM j WHERE job_id < last GROUP BY 1)
SELECT j.target_key AS channel_id, total, previous, CASE WHEN examined > 0 AND total < examined THEN 'total below what was examined' WHEN examined > 0 AND total <> previous THEN 'total changed' END AS violation FROM j JOIN b ON b.target_key = j.target_key WHERE job_id = last""")
def revised_totals(items: DataFrame) -> DataFrame:
    """Totals of each target's last job against those of the job before it."""
    n = items.where("target_key IS NOT NULL").groupBy(F.col("target_key").alias("channel_id"), "job_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("detail_status").isin(*J.PERFORMED)).alias("examined"))
    last = n.groupBy("channel_id").agg(F.max("job_id").alias("last"))
    both = n.join(last, "channel_id")
    before = both.where("job_id < last").groupBy("channel_id").agg(F.max_by("total", "job_id").alias("total"))
    return C.revised_totals(both.where("job_id = last"), before)


@query("policy_documents", sql=rf"""SELECT id, {_STRIPPED.replace("{x}", "coalesce(title, '')")} AS title, CAST(id AS VARCHAR) AS business_id, {_STRIPPED.replace("{x}", "coalesce(source_id, '')")} AS site_id, published_date AS listed_date, CASE WHEN {_STRIPPED.replace("{x}", "coalesce(source_id, '')")} = '' THEN 'id missing' END AS violation FROM policy_documents""")
def captured_records(docs: DataFrame) -> DataFrame:
    """Records of the second kind of list, one response per document."""
    record = F.struct("title", F.col("id").cast("string").alias("businessId"), F.col("source_id").alias("siteId"), F.col("published_date").cast("string").alias("publishDate"))
    body = F.to_json(F.struct(F.struct(F.array(record).alias("records"), F.lit(1).alias("totalCount")).alias("data")))
    rows = C.record_items(docs.select(F.col("id").alias("page_number"), body.alias("body")))
    return rows.select(F.col("page_number").alias("id"), "title", "business_id", "site_id", "listed_date", "violation")


_LABELS = (("索引号", "source_id"), ("主题分类", "topic_category"), ("公开属性", "disclosure_attribute"), ("成文日期", "CAST(authored_date AS VARCHAR)"), ("发文字号", "page_document_number"), ("发布日期", "CAST(published_date AS VARCHAR)"), ("公开主体", "issuing_agency"))


@query("policy_documents", sql=f"""SELECT id, TRUE AS header_detected, concat_ws('、', {", ".join(f"CASE WHEN {_STRIPPED.replace('{x}', f'coalesce({c}, chr(32))')} = '' THEN '{label}' END" for label, c in _LABELS)}) AS missing, '' AS invalid FROM policy_documents""")
def detail_inspections(docs: DataFrame) -> DataFrame:
    """Detail pages whose header is given as pairs of label and value, as pages write them."""
    value = {"成文日期": F.col("authored_date").cast("string"), "发布日期": F.col("published_date").cast("string")}
    pairs = F.array(*[F.struct(F.lit(f" {label[:1]} {label[1:]}：").alias("label"), value.get(label, F.col(c) if "(" not in c else F.lit(None)).alias("value")) for label, c in _LABELS])
    seen = C.detail_inspection(docs.withColumn("metadata_pairs", pairs).withColumn("body_text", F.lit("")))
    return seen.select("id", "header_detected", F.array_join("missing", "、").alias("missing"), F.array_join("invalid", "、").alias("invalid"))


# --- responses and links ------------------------------------------------------------------------------------------


@query("link_checks", sql="""SELECT id, array_to_string(CASE WHEN len(c) > 6 THEN c[1:6] ELSE c END, ' ') AS chain, CASE WHEN len(c) > 6 OR len(c) = 0 THEN 'too_many_redirects' WHEN status_code BETWEEN 300 AND 399 THEN 'redirect_without_location' ELSE 'ok' END AS ending FROM (SELECT *, coalesce(redirect_chain, []) AS c FROM link_checks WHERE status_code IS NOT NULL)""")
def redirect_walks(links: DataFrame) -> DataFrame:
    """The addresses of each chain, one hop each, the last with the status that was stored."""
    rows = links.where("status_code IS NOT NULL").withColumn("c", F.coalesce("redirect_chain", F.array().cast("array<string>")))
    hop = lambda u, i: F.struct(u.alias("url"), F.when(i + 1 < F.size("c"), F.lit(302)).otherwise(F.col("status_code")).alias("status"), F.when(i + 1 < F.size("c"), F.lit("next")).alias("location"))
    walk = web.walk_redirects(F.transform("c", hop))
    return rows.select("id", F.array_join(walk["chain"], " ").alias("chain"), walk["end"].alias("ending"))


@query("link_checks", sql="""
SELECT id, CASE WHEN status_code IS NULL THEN 'broken' WHEN status_code IN (403, 429) THEN 'review_required' WHEN status_code < 400 THEN 'ok' ELSE 'broken' END AS click, CASE WHEN status_code IS NULL THEN 'click_no_response' WHEN status_code IN (403, 429) THEN 'access_restricted' WHEN status_code < 400 THEN '' ELSE 'http_error' END AS click_error,
CASE WHEN status_code BETWEEN 300 AND 399 AND coalesce(final_url, '') = '' THEN 'redirect_without_location' WHEN status_code BETWEEN 300 AND 399 THEN 'redirect_requires_review' WHEN status_code IN (403, 429) THEN 'access_restricted' WHEN status_code IN (200, 206) AND result = 'ok' THEN '' WHEN status_code IN (200, 206) THEN 'invalid_payload' ELSE 'http_error' END AS attachment_error,
CASE WHEN regexp_matches(lower(error_type), 'timed? ?out') THEN 'timeout' WHEN regexp_matches(lower(error_type), 'certificate|ssl') THEN 'certificate' WHEN regexp_matches(lower(error_type), 'name or service|getaddrinfo|nodename') THEN 'dns' WHEN regexp_matches(lower(error_type), 'connect') THEN 'connection' ELSE 'transport' END AS network FROM link_checks""")
def response_results(links: DataFrame) -> DataFrame:
    s = F.col("status_code")
    click, file = web.click_result(s), web.attachment_result(s, F.col("result") == "ok", F.col("final_url"))
    return links.select("id", click["result"].alias("click"), click["error_type"].alias("click_error"), file["error_type"].alias("attachment_error"), web.network_error(F.col("error_type")).alias("network"))


@query("link_checks", sql="WITH r AS (SELECT job_id, document_id, list(status_code ORDER BY id) FILTER (status_code IS NOT NULL) AS s FROM link_checks GROUP BY 1, 2) SELECT job_id, document_id, CAST(coalesce(list_filter(s, lambda x: x IN (403, 429))[1], s[-1], 200) AS BIGINT) AS status FROM r")
def observed_statuses(links: DataFrame) -> DataFrame:
    """One status per document and job of all answers: the first refusal, else the last."""
    each = links.groupBy("job_id", "document_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("status_code").isNotNull(), F.struct("id", "status_code")))), lambda x: x["status_code"]).alias("s"))
    return big(each.select("job_id", "document_id", web.observed_status(F.col("s")).alias("status")))


@query("link_checks", sql="""
WITH r AS (SELECT document_id, list({'url': original_url, 'status': status_code} ORDER BY id) AS responses, arg_max({'v': final_url}, id).v AS final_url, arg_min({'v': original_url}, id).v AS target_url FROM link_checks GROUP BY 1)
SELECT document_id, CAST(coalesce(list_filter(responses, lambda x: x.url = final_url)[-1].status, list_filter(responses, lambda x: x.url = target_url)[-1].status, responses[-1].status) AS BIGINT) AS status FROM r""")
def looked_up_statuses(links: DataFrame) -> DataFrame:
    """The answer for the last final address of a document's links, else for the first address, else the last answer."""
    rows = links.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.col("original_url").alias("url"), F.col("status_code").alias("status")))), lambda x: F.struct(x["url"].alias("url"), x["status"].alias("status"))).alias("responses"), F.max_by("final_url", "id").alias("final_url"), F.min_by("original_url", "id").alias("target_url"))
    return big(rows.select("document_id", web.response_for(F.col("responses"), F.col("final_url"), F.col("target_url")).alias("status")))


@query("link_checks", sql="SELECT id, link_kind, original_url FROM link_checks WHERE link_kind IN ('attachment', 'interpretation') AND original_url IS DISTINCT FROM source_page_url")
def related_links(links: DataFrame) -> DataFrame:
    """Links of the kinds that are followed, but for those of a page to itself."""
    return links.where(F.col("link_kind").isin("attachment", "interpretation") & ~F.col("original_url").eqNullSafe(F.col("source_page_url"))).select("id", "link_kind", "original_url")


@query("link_checks", sql="WITH r AS (SELECT document_id, max(nullif(link_text, '')) AS t, max(nullif(source_area, '')) AS a FROM link_checks GROUP BY 1) SELECT id, coalesce(t, link_text) AS taken_over, coalesce(nullif(source_area, ''), a, source_area) AS filled FROM link_checks l JOIN r ON r.document_id = l.document_id")
def link_metadata(links: DataFrame) -> DataFrame:
    """Columns of links from what is related to them: taken over, or only where a link has none of its own."""
    related = links.groupBy("document_id").agg(F.max(F.nullif("link_text", F.lit(""))).alias("link_text"), F.max(F.nullif("source_area", F.lit(""))).alias("source_area"))
    over = inventory.enriched(links.where("document_id IS NOT NULL").select("id", "document_id", "link_text", "source_area"), related, "document_id", ["link_text"], overwrite=True)
    both = inventory.enriched(over, related, "document_id", ["source_area"], overwrite=False)
    return both.select("id", F.col("link_text").alias("taken_over"), F.col("source_area").alias("filled"))


@query("link_checks", sql=f"SELECT id, regexp_replace(trim({_STRIPPED.replace('{x}', 'page_title')}, ' '), '[ \\t\\n\\f\\r\\x0b\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g') AS title, original_url AS href, link_text AS label FROM link_checks WHERE page_title NOT LIKE '%<%' AND page_title NOT LIKE '%>%' AND page_title NOT LIKE '%&%' AND link_text = trim(link_text) AND link_text NOT LIKE '%  %' AND link_text NOT LIKE '%<%' AND original_url <> ''")
def page_parts(links: DataFrame) -> DataFrame:
    """Title and anchor of pages, read from their markup. Titles that would be markup themselves take no part."""
    plain = (~F.col("page_title").rlike("[<>&]")) & (F.col("link_text") == F.trim("link_text")) & ~F.col("link_text").contains("  ") & ~F.col("link_text").contains("<") & (F.col("original_url") != "")
    html = F.concat(F.lit("<html><head><title lang='zh'>\n "), "page_title", F.lit(" </title></head><body><p>x</p><a class='k' href=\""), "original_url", F.lit("\"> <b>"), "link_text", F.lit("</b></a></body></html>"))
    rows = links.where(plain).withColumn("html", html)
    anchor = F.try_element_at(C.anchors(F.col("html")), F.lit(1))
    return rows.select("id", web.title(F.col("html")).alias("title"), anchor["href"].alias("href"), anchor["text"].alias("label"))


@query("link_checks", sql="""
SELECT id, CASE WHEN length(coalesce(evidence, page_title, '')) = 0 THEN 'empty_file' WHEN starts_with(lower(ltrim(coalesce(evidence, page_title))), '<html') OR starts_with(lower(ltrim(coalesce(evidence, page_title))), '<!doctype') THEN 'html_error' WHEN regexp_matches(lower(regexp_extract(original_url, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '\\.pdf$') THEN 'invalid_pdf' WHEN regexp_matches(lower(regexp_extract(original_url, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '\\.(docx|xlsx|doc|xls)$') THEN 'invalid_office_file' ELSE '' END AS error FROM link_checks""")
def payload_errors(links: DataFrame) -> DataFrame:
    """Texts in place of files: what a download is whose bytes are a title."""
    return links.select("id", web.payload_error(F.col("original_url"), F.lit("application/octet-stream"), F.encode(F.coalesce("evidence", "page_title", F.lit("")), "UTF-8"))["error"].alias("error"))


@query("link_checks", sql="SELECT id, CASE WHEN review_status = 'confirmed' THEN result ELSE CASE WHEN status_code IN (403, 429) THEN 'review_required' WHEN status_code < 400 THEN 'ok' ELSE 'broken' END END AS result FROM link_checks")
def prechecked_links(links: DataFrame) -> DataFrame:
    """A result that was found before comes before that of a fetch."""
    known = F.when(F.col("review_status") == "confirmed", F.col("result"))
    return links.select("id", F.coalesce(known, web.click_result(F.col("status_code"))["result"]).alias("result"))


# --- queues and small expressions ---------------------------------------------------------------------------------


def _queue(items: DataFrame) -> DataFrame:
    g = J.generation_items(items)
    status = F.when(F.col("state") == "review", "retry").otherwise(F.col("state"))
    return g.select(F.concat_ws("|", F.col("job_id").cast("string"), "target_key", "url").alias("stable_id"), status.alias("status"), "page_number", "item_index", "document_id", F.lit(0).alias("attempt"))


_Q = f"{_G}, u AS (SELECT CAST(job_id AS VARCHAR) || '|' || target_key || '|' || url AS stable_id, CASE WHEN state = 'review' THEN 'retry' ELSE state END AS status, page_number, item_index, document_id FROM g)"


@query("scan_item_results", sql=f"WITH {_Q}, c AS (SELECT stable_id FROM u WHERE status IN ('pending', 'retry') ORDER BY page_number NULLS FIRST, item_index NULLS FIRST, stable_id LIMIT 100) SELECT u.stable_id, CASE WHEN c.stable_id IS NOT NULL THEN 'checking' ELSE status END AS status, CASE WHEN c.stable_id IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS attempt FROM u LEFT JOIN c ON c.stable_id = u.stable_id")
def claimed_entries(items: DataFrame) -> DataFrame:
    """A batch of one hundred entries claimed from the queue, by page and place."""
    return big(inventory.claimed(_queue(items), 100).select("stable_id", "status", "attempt"))


@query("scan_item_results", sql=f"WITH {_Q} SELECT stable_id, CASE WHEN status = 'retry' THEN 'review' ELSE status END AS status, document_id FROM u")
def completed_entries(items: DataFrame) -> DataFrame:
    """All retries end in a review, without losing the document that is known."""
    q = _queue(items)
    done = q.where("status = 'retry'").select("stable_id", F.lit("review").alias("status"), F.lit(None).cast("bigint").alias("document_id"))
    return inventory.completed(q, done).select("stable_id", "status", "document_id")


@query("scan_item_results", sql="""
WITH p AS (SELECT target_key, url, arg_max(coalesce(title, ''), (job_id, id)) AS new_print, arg_min(coalesce(title, ''), (job_id, id)) AS old_print, arg_min(detail_status, (job_id, id)) AS s FROM scan_item_results WHERE url IS NOT NULL AND target_key IS NOT NULL GROUP BY 1, 2)
SELECT target_key || '|' || url AS stable_id, new_print AS fingerprint, CASE WHEN s IN ('checked_complete', 'no_header') AND new_print <> old_print THEN 'pending' WHEN s IN ('checked_complete', 'no_header') THEN 'completed' WHEN s = 'reused' AND new_print <> old_print THEN 'pending' WHEN s = 'reused' THEN 'reused' ELSE 'review' END AS status FROM p""")
def reopened_entries(items: DataFrame) -> DataFrame:
    """Entries as first known, after they were discovered as last known: finished ones whose title changed are opened again."""
    rows = items.where("url IS NOT NULL AND target_key IS NOT NULL").select(F.concat_ws("|", "target_key", "url").alias("stable_id"), F.coalesce("title", F.lit("")).alias("fingerprint"), "detail_status", F.struct("job_id", "id").alias("at"))
    one = rows.groupBy("stable_id").agg(F.min_by(F.struct("fingerprint", "detail_status"), "at").alias("old"), F.max_by("fingerprint", "at").alias("new"))
    status = F.when(F.col("old.detail_status").isin("checked_complete", "no_header"), "completed").when(F.col("old.detail_status") == "reused", "reused").otherwise("review")
    known = one.select("stable_id", F.col("old.fingerprint").alias("fingerprint"), status.alias("status"), F.lit(0).alias("attempt"))
    return inventory.discovered(known, one.select("stable_id", F.col("new").alias("fingerprint"))).select("stable_id", "fingerprint", "status")


@query("scan_item_results", sql="WITH r AS (SELECT target_key || '|' || url AS stable_id, min(page_number) AS page_number FROM scan_item_results WHERE url IS NOT NULL AND page_number BETWEEN 1 AND 3 GROUP BY 1), n AS (SELECT page_number, count(*) AS c FROM r GROUP BY 1) SELECT stable_id, CAST(page_number AS BIGINT) AS round FROM r")
def caught_up_entries(items: DataFrame) -> DataFrame:
    """Three readings of the head of all lists, each of one page."""
    of = lambda p: items.where((F.col("page_number") == p) & F.col("url").isNotNull()).select(F.concat(F.col("target_key"), F.lit("|"), F.col("url")).alias("stable_id"))
    return big(inventory.caught_up([of(1), of(2), of(3)], of(1).limit(0)))


@query("scan_item_results", sql="SELECT id, array_to_string(list_distinct_ordered, '、') AS fields FROM (SELECT id, list_filter(u, lambda x, k: list_position(u, x) = k) AS list_distinct_ordered FROM (SELECT id, list_concat(missing_fields, ['发布日期', '主题分类']) AS u FROM scan_item_results WHERE missing_fields IS NOT NULL))")
def fields_in_order(items: DataFrame) -> DataFrame:
    return items.where("missing_fields IS NOT NULL").select("id", F.array_join(T.union_in_order(F.col("missing_fields"), F.array(F.lit("发布日期"), F.lit("主题分类"))), "、").alias("fields"))


@query("scan_item_results", sql="SELECT job_id, count(*) AS total FROM scan_item_results WHERE source_label IS NOT NULL GROUP BY 1")
def totals_of_maps(items: DataFrame) -> DataFrame:
    """The sum of a map of counts by source, as a job keeps it."""
    counts = items.where("source_label IS NOT NULL").groupBy("job_id", "source_label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("source_label", "n"))).alias("m")).select("job_id", T.map_total(F.col("m")).alias("total"))


@query("agency_rules", sql="SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat(aliases, [agency_name, ' ' || agency_name, 'x']), lambda x: trim(x)), lambda x: len(x) >= 2)), 'ASC'), '|') AS terms FROM agency_rules")
def evidence_terms(agencies: DataFrame) -> DataFrame:
    terms = T.evidence_terms(F.concat("aliases", F.array("agency_name", F.concat(F.lit(" "), "agency_name"), F.lit("x"))))
    return agencies.select("id", F.array_join(F.array_sort(terms), "|").alias("terms"))


@query("policy_documents", sql="SELECT id, regexp_replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(实施方案|公告|方案)', '<mark>\\1</mark>', 'g') AS shown FROM policy_documents")
def highlighted_titles(docs: DataFrame) -> DataFrame:
    return docs.select("id", T.highlighted(F.col("title"), ["方案", "实施方案", " 公告", "x"]).alias("shown"))


@query("scan_item_results", sql=f"WITH {_PAGES} SELECT channel_id, requested_page, CAST(ceil(total / {SIZE}.0) AS BIGINT) AS pages, greatest(least(total - (requested_page - 1) * {SIZE}, {SIZE}), 0) AS rows_due FROM q")
def expected_rows(items: DataFrame) -> DataFrame:
    p = C.list_pages(pages(items)).select("channel_id", "requested_page", F.col("page.totalCount").alias("total"))
    return p.select("channel_id", "requested_page", R.expected_pages(F.col("total"), SIZE).alias("pages"), R.expected_rows(F.col("total"), F.col("requested_page"), SIZE).alias("rows_due"))
