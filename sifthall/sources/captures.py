"""Captured list responses, detail pages and HTTP answers as sources.

Live collection is serial and polite by nature and stays outside the executors; what it captured is read here. List
responses are JSON texts, detail pages are texts with label and value pairs, answers are rows per hop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sifthall.functions import text as T
from sifthall.functions import web

LIST_SCHEMA = "data struct<list:array<struct<id:string,doc_flag:string,docFlag:string,channel_id:string,title:string,name:string,url:string,link:string,linkUrl:string,website:string,display_date:string,displayDate:string>>,pageNo:bigint,totalPage:bigint,totalCount:bigint>"
RECORDS_SCHEMA = "data struct<records:array<struct<title:string,businessId:string,siteId:string,publishDate:string,displayDate:string>>,totalCount:bigint>"


def read_captures(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None) -> DataFrame:
    """Captures in any file format of Spark; a given schema spares the pass that infers one."""
    reader = spark.read.format(format)
    return (reader.schema(schema) if schema else reader).load(path)


def read_files(spark: SparkSession, path: str, most_bytes: int = 65536) -> DataFrame:
    """(path, length, prefix) of downloaded files: only the first bytes go on."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.substring("content", 1, most_bytes).alias("prefix"))


def list_pages(captures: DataFrame, body: str = "body") -> DataFrame:
    """``captures`` with the parsed page and a list of violations of its shape."""
    page = F.from_json(body, LIST_SCHEMA)["data"]
    parsed = captures.withColumn("page", page)
    shape = F.array_compact(F.array(F.when(F.col("page").isNull() | F.col("page.list").isNull(), "no list"), F.when(F.col("page.totalCount").isNull(), "no total"), F.when(F.col("page.pageNo").isNull(), "no page number")))
    return parsed.withColumn("violations", shape)


def page_violations(pages: DataFrame, size: int, cap: int = 10_000) -> DataFrame:
    """(requested_page, channel_id, violation) of pages of ``list_pages``: echo, range, number of pages and of rows, flags,
    rows without id; pages beyond a capped total must hold rows that no page before them held."""
    n = F.size("page.list")
    total, declared = F.col("page.totalCount"), F.col("page.totalPage")
    expected = F.ceil(total / size)
    beyond = (total >= cap) & (F.col("requested_page") > declared)
    want = F.when(F.col("requested_page") < declared, F.lit(size)).when(F.col("requested_page") == declared, total - (declared - 1) * size).otherwise(F.lit(0))
    checks = F.array_compact(F.array(
        F.when(~beyond & (F.col("page.pageNo") != F.col("requested_page")), "page echo"), F.when(declared != expected, "number of pages"),
        F.when(~beyond & (total < cap) & (n != want), "number of rows"), F.when(~beyond & (F.col("requested_page") > F.greatest(declared, F.lit(1))), "page out of range"),
        F.when(F.exists("page.list", lambda r: F.coalesce(r["doc_flag"], r["docFlag"], F.lit("")) != "1"), "flag"),  # an empty flag is one
        F.when(F.exists("page.list", lambda r: (T.first_filled(r["title"], r["name"]) == "") | (T.first_filled(r["url"], r["link"], r["linkUrl"], r["website"]) == "")), "row without title or address"),
        F.when(F.size(F.array_distinct(F.transform("page.list", lambda r: T.first_filled(r["id"], r["url"])))) < n, "row twice in a page"),
    ))
    own = pages.select("requested_page", "channel_id", F.explode(F.concat("violations", F.coalesce(checks, F.array().cast("array<string>")))).alias("violation"))
    rows = list_items(pages, "", "")
    first = rows.groupBy("channel_id", "stable_id").agg(F.min("requested_page").alias("first_page"))
    again = rows.join(first, ["channel_id", "stable_id"]).groupBy("requested_page", "channel_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("first_page") < F.col("requested_page")).alias("n_again"))
    repeated = again.where("n_again > 0").select("requested_page", "channel_id", F.when(F.col("n_again") == F.col("n"), "page repeats").otherwise("rows repeat across pages").alias("violation"))
    return own.unionByName(repeated)


def list_items(pages: DataFrame, target: str, base_url: str) -> DataFrame:
    """One row per list entry: place, aliases of fields resolved, identity and fingerprint. ``base_url`` resolves relative
    addresses; left empty they stay as they are."""
    rows = pages.select("requested_page", "channel_id", F.posexplode("page.list").alias("item_index", "r"))
    r = lambda *names: T.strip(T.first_filled(*[F.col("r")[x] for x in names]))
    address = r("url", "link", "linkUrl", "website")
    if base_url:
        address = F.when(address.rlike("^https?://"), address).otherwise(web.resolve(F.lit(base_url), address))
    flat = rows.select("requested_page", "channel_id", "item_index", r("id").alias("api_id"), r("title", "name").alias("title"), address.alias("url"), T.any_date(r("display_date", "displayDate")).alias("listed_date"), F.coalesce(F.col("r")["doc_flag"], F.col("r")["docFlag"], F.lit("")).alias("doc_flag"))
    printed = T.fingerprint(F.col("title"), F.col("listed_date"), F.col("url"), F.col("doc_flag"))
    return flat.withColumn("stable_id", T.stable_identity(F.lit(target), F.col("api_id"), F.col("url"))).withColumn("fingerprint", printed)


def record_items(captures: DataFrame, body: str = "body") -> DataFrame:
    """Entries of the second kind of list response, with a violation where an id is missing."""
    rows = captures.select("page_number", F.posexplode(F.from_json(body, RECORDS_SCHEMA)["data"]["records"]).alias("item_index", "r"))
    business, site = T.strip(T.first_filled(F.col("r.businessId"))), T.strip(T.first_filled(F.col("r.siteId")))
    return rows.select("page_number", "item_index", T.strip(T.first_filled(F.col("r.title"))).alias("title"), business.alias("business_id"), site.alias("site_id"), T.iso_date(T.first_filled(F.col("r.publishDate"), F.col("r.displayDate"))).alias("listed_date"), F.when((business == "") | (site == ""), "id missing").alias("violation"))


def after(items: DataFrame, page: int, index: int) -> DataFrame:
    """Entries from a cursor on: pages and places beyond it."""
    return items.where((F.col("requested_page") > page) | ((F.col("requested_page") == page) & (F.col("item_index") >= index)))


def detail_inspection(pages: DataFrame, text: str = "body_text", pairs: str = "metadata_pairs") -> DataFrame:
    """``pages`` with ``header_detected``, ``values`` (label to value; pairs found in the page override blanks of its text),
    ``missing`` and ``invalid`` labels; a pair's label may end in a colon and hold white space. Without any header all three are null: nothing was to be checked."""
    from_text = F.create_map(*[x for label in T.HEADER_LABELS for x in (F.lit(label), T.header_value(F.coalesce(F.col(text), F.lit("")), label))])
    cleaned = F.transform(F.coalesce(F.col(pairs), F.array().cast("array<struct<label:string,value:string>>")), lambda p: F.struct(F.regexp_replace(F.regexp_replace(p["label"], r"(?U)\s+", ""), "[:：]$", "").alias("label"), p["value"].alias("value")))
    own = F.filter(cleaned, lambda p: p["label"].isin(*T.HEADER_LABELS) & (T.strip(F.coalesce(p["value"], F.lit(""))) != ""))
    value = lambda label: F.coalesce(T.strip(F.try_element_at(F.filter(own, lambda p: p["label"] == label), F.lit(-1))["value"]), F.element_at(from_text, label))
    values = F.create_map(*[x for label in T.HEADER_LABELS for x in (F.lit(label), value(label))])
    named = F.exists(cleaned, lambda p: p["label"].isin(*T.HEADER_LABELS))
    detected = named | F.coalesce(T.has_header(F.col(text)), F.lit(False))
    got = pages.withColumn("header_detected", detected).withColumn("values", F.when(F.col("header_detected"), values))
    missing = T.missing_labels({label: F.element_at("values", label) for label in T.HEADER_LABELS})
    dates = ("成文日期", "发布日期")
    invalid = F.array_compact(F.array(*[F.when((F.element_at("values", d) != "") & T.any_date(F.element_at("values", d)).isNull(), F.lit(f"{d}（格式无效）")) for d in dates]))
    return got.withColumn("missing", F.when(F.col("header_detected"), missing)).withColumn("invalid", F.when(F.col("header_detected"), invalid))


def anchors(html: Column) -> Column:
    """Addresses and texts of the anchors of a page, in order: array of struct(href, text)."""
    pattern = r'(?is)<a\b[^>]*?\bhref\s*=\s*["\']([^"\']*)["\'][^>]*>(.*?)</a>'
    part = lambda k: F.regexp_extract_all(html, F.lit(pattern), F.lit(k))
    return F.transform(F.arrays_zip(part(1).alias("href"), part(2).alias("text")), lambda a: F.struct(a["href"].alias("href"), F.trim(F.regexp_replace(web.plain_text(a["text"]), r"(?U)\s+", " ")).alias("text")))


def is_list_response(url: Column, request: Column, path: str, site: str) -> Column:
    """Whether a captured answer is that of a list of exactly one site: by the end of its address and the request's body."""
    asked = F.from_json(request, "siteIdList array<string>")["siteIdList"]
    return F.coalesce(F.endswith(F.try_parse_url(url, F.lit("PATH")), F.lit(path)) & (asked == F.array(F.lit(site))), F.lit(False))


# What a detail page says once its metadata is there: its date, and its body by one of two names.
READY, READY_BODY = "发布日期", ("发文单位", "发布机构")


def is_ready(text: Column) -> Column:
    """Whether a detail page has come with its metadata."""
    has = lambda word: F.contains(text, F.lit(word))
    return F.coalesce(has(READY) & (has(READY_BODY[0]) | has(READY_BODY[1])), F.lit(False))


def head_pages(items: DataFrame, n: int = 2) -> DataFrame:
    """Entries of the first ``n`` pages of each list: what a look at its head brings."""
    return items.where(F.col("requested_page").between(1, n))


def capped_lists(pages: DataFrame, size: int, cap: int) -> DataFrame:
    """(channel_id, declared, total, capped, unique_rows, real_total) of each list: its total is capped if it stands at the cap and there
    are rows beyond the declared pages, or more on the last of them than the total leaves for it. The real total is then what was
    read, each entry once."""
    rows = list_items(pages, "", "")
    last = F.max(F.when(F.col("requested_page") == F.col("page.totalPage"), F.size("page.list")))
    own = pages.groupBy("channel_id").agg(F.max("page.totalCount").alias("total"), F.max("page.totalPage").alias("declared"), last.alias("on_last"), F.max(F.when(F.size("page.list") > 0, F.col("requested_page"))).alias("filled"))
    unique = rows.groupBy("channel_id").agg(F.countDistinct("stable_id").alias("unique_rows"))
    capped = (F.col("total") == cap) & ((F.coalesce("filled", F.lit(0)) > F.col("declared")) | (F.coalesce("on_last", F.lit(0)) > F.col("total") - (F.col("declared") - 1) * size))
    joined = own.join(unique, "channel_id", "left").withColumn("capped", F.coalesce(capped, F.lit(False)))
    return joined.select("channel_id", "declared", "total", "capped", F.coalesce("unique_rows", F.lit(0)).alias("unique_rows"), F.when(F.col("capped"), F.coalesce("unique_rows", F.lit(0))).otherwise(F.col("total")).alias("real_total"))


def revised_totals(now: DataFrame, before: DataFrame) -> DataFrame:
    """(channel_id, total, previous, violation) of lists (channel_id, total, examined) that were read before: a total that changed while
    entries were examined, or fell below them."""
    joined = now.select("channel_id", "total", "examined").join(before.select("channel_id", F.col("total").alias("previous")), "channel_id")
    violation = F.when((F.col("examined") > 0) & (F.col("total") < F.col("examined")), "total below what was examined").when((F.col("examined") > 0) & (F.col("total") != F.col("previous")), "total changed")
    return joined.select("channel_id", "total", "previous", violation.alias("violation"))


def ready_captures(captures: DataFrame, key: str, text: str, attempt: str, most: int = 2) -> DataFrame:
    """One capture per page: the first of ``most`` that is ready, else the last of them."""
    tried = captures.where(F.col(attempt) <= most)
    rank = F.struct(is_ready(F.col(text)).cast("int").alias("ready"), F.when(is_ready(F.col(text)), -F.col(attempt)).otherwise(F.col(attempt)).alias("n"))
    others = [c for c in captures.columns if c != key]
    return tried.groupBy(key).agg(F.max_by(F.struct(*others), rank).alias("one")).select(key, "one.*")
