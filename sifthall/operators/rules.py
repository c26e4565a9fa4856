"""Checks of a document's metadata against its text, as one array of findings per row that is then unfolded.

No rule needs a function in Python: each is a ``when`` over columns, and the order of the array is the order of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifthall.functions import text as T
from sifthall.operators.relational import SMALL, first_agency
from sifthall.plans.stage import broadcast_if_small

# The codes, kinds, severities and states below, the city of other bodies and the ends of their names.
CITY, OTHER_BODY = "上海市", r"[^\s，。；]{2,24}(?:委员会|局|办公室|中心)"


def _finding(code: str, category: str, severity: str, status: str, when: Column, page: Column, body: Column, detail: str) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("rule_code"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(status).alias("review_status"), page.cast("string").alias("page_value"), body.cast("string").alias("body_value"), F.lit(detail).alias("detail")))


def number_and_date_findings(late_after: int = 20) -> Column:
    """Findings of rows with ``number`` (in one form), ``numbers`` (of the body), ``authored_date``, ``published_date`` and
    ``workday_gap``. Null dates give no finding."""
    number, numbers, has = F.col("number"), F.col("numbers"), F.coalesce(F.col("number"), F.lit("")) != ""
    elsewhere = has & ~F.array_contains("numbers", F.coalesce(number, F.lit("")))
    year = T.document_number_parts(number)["year"]
    reversed_ = F.col("published_date") < F.col("authored_date")
    body = F.array_join("numbers", "、")
    return F.array_compact(F.array(
        _finding("DOC-003", "文号问题", "medium", "pending", elsewhere & (F.size(numbers) > 1), number, body, "body holds several other numbers"),
        _finding("DOC-001", "文号问题", "high", "confirmed", elsewhere & (F.size(numbers) == 1), number, body, "body holds another number"),
        _finding("DOC-002", "文号问题", "high", "confirmed", has & (year != F.year("authored_date")), number, F.col("authored_date"), "number's year is not the signature's"),
        _finding("DATE-002", "日期问题", "high", "confirmed", reversed_, F.col("published_date"), F.col("authored_date"), "published before signed"),
        _finding("DATE-001", "日期问题", "high", "confirmed", ~reversed_ & (F.col("workday_gap") > late_after), F.col("published_date"), F.col("authored_date"), "published late"),
    ))


def metadata_finding(missing: Column, has_header: Column, url: Column) -> Column:
    return F.array_compact(F.array(_finding("META-001", "元数据问题", "high", "confirmed", has_header & (F.size(missing) > 0), F.array_join(missing, "、"), url, "fields are missing")))


def unfolded(docs: DataFrame, findings: Column, key: str = "id") -> DataFrame:
    return docs.select(F.col(key).alias("document_id"), F.inline(findings))


def agency_findings(docs: DataFrame, agencies: DataFrame, city: str = CITY) -> DataFrame:
    """(document_id, rule_code, ...): the number's prefix, the title's and the signature's body held against the first
    agency that the document names. ``city`` is a pattern of the city whose bodies a title may name. Documents without number or agency, or of no known agency, have none."""
    names = F.concat(F.array("agency_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    known = broadcast_if_small(agencies.select(F.col("id").alias("agency_id"), names.alias("names"), "document_prefixes"), SMALL)
    rows = docs.withColumn("number", T.document_number(F.col("page_document_number"))).where("number <> '' AND issuing_agency <> ''")
    joined = rows.join(first_agency(docs, agencies), "id").join(known, "agency_id")
    prefix = T.document_number_parts(F.col("number"))["prefix"]
    title, tail, agency = F.coalesce("title", F.lit("")), F.right(F.coalesce("body_text", F.lit("")), F.lit(800)), F.col("issuing_agency")
    in_title = F.exists("names", lambda n: F.contains(title, n))
    in_tail = F.filter("names", lambda n: F.contains(tail, n))
    other = F.regexp_extract(title, city + OTHER_BODY, 0)
    found = F.array_compact(F.array(
        _finding("AGENCY-001", "机构问题", "medium", "pending", prefix.isNotNull() & ~F.exists("document_prefixes", lambda p: F.startswith(prefix, p)), agency, prefix, "number's prefix is not the agency's"),
        _finding("AGENCY-002", "机构问题", "medium", "pending", ~in_title & F.exists("names", lambda n: F.contains(n, F.lit("人民政府"))) & (other != ""), agency, other, "title names another body"),
        _finding("AGENCY-003", "机构问题", "medium", "pending", (F.size(in_tail) > 0) & ~F.exists(in_tail, lambda n: F.contains(agency, n)), agency, F.array_join(in_tail, "、"), "signature names another body"),
    ))
    return unfolded(joined, found)
