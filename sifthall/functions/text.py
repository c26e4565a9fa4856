"""Column expressions on document text: numbers, dates, labelled values, headers.

All of them are built-in expressions that stay in generated code; regular expressions use Unicode classes where the
text may hold full-width digits or unusual white space. Null gives null unless a docstring says otherwise.
"""

from __future__ import annotations

import unicodedata
from datetime import date

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The form of a document number, connectives that are no part of it, words around signature dates.
DOCUMENT_NUMBER = r"([\u4e00-\u9fff]{1,12}(?:办|发|规|字|令)?)\s*[〔\[【(（]\s*((?:20|19)\d{2})\s*[〕\]】)）]\s*(\d{1,4})\s*号"
CONNECTIVE = "^(?:另见|参见|以及|及|见|根据|依据|文件)"
FULL_DATE = r"((?:19|20)\d{2})\s*[年./-]\s*(\d{1,2})\s*[月./-]\s*(\d{1,2})\s*日?"
ISO_DATE = r"(?:19|20)\d{2}-\d{1,2}-\d{1,2}"
LONG_DATE = r"((?:19|20)\d{2})(?U:\s)*年(?U:\s)*(\d{1,2})(?U:\s)*月(?U:\s)*(\d{1,2})(?U:\s)*日"
NOT_A_SIGNATURE = ("有效期", "有效期限", "起施行", "施行日期", "执行日期", "废止")
SIGNING_BODIES = ("人民政府", "委员会", "办公室", "管理局", "监管局", "局", "中心", "部门")
HEADER_LABELS = ("索引号", "主题分类", "公开属性", "成文日期", "发文字号", "发布日期", "公开主体")


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^[\s\u001c-\u001f]+|[\s\u001c-\u001f]+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty; empty text if none is."""
    return F.coalesce(*[blank_to_null(c.cast("string")) for c in columns], F.lit(""))


def _digits(text: Column) -> Column:
    return F.translate(text, "０１２３４５６７８９", "0123456789")


def _number(prefix: Column, year: Column, index: Column) -> Column:
    return F.concat(F.regexp_replace(prefix, CONNECTIVE, ""), F.lit("〔"), year, F.lit("〕"), index.cast("int").cast("string"), F.lit("号"))


def document_number(text: Column) -> Column:
    """One form of a document number: tortoise-shell brackets, no white space, no leading zeros, no leading connective.
    Text that holds no number comes back without white space and with its brackets unified."""
    solid = _digits(F.regexp_replace(F.translate(strip(text), "【】[]（）", "〔〕〔〕〔〕"), r"(?U)\s+", ""))
    part = lambda k: F.regexp_extract(solid, DOCUMENT_NUMBER, k)
    return F.when(solid.rlike(DOCUMENT_NUMBER), _number(part(1), part(2), part(3))).otherwise(solid)


def document_number_parts(number: Column) -> Column:
    """struct(prefix, year, index) of a number in one form; nulls if it is none."""
    part = lambda k: blank_to_null(F.regexp_extract(number, DOCUMENT_NUMBER, k))
    return F.struct(part(1).alias("prefix"), part(2).cast("int").alias("year"), part(3).cast("int").alias("index"))


#: DOCUMENT_NUMBER read from its end, so that a search looks for one rare character instead of trying a run of ideographs
#: from every position. The prefix ends where a number before it ends, as it does when numbers are read from the left.
_FROM_THE_END = (
    r"号\s*(\d{1,4})\s*[〕\]】)）]\s*(\d{2}(?:02|91))\s*[〔\[【(（]\s*"
    r"((?:办|发|规|字|令)?(?:(?!号\s*\d{1,4}\s*[〕\]】)）]\s*\d{2}(?:02|91)\s*[〔\[【(（]\s*[\u4e00-\u9fff])[\u4e00-\u9fff]){1,12})"
)

#: Numbers that follow one another without a prefix of their own depend on what was read before them; such texts are read
#: from the left.
_IN_A_ROW = r"号\s*[〔\[【(（]\s*(?:20|19)\d{2}\s*[〕\]】)）]\s*\d{1,4}\s*号"

#: What every number ends with: texts without it are told apart by one look at their closing brackets.
_ANY_NUMBER = r"[〕\]】)）]\s*[0-9０-９]{1,4}\s*号"


def document_numbers(text: Column) -> Column:
    """All document numbers of a text in one form, each once, in order; an empty array for null."""
    plain = _digits(F.coalesce(text, F.lit("")))
    backwards = F.reverse(plain)
    end = lambda k: F.regexp_extract_all(backwards, F.lit(_FROM_THE_END), F.lit(k))
    found = F.reverse(F.arrays_zip(end(1).alias("i"), end(2).alias("y"), end(3).alias("p")))
    numbers = F.transform(found, lambda m: _number(F.reverse(m["p"]), F.reverse(m["y"]), F.reverse(m["i"])))
    start = lambda k: F.regexp_extract_all(plain, F.lit(DOCUMENT_NUMBER), F.lit(k))
    in_a_row = F.transform(F.arrays_zip(start(1).alias("p"), start(2).alias("y"), start(3).alias("i")), lambda m: _number(m["p"], m["y"], m["i"]))
    none = F.array().cast("array<string>")
    return F.when(text.rlike(_ANY_NUMBER), F.array_distinct(F.when(plain.rlike(_IN_A_ROW), in_a_row).otherwise(numbers))).otherwise(none)


def iso_date(text: Column) -> Column:
    """The first yyyy-m-d of a text if it is a real date in yyyy-mm-dd; later matches are not tried."""
    found = F.regexp_extract(text, ISO_DATE, 0)
    return F.when(F.length(found) == 10, F.try_to_date(found, "yyyy-MM-dd"))


def any_date(text: Column) -> Column:
    """As iso_date, else the first yyyy年m月d日."""
    part = lambda k: F.regexp_extract(text, LONG_DATE, k)
    return F.coalesce(iso_date(text), F.try_to_date(F.concat_ws("-", part(1), part(2), part(3)), "yyyy-M-d"))


def plausible_date(year: Column, month: Column, day: Column, as_of: date) -> Column:
    """A real date from 1990 to a year after ``as_of``, else null."""
    parsed = F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-M-d")
    return F.when(parsed.between(F.lit(date(1990, 1, 1)), F.date_add(F.lit(as_of), 366)), parsed)


def signature_date(text: Column, agency: Column, as_of: date) -> Column:
    """The date a document is signed with: the first line that is nothing but a plausible date, has no word of a period
    of validity in it or the two lines before, and follows a signature block (of the six lines before, the last block
    without blank lines) that names the agency or some public body. Null if there is none; never a guess."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"), strip)
    whole = f"^(?:{FULL_DATE})$"

    def block(before: Column) -> Column:
        start = F.struct(F.lit("").alias("text"), F.lit(False).alias("done"))

        def fold(state: Column, line: Column) -> Column:
            blank = line == ""
            ended = state["done"] | (blank & (state["text"] != ""))
            longer = F.when(state["text"] == "", line).otherwise(F.concat(state["text"], F.lit(" "), line))
            return F.struct(F.when(ended | blank, state["text"]).otherwise(longer).alias("text"), ended.alias("done"))

        return F.aggregate(F.reverse(before), start, fold)["text"]

    def of_line(line: Column, i: Column) -> Column:
        part = lambda k: F.regexp_extract(line, whole, k)
        context = F.array_join(F.slice(lines, F.greatest(i - 1, F.lit(1)), F.least(i + 1, F.lit(3))), " ")
        signed = block(F.slice(lines, F.greatest(i - 5, F.lit(1)), F.least(i, F.lit(6))))
        named = (F.coalesce(agency, F.lit("")) != "") & F.contains(signed, F.coalesce(agency, F.lit("")))
        ok = ~context.rlike("|".join(NOT_A_SIGNATURE)) & (named | signed.rlike("|".join(SIGNING_BODIES)))
        return F.when(line.rlike(whole), F.when(ok, plausible_date(part(1), part(2), part(3), as_of)))

    return F.try_element_at(F.filter(F.transform(lines, of_line), lambda d: d.isNotNull()), F.lit(1))


def labelled_value(text: Column, label: str) -> Column:
    """What follows the first ``label`` and an optional colon, to the end of the line; empty if there is none."""
    return strip(F.regexp_extract(text, rf"(?U)\Q{label}\E\s*[:：]?\s*([^\n]+)", 1))


def header_value(text: Column, label: str) -> Column:
    """What follows ``label`` and a colon on a line that begins with it; never crosses into the next line."""
    return strip(F.regexp_extract(text, rf"(?m)^[ \t]*\Q{label}\E[ \t]*[:：][ \t]*(.*)$", 1))


def has_header(text: Column, labels: tuple[str, ...] = HEADER_LABELS) -> Column:
    return text.rlike("(?:" + "|".join(labels) + r")[ \t]*[:：]")


def missing_labels(values: dict[str, Column]) -> Column:
    """Labels whose value is null or empty, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit("")) == "", F.lit(k)) for k, v in values.items()]))


def union_in_order(first: Column, second: Column) -> Column:
    return F.array_distinct(F.concat(F.coalesce(first, F.array().cast("array<string>")), F.coalesce(second, F.array().cast("array<string>"))))


def evidence_terms(terms: Column) -> Column:
    """Unique trimmed terms of two characters or more, the longest first (ties in order of code points)."""
    kept = F.array_distinct(F.filter(F.transform(terms, strip), lambda t: F.length(t) >= 2))
    order = lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.array_sort(kept, order)


def highlighted(text: Column, terms: list[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    """``text`` escaped for a page, with each of ``terms`` marked, the longest first."""
    import re

    known = sorted({t.strip() for t in terms if len(t.strip()) >= 2}, key=lambda t: (-len(t), t))
    shown = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(shown, "(" + "|".join(map(re.escape, known)) + ")", f"{before}$1{after}") if known else shown


def fingerprint(*fields: Column) -> Column:
    """sha256 of trimmed fields joined by bars, null as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(strip(f.cast("string")), F.lit("")) for f in fields]), 256)


def content_hash(**fields: Column) -> Column:
    """sha256 of the fields as one JSON object with its keys in order; null is a value of its own."""
    return F.sha2(F.to_json(F.struct(*[fields[k].cast("string").alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def stable_identity(target: Column, record_id: Column, url: Column) -> Column:
    """``target|id:…``, else ``target|url:…``, else null."""
    ident, address = blank_to_null(strip(record_id.cast("string"))), blank_to_null(strip(url))
    return F.when(ident.isNotNull(), F.concat(target, F.lit("|id:"), ident)).when(address.isNotNull(), F.concat(target, F.lit("|url:"), address))


def comparable(text: Column) -> Column:
    """Compatibility form without white space, for comparing titles. There is no such built-in, so it is an Arrow-batched
    function; use it on distinct values where there are many rows."""

    def work(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else "".join(unicodedata.normalize("NFKC", v).split()))

    return F.pandas_udf(work, "string")(text)


def decoded(code: Column, labels: dict[str, str]) -> Column:
    """The label of a code; an unknown code stays as it is."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[code], code)


def map_total(counts: Column) -> Column:
    """Sum of a map's values; 0 for an empty map or null."""
    return F.coalesce(F.aggregate(F.map_values(counts), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x.cast("bigint"), F.lit(0))), F.lit(0).cast("bigint"))
