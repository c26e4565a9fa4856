"""The report of a job as seven tables, and its writers.

Sheets are DataFrames; nothing is collected to build them. ``write_sheets`` writes each as a folder of CSV or Parquet,
which holds for any size; ``write_workbook`` makes one .xlsx file from the standard library for reports that a person
opens, behind a check of the row limit of that format.
"""

from __future__ import annotations

import re
import zipfile
from datetime import date, datetime
from itertools import chain, islice
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifthall.functions import text as T
from sifthall.functions import workdays as W
from sifthall.operators import relational as R
from sifthall.operators import runs as J

# The sheets of a report, in order.
SHEETS = ("问题汇总", "超期与日期问题", "文号与机构问题", "外链问题", "全量明细", "元数据问题", "扫描运行记录")
NO_ISSUE = "无已发现问题"
ROWS_OF_XLSX = 1_048_575
_UNWRITABLE = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def header_state() -> Column:
    return F.when(~F.coalesce("header_detected", F.lit(False)), "无表头").when(F.size("missing_fields") > 0, "表头不完整").otherwise("表头完整")


def or_platform(column: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("市级平台"))


def summary(jobs: DataFrame, items: DataFrame, findings: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per source and category, and a row without issues for sources that have none."""
    sources = items.where("source_label IS NOT NULL").groupBy(F.col("source_label").alias("source")).agg(F.count(F.lit(1)).alias("n_items"))
    issues = R.issue_summary(items, findings, docs)
    return sources.join(issues, "source", "left").select("source", F.coalesce("category", F.lit(NO_ISSUE)).alias("category"), F.coalesce("n", F.lit(0)).alias("n"), "n_items")


def full_detail(items: DataFrame, findings: DataFrame) -> DataFrame:
    """Every entry with its state in words and the codes and details of its job's findings on its document."""
    own = R.ordered_concat(findings, ["job_id", "document_id"], "id", {"codes": ("rule_code", "、"), "details": ("detail", "；")}, "n_findings")
    i = items.withColumn("effective_id", R.effective_document())
    joined = i.join(own.withColumnRenamed("document_id", "effective_id"), ["job_id", "effective_id"], "left")
    parts = T.document_number_parts(T.document_number(F.col("page_document_number")))
    return joined.select(
        "id", "job_id", "source_label", "page_number", "item_index", "title", "url", "listed_date", header_state().alias("header_state"), or_platform("topic_category").alias("topic"),
        "issuing_agency", parts["year"].alias("number_year"), parts["index"].alias("number_index"), "published_date", "authored_date", F.array_join("missing_fields", "、").alias("missing"),
        F.coalesce("codes", F.lit("")).alias("codes"), F.coalesce("details", F.lit("")).alias("details"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"),
    )


def date_issues(findings: DataFrame, docs: DataFrame, days: DataFrame) -> DataFrame:
    rows = R.findings_with_documents(findings.where("category = '日期问题'").select("id", "job_id", "document_id", "rule_code", "category", "detail"), docs)
    gaps = W.with_gap(rows, "authored_date", "published_date", days)
    return gaps.withColumn("label", W.timeliness(F.col("workday_gap"), F.col("authored_date"), F.col("published_date")))


# What the report calls the outcomes of checks.
OUTCOMES = {
    "checked_complete": "表头完整，已检查", "checked_incomplete": "表头不完整，已记录问题", "no_header": "无表头 PASS", "no_header_pass": "无表头 PASS", "reused_baseline_detail": "基线复用（有表头）", "reused_baseline_no_header": "基线复用（无表头 PASS）",
    "reused_current_detail": "当期 URL 复用（有表头）", "reused_current_no_header": "当期 URL 复用（无表头 PASS）", "exception": "详情异常，待复测",
}
COVERED = {"complete": "完整"}


def _of_finding(findings: DataFrame, docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("id").alias("document_id"), "district", "source_id", or_platform("source_site").alias("source"), "title", "url", "issuing_agency", "page_document_number", "published_date", "authored_date")
    return findings.join(d, "document_id")


def sheet_dates(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """Findings on dates with the workdays that their text states."""
    rows = _of_finding(findings.where("category = '日期问题'"), docs)
    return rows.select("id", "source", "district", "title", "authored_date", "published_date", W.stated_gap(F.col("detail")).cast("bigint").alias("workdays"), F.when(F.col("rule_code") == "DATE-002", "日期倒置").otherwise("超期").alias("time_state"), "page_document_number", "rule_code", "detail", "review_status", "url")


def sheet_numbers(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """Findings on numbers and bodies, the number in its parts."""
    rows = _of_finding(findings.where(F.col("category").isin("文号问题", "机构问题")), docs).withColumn("number", T.document_number(F.col("page_document_number")))
    p = T.document_number_parts(F.col("number"))
    return rows.select("id", "source", "district", "title", p["prefix"].alias("number_type"), p["year"].alias("number_year"), p["index"].alias("number_index"), "number", "issuing_agency", "body_value", "rule_code", "detail", "evidence", "review_status")


def sheet_links(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Confirmed problems of links, with where they stand and where they led."""
    d = docs.select(F.col("id").alias("document_id"), or_platform("source_site").alias("source"), "district", "title", F.col("url").alias("document_url"))
    kept = links.where(R.visible_evidence() & (F.col("review_status") == "confirmed") & F.col("result").isin("broken", "error"))
    return kept.join(d, "document_id").select("id", "source", "district", "title", "link_kind", "source_area", "link_text", "source_page_url", "original_url", "final_url", "status_code", "result", "error_type", F.array_join("redirect_chain", " ").alias("chain"), "page_title", "document_url")


def sheet_detail(items: DataFrame, findings: DataFrame, days: DataFrame) -> DataFrame:
    """Every entry in all columns of the report: place from 1, state of the header, workdays, parts of the number, findings, outcome."""
    own = R.ordered_concat(findings, ["job_id", "document_id"], "id", {"codes": ("rule_code", "、"), "details": ("detail", "；")}, "n_findings").withColumnRenamed("document_id", "effective_id")
    rows = W.with_gap(items.withColumn("effective_id", R.effective_document()), "authored_date", "published_date", days).join(own, ["job_id", "effective_id"], "left").withColumn("number", T.document_number(F.col("page_document_number")))
    p = T.document_number_parts(F.col("number"))
    return rows.select(
        "id", "source_label", "channel_id", "page_number", (F.col("item_index") + 1).alias("place"), "listed_date", "title", header_state().alias("header_state"), "source_id", "topic_category", "disclosure_attribute", "authored_date", "page_document_number",
        "published_date", "issuing_agency", F.array_join("missing_fields", "、").alias("missing"), F.col("workday_gap").alias("workdays"), W.timeliness(F.col("workday_gap"), F.col("authored_date"), F.col("published_date")).alias("time_state"),
        p["prefix"].alias("number_type"), p["year"].alias("number_year"), p["index"].alias("number_index"), "number", F.coalesce("codes", F.lit("")).alias("codes"), F.coalesce("details", F.lit("")).alias("details"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"),
        T.decoded(F.col("detail_status"), OUTCOMES).alias("outcome"), "baseline_job_id", "reason", "url",
    )


def sheet_metadata(items: DataFrame) -> DataFrame:
    """One row per job and address with missing fields: incomplete checks before others, then the first in the report's order."""
    rows = items.where(F.size("missing_fields") > 0)
    first = [F.when(F.col("detail_status") == "checked_incomplete", 2).otherwise(1)]
    place = F.struct(F.coalesce("source_label", F.lit("")).alias("s"), F.coalesce("page_number", F.lit(0)).alias("p"), F.coalesce("item_index", F.lit(0)).alias("i"), "id")
    kept = rows.select("job_id", "url", first[0].alias("priority"), place.alias("place"), F.struct("source_label", "channel_id", "title", "source_id", F.array_join("missing_fields", "、").alias("missing"), "detail_status", "reason").alias("row"))
    best = kept.groupBy("job_id", "url").agg(F.min_by("row", F.struct(-F.col("priority"), "place")).alias("row"))
    return best.select("job_id", "url", "row.*")


def sheet_runs(jobs: DataFrame, progress: DataFrame, findings: DataFrame) -> DataFrame:
    """Each job in a row of its own, and what happened in it below: columns that do not concern a row are null."""
    covered = F.coalesce(F.create_map(*[F.lit(x) for pair in COVERED.items() for x in pair])[F.col("coverage_status")], F.lit("未完成"))
    own = jobs.join(progress.select("id", "examined", "total", "remaining"), "id", "left")
    rows = own.select(F.col("id").alias("job_id"), F.lit("job").alias("kind"), "mode", "status", covered.alias("coverage"), "examined", "total", "remaining", "access_count", F.coalesce(F.nullif("pause_reason", F.lit("")), "last_error").alias("message"))
    events = findings.select("job_id", F.col("rule_code").alias("kind"), F.col("detail").alias("message"), F.col("id").alias("event_id")).join(jobs.select(F.col("id").alias("job_id"), "mode", "status", covered.alias("coverage")), "job_id")
    return rows.unionByName(events, allowMissingColumns=True)


def sheet_summary(items: DataFrame, headers: DataFrame, findings: DataFrame, docs: DataFrame) -> DataFrame:
    """Each source with its kinds of findings in order, how much of it is covered and what remains."""
    labels = items.where("source_label IS NOT NULL").groupBy("job_id", "target_key").agg(F.min("source_label").alias("source"))
    covered = headers.join(labels, ["job_id", "target_key"]).groupBy("source").agg(F.sum("terminal").alias("examined"), F.sum(F.greatest("observed", "discovered")).alias("total"))
    listed = R.findings_of_items(items, findings).groupBy(F.col("source_label").alias("source"), "category").agg(F.count(F.lit(1)).alias("n"))
    joined = covered.join(listed, "source", "left")
    return joined.select("source", F.coalesce("category", F.lit(NO_ISSUE)).alias("category"), F.coalesce("n", F.lit(0)).alias("n"), "examined", "total", F.greatest(F.col("total") - F.col("examined"), F.lit(0)).alias("remaining")).orderBy("source", "category")


def run_record(jobs: DataFrame, findings: DataFrame) -> DataFrame:
    """Jobs and the events under them in one list: columns that one side lacks are null."""
    j = jobs.select(F.col("id").alias("job_id"), F.lit("job").alias("kind"), F.col("status").alias("message"), F.col("pause_reason").alias("reason"))
    e = findings.select("job_id", F.lit("finding").alias("kind"), F.col("rule_code").alias("message"), F.col("id").alias("finding_id"))
    return j.unionByName(e, allowMissingColumns=True)


def report(job_id: int, jobs: DataFrame, items: DataFrame, findings: DataFrame, links: DataFrame, docs: DataFrame, days: DataFrame) -> dict[str, DataFrame]:
    """The seven sheets of one job, in order."""
    of = lambda df: df.where(F.col("job_id") == job_id)
    i, f, own = of(items), of(findings), jobs.where(F.col("id") == job_id)
    headers = J.generations(i)
    tables = (sheet_summary(i, headers, f, docs), sheet_dates(f, docs), sheet_numbers(f, docs), sheet_links(of(links), docs), sheet_detail(i, f, days), sheet_metadata(i), sheet_runs(own, J.progress(own, headers), f))
    return dict(zip(SHEETS, tables, strict=True))


def column_widths(sheet: DataFrame, first_rows: int = 100) -> DataFrame:
    """(column, width): the longest of the first rows plus 2, from 10 to 48."""
    head = sheet.limit(first_rows)
    longest = head.agg(*[F.max(F.length(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(c) for c in sheet.columns])
    return longest.select(F.explode(F.create_map(*[x for c in sheet.columns for x in (F.lit(c), F.least(F.greatest(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(len(c))) + 2, F.lit(10)), F.lit(48)))])).alias("column", "width"))


def is_link(value: Column) -> Column:
    return F.startswith(value, F.lit("http://")) | F.startswith(value, F.lit("https://"))


def write_sheets(sheets: dict[str, DataFrame], path: str, format: str = "parquet") -> None:
    for name, sheet in sheets.items():
        flat = sheet.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in sheet.dtypes])
        writer = flat.write.mode("overwrite")
        (writer.option("header", True).csv if format == "csv" else writer.parquet)(f"{path}/{name}")


#: Sheets whose rows are marked, since each is a problem.
ALERTS = (SHEETS[1], SHEETS[2], SHEETS[3], SHEETS[5])
_STYLES = (
    '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="2"><font/><font><b/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
    '<fill><patternFill patternType="solid"><fgColor rgb="FFFFE8CC"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="5"><xf/><xf fontId="1" applyFont="1"/>'
    '<xf numFmtId="14" applyNumberFormat="1"/><xf fillId="2" applyFill="1"/><xf numFmtId="14" fillId="2" applyNumberFormat="1" applyFill="1"/></cellXfs></styleSheet>'
)
_HEADER, _DATE, _ALERT, _ALERT_DATE = 1, 2, 3, 4


def width_of(values: list, name: str) -> int:
    """Width of a column from its name and first values: the longest plus 2, from 10 to 48."""
    return min(max(max([len(name), *(len(str(v)) for v in values if v is not None)]) + 2, 10), 48)


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """One .xlsx file: a header row that stays in view, a filter, widths by the first hundred rows, dates as dates, addresses as
    links, and marked rows on sheets of problems. Rows are written as they come; none is kept but the first hundred."""
    content, relations, listed = [], [], []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for at, (name, sheet) in enumerate(sheets.items(), 1):
            if sheet.limit(ROWS_OF_XLSX + 1).count() > ROWS_OF_XLSX:
                raise ValueError(f"{name} has more rows than a sheet can hold; use write_sheets")
            columns, alert = sheet.columns, name in ALERTS
            rows = iter(sheet.toLocalIterator())
            first = [tuple(r) for r in islice(rows, 100)]
            widths = "".join(f'<col min="{k}" max="{k}" width="{width_of([r[k - 1] for r in first], c)}" customWidth="1"/>' for k, c in enumerate(columns, 1))
            with book.open(f"xl/worksheets/sheet{at}.xml", "w") as out:
                out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><cols>{widths}</cols><sheetData>'.encode())
                out.write(_row(tuple(columns), 1, _HEADER, _HEADER))
                n = 1
                for row in chain(first, rows):
                    n += 1
                    out.write(_row(tuple(row), n, _ALERT if alert else 0, _ALERT_DATE if alert else _DATE))
                out.write(f'</sheetData><autoFilter ref="A1:{_letters(len(columns) - 1)}{n}"/></worksheet>'.encode())
            content.append(f'<Override PartName="/xl/worksheets/sheet{at}.xml" ContentType="{_TYPE}.worksheet+xml"/>')
            relations.append(f'<Relationship Id="rId{at}" Type="{_RELATION}/worksheet" Target="worksheets/sheet{at}.xml"/>')
            listed.append(f'<sheet name="{escape(name)}" sheetId="{at}" r:id="rId{at}"/>')
        head, packed = '<?xml version="1.0" encoding="UTF-8"?>', "http://schemas.openxmlformats.org/package/2006"
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{packed}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{_TYPE}.styles+xml"/>{"".join(content)}</Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{packed}/relationships"><Relationship Id="rId1" Type="{_RELATION}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{packed}/relationships"><Relationship Id="rIdS" Type="{_RELATION}/styles" Target="styles.xml"/>{"".join(relations)}</Relationships>')
        book.writestr("xl/styles.xml", head + _STYLES)
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN}" xmlns:r="{_RELATION}"><sheets>{"".join(listed)}</sheets></workbook>')


_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def _letters(k: int) -> str:
    name = ""
    while k >= 0:
        name, k = chr(65 + k % 26) + name, k // 26 - 1
    return name


def _cell(value, place: str, style: int, date_style: int) -> str:
    if isinstance(value, bool) or value is None or isinstance(value, (list, tuple, dict)):
        value = "" if value is None else str(value)
    if isinstance(value, (int, float)):
        return f'<c r="{place}" s="{style}"><v>{value}</v></c>'
    if isinstance(value, date) and not isinstance(value, datetime):
        return f'<c r="{place}" s="{date_style}"><v>{(value - date(1899, 12, 30)).days}</v></c>'
    text = _UNWRITABLE.sub("", str(value))[:32_767]  # as much as a cell of this format can hold
    if text.startswith(("http://", "https://")) and len(text) <= 255:
        quoted = text.replace('"', '""')
        return f'<c r="{place}" s="{style}" t="str"><f>HYPERLINK("{escape(quoted)}")</f><v>{escape(text)}</v></c>'
    return f'<c r="{place}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _row(values: tuple, n: int, style: int, date_style: int) -> bytes:
    return f'<row r="{n}">{"".join(_cell(v, f"{_letters(k)}{n}", style, date_style) for k, v in enumerate(values))}</row>'.encode()
