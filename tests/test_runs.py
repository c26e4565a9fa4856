from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sifthall.functions import text as T
from sifthall.functions import workdays as W
from sifthall.operators import runs as J
from sifthall.plans.merge import BucketedTable
from sifthall.sources import captures as C
from sifthall.streaming import jobs as S

NOON = datetime(2026, 3, 2, 12)
JOBS = "id bigint, mode string, status string, coverage_status string, source_signature array<string>, created_at timestamp, started_at timestamp, finished_at timestamp, baseline_job_id bigint, pause_reason string, last_error string, access_count int"
ITEMS = "id bigint, job_id bigint, target_key string, source_label string, url string, title string, listed_date date, detail_status string, page_number int, item_index int, document_id bigint, reused_document_id bigint, baseline_job_id bigint, link_check_version int, header_detected boolean, missing_fields array<string>, checked_at timestamp, state string, n int"
LINKS = "id bigint, job_id bigint, document_id bigint, original_url string, source_area string, source_page_url string, link_text string, visible boolean, review_status string, result string, status_code int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def at(hours):
    return NOON + timedelta(hours=hours)


def job(i, mode="full", status="completed", sources=("a", "b"), start=0, end=1, reason="", coverage="complete"):
    return i, mode, status, coverage, list(sources) if sources is not None else None, at(start), at(start), None if end is None else at(end), None, reason, "", 0


def item(i, job_id, target="a", url="u", status="checked_complete", page=1, index=0, document=None, hours=0, title="t", version=1, header=True):
    return i, job_id, target, f"label {target}", url, title, date(2026, 1, 1), status, page, index, document, None, None, version, header, [], None if hours is None else at(hours), "clash", 1


def test_generations_by_the_latest_row_of_each_entry(spark):
    items = spark.createDataFrame([item(1, 1, url="u", status="pending"), item(2, 1, url="u", status="checked_complete", hours=1), item(3, 1, url="v", status="review_required", index=1), item(3, 1, url="v", status="review_required", index=1), item(4, 1, url=None), item(5, 1, target=None), item(6, 1, target="b", url="w", status="pending", hours=None)], ITEMS)
    got = {(r.job_id, r.target_key): r for r in J.generations(items).collect()}
    a, b = got[1, "a"], got[1, "b"]
    assert (a.discovered, a.completed, a.review, a.terminal, a.open, a.observed, a.n_rows, a.ok) == (2, 1, 1, 2, 0, 2, 4, True)
    assert (b.discovered, b.open, b.ok) == (1, 1, False) and len(got) == 2
    assert J.generations(items.limit(0)).count() == 0
    assert rows(J.job_totals(J.generations(items)).select("job_id", "n_generations", "discovered", "open")) == [(1, 2, 3, 1)]


def test_reconciliation_names_what_is_missing(spark):
    jobs = spark.createDataFrame([job(1), job(2, mode="incremental"), job(3)], JOBS)
    items = spark.createDataFrame([item(1, 1), item(2, 1, url="v", status="pending", index=1), item(3, 2), item(4, 2, url="v", status="skipped", index=0)], ITEMS)
    got = dict(rows(J.reconciled(jobs, items)))
    assert got[1] == "a: 1 of 2 entries are done; 1 entries are open" and got[2] == "covered 2 of 1" and got[3] == "no entry is known"
    assert {x for _, x in rows(J.reconciled(jobs, items.limit(0)))} == {"no entry is known", ""}


def test_status_and_commands(spark):
    jobs = spark.createDataFrame([job(1, start=0, end=2), job(2, start=3, end=9), job(3, sources=("b", "a"), start=-9, end=-8, status="failed"), job(4, sources=("c",), start=-9, end=-8, status="paused", reason="访问受限"), job(5, sources=None, start=-9, end=None, status="stopped")], JOBS)
    then = J.status_at(jobs, at(1))
    assert {r.id: r.status for r in then.collect()} == {1: "running", 3: "failed", 4: "paused", 5: "stopped"}
    got = {(r.id, r.command): (r.next_status, r.violation) for r in J.commanded(then).collect()}
    assert got[1, "pause"] == ("paused", None) and got[1, "resume"] == (None, "not allowed in this state")
    assert got[3, "resume"] == (None, "another job of these sources is active") and got[3, "stop"] == ("stopped", None)
    assert got[4, "resume"] == (None, "cooling down") and got[5, "stop"][1] == "not allowed in this state" and len(got) == 12
    assert {r.action for r in J.started(then, full=True).collect()} == {"refused"} and rows(J.started(then.limit(0), full=True)) == []
    assert dict((r.signature, r.action) for r in J.started(then, full=False).where("signature IS NOT NULL").collect()) == {"a|b": "existing", "c": "create"}
    assert {r.status for r in J.recovered(then).collect()} == {"paused", "failed", "stopped"}


def test_plans_and_schedules(spark):
    jobs = spark.createDataFrame([job(1, start=-400, end=-399), job(2, mode="incremental", status="failed", start=-2, end=-1), job(3, sources=("c",), status="partial", start=-3, end=-2)], JOBS)
    base = spark.createDataFrame([(1, "a|b")], "id bigint, signature string")
    plans = {r.signature: (r.job_id, r.action, r.next_mode, r.baseline_id) for r in J.automatic_plan(jobs, base).collect()}
    assert plans == {"a|b": (2, "resume", "incremental", 1), "c": (3, "resume", "full", None)}
    s = {r.signature: r for r in J.schedules(jobs).collect()}
    assert s["a|b"].next_incremental_at == at(-1) + timedelta(minutes=15) and s["a|b"].next_full_at == at(-399) + timedelta(days=7)
    assert s["c"].next_full_at == at(-2) + timedelta(minutes=15)
    assert rows(J.due(J.schedules(jobs), jobs, base, at(0))) == [("a|b", "full", 1), ("c", "full", None)]
    assert J.due(J.schedules(jobs), jobs, base, at(-500)).count() == 0
    assert J.schedules(jobs.limit(0)).count() == 0


def test_exceptions_are_pending_then_resolved_or_reviewed(spark):
    bad = "review_required"
    items = spark.createDataFrame([item(1, 1, url="a", status=bad), item(2, 1, url="b", status=bad), item(3, 1, url="b", hours=1), item(4, 1, url="c", status=bad, hours=None), item(5, 1, url="c", status=bad, hours=1), item(6, 1, url="d"), item(7, 1, url=None, status=bad)], ITEMS)
    got = {r.url: (r.status, r.retry_count, r.first_id, r.last_id) for r in J.exceptions(items).collect()}
    assert got == {"a": ("pending", 0, 1, 1), "b": ("resolved", 0, 2, 3), "c": ("review_required", 1, 4, 5)}
    assert [r.url for r in J.pending_exceptions(J.exceptions(items)).collect()] == ["a"]


def test_precedence(spark):
    jobs = spark.createDataFrame([job(1), (2, "incremental", "completed", "complete", ["a", "b"], NOON, NOON, NOON, 1, "", "", 0)], JOBS)
    items = spark.createDataFrame([item(1, 1, url="x", document=7), item(2, 2, url="x", status="pending", version=0, document=8), item(3, 2, url="y", status="checked_complete"), item(4, 2, target="b", url="y", status="pending", header=False), item(5, 2, url="z", status="pending"), item(6, 2, url=None)], ITEMS)
    links = spark.createDataFrame([], LINKS)
    got = {r.id: (r.path, r.next_status) for r in J.precedence(items, jobs, links).collect()}
    assert got == {1: ("done", "checked_complete"), 2: ("baseline", "reused_baseline_detail"), 3: ("done", "checked_complete"), 4: ("run", "reused_current_no_header"), 5: ("open", "to_open")}


def test_refresh_by_age(spark):
    docs = spark.createDataFrame([(1, "a", "t ", date(2026, 1, 1), at(0)), (2, "b", "t", None, at(-24 * 40)), (3, "c", "other", None, at(0)), (4, "d", "t", None, None)], "id bigint, url string, title string, published_date date, last_detail_checked_at timestamp")
    items = spark.createDataFrame([item(i, 1, url=u) for i, u in enumerate("abcdex", 1)], ITEMS).withColumn("listed_date", F.when(F.col("url") == "a", F.col("listed_date")))
    assert [r[1] for r in rows(J.fresh_enough(items, docs, at(1)).select("id", "reason"))] == ["fresh", "checked too long ago", "title changed", "never checked", "new", "new"]


def test_copied_links_once(spark):
    items = spark.createDataFrame([item(1, 2)], ITEMS).withColumns({"reused_document_id": F.lit(7).cast("bigint"), "baseline_job_id": F.lit(1).cast("bigint")})
    links = spark.createDataFrame([(1, 1, 7, "u", "body", "p", "x", True, "confirmed", "ok", 200), (2, 1, 7, "u", "body", "p", "x", True, "confirmed", "broken", None), (3, 1, 7, "v", "", "p", "x", True, "confirmed", "ok", 200), (4, 1, 7, "w", "body", "p", "x", False, "confirmed", "ok", 200), (5, 1, 8, "u", "body", "p", "x", True, "confirmed", "ok", 200)], LINKS)
    assert rows(J.copied_links(items.unionAll(items), links)) == [(2, 7, "u", "body", "p", "x", "broken", None)]


def test_dates_outside_any_fixed_calendar(spark):
    docs = spark.createDataFrame([(1, date(1990, 1, 1), date(1990, 1, 8)), (2, date(2012, 5, 4), date(2012, 5, 7)), (3, None, date(2099, 1, 1))], "id int, authored_date date, published_date date")
    got = W.with_gap(docs, "authored_date", "published_date", W.calendar_of(docs, "authored_date", "published_date"))
    assert [r[-1] for r in rows(got)] == [5, 1, None]
    assert W.calendar_of(docs.limit(0), "authored_date").count() == 1


def test_bucketed_table_leaves_other_buckets(spark, tmp_path):
    table = BucketedTable(spark, f"file://{tmp_path}/b", ["k"], buckets=4)
    assert table.read() is None
    table.upsert(spark.createDataFrame([(i, 1, "x") for i in range(20)], "k int, t int, v string"), ["k"], [F.col("t")])
    before = table._paths()
    update = spark.createDataFrame([(3, 2, "y"), (99, 2, "new")], "k int, t int, v string")
    for _ in range(2):
        table.upsert(update, ["k"], [F.col("t")])
    after = table._paths()
    assert table.read().count() == 21 and {(r.k, r.v) for r in table.read().where("v <> 'x'").collect()} == {(3, "y"), (99, "new")}
    assert 2 <= len({b for b in before if before[b] == after.get(b)}) < 4
    table.upsert(update.limit(0), ["k"], [F.col("t")])
    assert table._paths() == after


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    schema = "id int, t timestamp"
    source, folder = f"{tmp_path}/in", f"file://{tmp_path}/out"
    table = BucketedTable(spark, f"file://{tmp_path}/table", ["id"], buckets=2)
    for part in ([(1, NOON), (2, NOON)], [(2, at(1)), (3, NOON)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = S.read_stream(spark, source, spark.createDataFrame([], schema).schema)
        out = S.drained(stream, "all", folder=folder)
        S.upserted(stream, table, ["id"], "t", checkpoint=f"{folder}/upserts")
    assert rows(out.select("id")) == [(1,), (2,), (2,), (3,)]  # what was read before was not read again
    assert rows(table.read().select("id")) == [(1,), (2,), (3,)]


def test_capped_lists_and_revised_totals(spark):
    page = lambda n, ids, total: (n, "c", '{"data":{"list":[' + ",".join(f'{{"id":"{i}","title":"t","url":"u{i}","doc_flag":"1"}}' for i in ids) + f'],"pageNo":{n},"totalPage":2,"totalCount":{total}}}}}')
    pages = lambda extra: C.list_pages(spark.createDataFrame([page(1, (1, 2, 3), 6), page(2, (4, 5, 6), 6), *extra], "requested_page int, channel_id string, body string"))
    assert rows(C.capped_lists(pages([page(3, (7, 1), 6)]), 3, 6)) == [("c", 2, 6, True, 7, 7)]
    assert rows(C.capped_lists(pages([]), 3, 6)) == [("c", 2, 6, False, 6, 6)] and rows(C.capped_lists(pages([]), 3, 5))[0][3] is False
    now = spark.createDataFrame([("a", 5, 6), ("b", 7, 2), ("c", 7, 0), ("d", 3, 3)], "channel_id string, total bigint, examined bigint")
    assert [r[3] for r in rows(C.revised_totals(now, now.withColumn("total", F.when(F.col("channel_id") == "d", 3).otherwise(6).cast("bigint"))))] == ["total below what was examined", "total changed", None, None]


@pytest.mark.parametrize(("text", "shown"), [("方案<b>", "<mark>方案</mark>&lt;b&gt;"), ("实施方案 & x", "<mark>实施方案</mark> &amp; x"), (None, None), ("", "")])
def test_highlights(spark, text, shown):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.highlighted(F.col("t"), ["方案", "实施方案", "x"])).first()[0] == shown
    assert df.select(T.highlighted(F.col("t"), [])).count() == 1


def test_labels_of_pairs_are_cleaned(spark):
    pages = spark.createDataFrame([("", [("发布 日期：", "2026-01-02"), (None, "x"), ("公开主体", None)])], "body_text string, metadata_pairs array<struct<label:string,value:string>>")
    r = C.detail_inspection(pages).first()
    assert r.header_detected and r["values"]["发布日期"] == "2026-01-02" and "公开主体" in r.missing


def test_a_workbook_has_links_dates_marks_and_widths(spark, tmp_path):
    import xml.dom.minidom
    import zipfile

    from sifthall.operators import report

    df = spark.createDataFrame([(1, "https://a.example/x?a=1&b=2", date(2026, 1, 2), "x" * 60 + "\x01", True), (None, None, None, None, None)], "n int, url string, day date, text string, flag boolean")
    report.write_workbook({report.SHEETS[1]: df, "other": df.limit(0)}, f"{tmp_path}/r.xlsx")
    book = zipfile.ZipFile(f"{tmp_path}/r.xlsx")
    parts = {n: book.read(n).decode() for n in book.namelist()}
    for text in parts.values():
        xml.dom.minidom.parseString(text)
    sheet = parts["xl/worksheets/sheet1.xml"]
    assert 'HYPERLINK("https://a.example/x?a=1&amp;b=2")' in sheet and '<c r="C2" s="4"><v>46024</v></c>' in sheet and 'max="4" width="48"' in sheet and 'max="1" width="10"' in sheet
    assert 'ref="A1:E3"' in sheet and 'ref="A1:E1"' in parts["xl/worksheets/sheet2.xml"]


def test_limits_are_checked():
    from sifthall.settings import Limits

    assert Limits.from_env(env={"SIFTHALL_RETRIES": "0", "SIFTHALL_LEAST_DELAY": " 2.5 ", "SIFTHALL_FAILURES": ""}) == Limits(retries=0, least_delay=2.5)
    for bad in ({"least_delay": 11}, {"least_rest": 400}, {"retries": -1}, {"least_delay": 0.5}, {"rest_every": 0}):
        with pytest.raises(ValueError):
            Limits(**bad)


def test_hops_are_checked_on_the_way(spark):
    from sifthall.functions import web

    hops = [("https://a.example/", 302, "x"), ("ftp://b.example/", 302, "y"), ("https://c.example/", 200, None)]
    df = spark.createDataFrame([(hops,)], "hops array<struct<url:string,status:int,location:string>>")
    walk = lambda check: tuple(df.select(web.walk_redirects(F.col("hops"), check=check).alias("w")).select("w.chain", "w.end").first())
    assert walk(False) == ([h[0] for h in hops], "ok") and walk(True) == ([h[0] for h in hops[:2]], "blocked_target")


def test_records_of_entries(spark):
    docs = spark.createDataFrame([(1, "u", "", "agency", "n", date(2026, 1, 1), None, ""), (2, "v", "T", None, None, None, None, "d"), (3, "v", "T2", None, None, None, None, "d")], "id bigint, url string, title string, issuing_agency string, page_document_number string, published_date date, authored_date date, district string")
    items = spark.createDataFrame([item(1, 1, url="u"), item(2, 1, url="v", index=1), item(3, 1, url="w", index=2), item(4, 1, url=None)], ITEMS)
    got = [tuple(r) for r in J.opened(items, docs).orderBy("id").select("id", "title", "source", "outcome").collect()]
    assert got[0] == (1, "t", "label a", "checked_complete") and got[1][3] == "review_required" and got[2] == (3, "t", "label a", "exception") and len(got) == 3
    assert J.opened(items, docs, n=2).count() == 2 and J.opened(items.limit(0), docs).count() == 0


def test_concurrency_and_contracts(spark):
    jobs = spark.createDataFrame([job(1, start=0, end=4), job(2, start=1, end=2), job(3, sources=("c",), start=2, end=3), job(4, start=5, end=None)], JOBS)
    assert rows(J.concurrency(jobs)) == [(1, 1, 1), (2, 2, 2), (3, 2, 1)]
    items = spark.createDataFrame([item(1, 1), item(2, 1, version=0), item(3, 2, version=3)], ITEMS)
    got = {r.id: (r.version, r.may_be_baseline) for r in J.contracts(jobs, items, 2).collect()}
    assert got == {1: (0, False), 2: (3, True), 3: (None, False), 4: (None, False)}
