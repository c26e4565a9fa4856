from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sifthall.operators import accesslog as A
from sifthall.operators import relational as R
from sifthall.operators import report, review, rules, snapshots
from sifthall.plans.merge import VersionedTable, insert_absent, keyed_upsert, patched, positions_marked, replaced
from sifthall.streaming import jobs as S


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upsert_is_idempotent_and_keeps_what_it_must(spark):
    schema = "k string, first int, doc int, v string, at int"
    old = spark.createDataFrame([("a", 1, 7, "x", 1), ("b", 1, None, "y", 1)], schema)
    new = spark.createDataFrame([("a", 2, None, "z", 2), ("c", 2, 5, "n", 2), ("c", 2, 6, "m", 1)], schema)
    up = lambda a, b: keyed_upsert(a, b, ["k"], [F.col("at")], keep=["first"], fill=["doc"])
    once = up(old, new)
    assert rows(once) == rows(spark.createDataFrame([("a", 1, 7, "z", 2), ("b", 1, None, "y", 1), ("c", 2, 5, "n", 2)], schema))
    assert rows(up(once, new)) == rows(once)
    assert rows(up(old.limit(0), old)) == rows(old)
    assert rows(up(old, old.limit(0))) == rows(old)


def test_other_merges(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    n = spark.createDataFrame([(1, "z"), (3, "y")], "k int, v string")
    assert rows(replaced(t, n, ["k"])) == [(1, "z"), (2, "c"), (3, "y")]
    assert rows(insert_absent(t, n, ["k"])) == [(1, "a"), (1, "b"), (2, "c"), (3, "y")]
    assert rows(patched(t, F.col("k") == 2, {"v": F.lit("p"), "unknown": F.lit(1)})) == [(1, "a"), (1, "b"), (2, "p")]
    items = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 1)], "id int, page int, item_index int")
    assert rows(positions_marked(items, ["page", "item_index"])) == [(1, 1, -1), (2, 1, 0), (3, 1, 1)]


def test_versioned_table(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    assert table.read() is None
    df = spark.createDataFrame([("a", 1, "x")], "k string, at int, v string")
    table.upsert(df, ["k"], [F.col("at")])
    table.upsert(spark.createDataFrame([("a", 2, "y"), ("b", 1, "z")], "k string, at int, v string"), ["k"], [F.col("at")])
    assert rows(table.read()) == [("a", 2, "y"), ("b", 1, "z")]


JOBS = "id bigint, mode string, status string, source_signature array<string>, started_at timestamp, extra string"
T0 = datetime(2026, 1, 1)


def snapshot_inputs(spark):
    jobs = spark.createDataFrame([(1, "full", "completed", ["s"], T0, "x"), (2, "full", "failed", ["s"], T0 + timedelta(1), "x"), (3, "full", "completed", ["s"], T0 + timedelta(2), "x"), (4, "full", "completed", ["t"], T0, "x"), (5, "full", "completed", ["s"], T0 + timedelta(3), None)], JOBS)
    items = spark.createDataFrame(
        [(1, 1, "s", "a", " t ", None, T0), (2, 1, "s", "b", "u", None, T0), (3, 1, "s", "b", "v", None, None), (4, 3, "s", "a", "t", None, T0), (5, 3, "s", "c", None, None, T0), (6, 3, "s", "c", "late", None, T0 + timedelta(1)), (7, 3, "s", None, "n", None, T0), (8, 4, "s", "z", "q", None, T0), (9, 2, "s", "y", "q", None, T0)],
        "id bigint, job_id bigint, target_key string, url string, title string, listed_date date, checked_at timestamp",
    )
    docs = spark.createDataFrame([(1, 1, 10, T0, '{"a": 1, "b": "\\u4e2d"}'), (2, 3, 10, T0, '{"b":"中","a":1.0}'), (3, 1, 11, T0, '{"a": 1}'), (4, 3, 11, T0, '{"a": 2}'), (5, 3, 12, T0, "no json"), (6, 1, 13, T0, None), (7, 3, 13, T0, None)], "id bigint, job_id bigint, document_id bigint, captured_at timestamp, raw_json string")
    return items, docs, jobs


def test_snapshot_changes(spark):
    items, docs, jobs = snapshot_inputs(spark)
    got = rows(snapshots.found(items, docs, jobs))
    want = [
        ("document_snapshots", 3, "", "11", "changed"), ("document_snapshots", 3, "", "12", "added"), ("scan_item_results", 3, "s", "b", "removed"), ("scan_item_results", 3, "s", "c", "added"),
        ("document_snapshots", 5, "", "10", "removed"), ("document_snapshots", 5, "", "11", "removed"), ("document_snapshots", 5, "", "12", "removed"), ("document_snapshots", 5, "", "13", "removed"), ("scan_item_results", 5, "s", "a", "removed"), ("scan_item_results", 5, "s", "c", "removed"),
    ]
    assert got == sorted(want, key=str)


def test_snapshot_changes_of_nothing(spark):
    items, docs, jobs = snapshot_inputs(spark)
    assert snapshots.found(items.limit(0), docs.limit(0), jobs).count() == 0
    assert snapshots.found(items, docs, jobs.limit(0)).count() == 0
    clash = items.withColumn("value", F.lit(1)).withColumn("latest", F.lit(2)).withColumn("previous_job_id", F.lit(3))
    assert snapshots.list_changes(clash, jobs).count() == snapshots.list_changes(items, jobs).count()


def test_canonical_json(spark):
    texts = ['{"b": 1.50, "a": "1.0 x"}', '{"a":"1.0 x","b":1.5}', '{ "a" : "1.0 x", "b": 15e-1 }', "[1,", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(snapshots.canonical_json(F.col("t"))).collect()]
    assert got[0] == got[1] == got[2] and got[3] == "[1," and got[4] is None


def test_best_mark_count_latest(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", None), (4, None, 2)], "id int, k string, at int")
    assert rows(R.best_per_key(df, ["k"], [F.col("at"), F.col("id")]).select("id")) == [(2,), (3,), (4,)]
    keys = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert rows(R.mark(df, keys, "k", "there").select("id", "there")) == [(1, True), (2, True), (3, False), (4, False)]
    assert rows(R.with_count(df, keys, "k", "k", "n").select("id", "n")) == [(1, 2), (2, 2), (3, 0), (4, 0)]
    timed = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, None)], "k string, id int, at int")
    assert rows(R.with_latest(keys.distinct(), timed, "k", "k", "id", "at", "last")) == [("a", 2), (None, None)]


def test_access_log(spark):
    log = spark.createDataFrame([(1, i, T0 + timedelta(seconds=i), None if f else 200, f) for i, f in enumerate([True, True, False, True, True, True, True])], "run_id bigint, event_id bigint, ts timestamp, status int, failed boolean")
    assert rows(A.failure_runs(log, 3)) == [(5, 1, 3), (6, 1, 4)]
    assert rows(A.elapsed(log)) == [(1, 7, 6_000_000)]
    assert rows(A.short_gaps(log, 1.5).select("wait_us").distinct()) == [(500_000,)]
    assert rows(A.rest_points(log, 1)) == [(2, 1, 1)]
    assert [tuple(r[0]) if r[0] else None for r in spark.range(1, 4).select(A.backoff(F.col("id"))).collect()] == [(30, 60), (120, 300), None]


def test_streams(spark, tmp_path):
    log = spark.createDataFrame([(1, i, T0 + timedelta(seconds=i), f) for i, f in enumerate([True, True, False, True, True, True])], "run_id bigint, event_id bigint, ts timestamp, failed boolean")
    log.write.parquet(f"{tmp_path}/log")
    stream = S.read_stream(spark, f"{tmp_path}/log", log.schema)
    assert rows(S.drained(S.failure_alarms(stream, 3), "a")) == [(1, 5, 3)]
    assert S.drained(S.first_seen(stream.select("run_id"), ["run_id"]), "f").count() == 1
    assert S.drained(S.first_seen(stream, ["run_id"], "ts", "1 hour"), "g").count() == 1
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    S.upserted(stream, table, ["run_id"], "ts")
    assert rows(table.read().select("run_id", "event_id")) == [(1, 5)]


DOC = "id bigint, district string, title string, issuing_agency string, page_document_number string, body_text string"


def test_agency_rules(spark):
    agencies = spark.createDataFrame([(1, "甲区", "甲区人民政府", ["甲区政府"], ["甲府"]), (2, "甲区", "甲区教育局", None, ["甲教"])], "id bigint, district string, agency_name string, aliases array<string>, document_prefixes array<string>")
    docs = spark.createDataFrame([(1, "甲区", "关于丙市发展和改革委员会的通知", "甲区人民政府", "沪发〔2026〕1号", "甲区教育局"), (2, "甲区", "甲区政府通知", "甲区人民政府、甲区教育局", "甲府〔2026〕2号", ""), (3, "甲区", None, None, None, None), (4, "乙区", "x", "甲区人民政府", "甲府〔2026〕2号", "")], DOC)
    assert rows(R.first_agency(docs, agencies)) == [(1, 1), (2, 1)]
    assert rows(rules.agency_findings(docs, agencies, city="[一-鿿]{1,3}市").select("document_id", "rule_code")) == [(1, "AGENCY-001"), (1, "AGENCY-002")]
    # by itself the rule looks for bodies of the one fixed city
    assert rows(rules.agency_findings(docs, agencies).select("document_id", "rule_code")) == [(1, "AGENCY-001")]
    fixed = docs.withColumn("title", F.regexp_replace("title", "丙市", rules.CITY))
    assert rows(rules.agency_findings(fixed, agencies).select("document_id", "rule_code")) == [(1, "AGENCY-001"), (1, "AGENCY-002")]


def test_number_and_date_rules(spark):
    from datetime import date

    df = spark.createDataFrame([(1, "甲府〔2025〕8号", ["甲府〔2024〕8号"], date(2024, 1, 2), None, None), (2, "甲府〔2024〕8号", ["a", "b"], date(2024, 1, 2), date(2024, 1, 1), 0), (3, "", [], date(2024, 1, 1), date(2024, 2, 1), 21), (4, None, [], None, None, None)], "id bigint, number string, numbers array<string>, authored_date date, published_date date, workday_gap bigint")
    assert rows(rules.unfolded(df, rules.number_and_date_findings()).select("document_id", "rule_code")) == [(1, "DOC-001"), (1, "DOC-002"), (2, "DATE-002"), (2, "DOC-003"), (3, "DATE-001")]


def test_review(spark):
    f = spark.createDataFrame([(i, 1, 1, "R", "c", s) for i, s in enumerate(["pending", "pending", "confirmed"])], "id bigint, job_id bigint, document_id bigint, rule_code string, category string, review_status string")
    d = spark.createDataFrame([(1, "t", "u", "d", "s", "a", "n", None, None)], "id bigint, title string, url string, district string, source_site string, issuing_agency string, page_document_number string, published_date date, authored_date date")
    assert [r.id for r in review.queue(f, d, status="pending", page=2, size=1).collect()] == [0]
    with pytest.raises(ValueError):
        review.queue(f, d, status="odd")
    with pytest.raises(ValueError):
        review.queue(f, d, size=51)
    none = spark.createDataFrame([], "finding_id bigint, decision string, note string, decided_at int")
    new = spark.createDataFrame([(0, "dismissed", "no", 1)], none.schema)
    after, decisions = review.decided(f, none, new)
    assert rows(after.select("id", "review_status")) == [(0, "dismissed"), (1, "pending"), (2, "confirmed")]
    assert review.queue(after, d, decisions, status="dismissed").first().note == "no"
    with pytest.raises(ValueError):
        review.decided(f, none, new.withColumn("decision", F.lit("maybe")))


def test_report_sheets(spark, data, tmp_path):
    from datetime import date

    from sifthall.functions.workdays import calendar

    read = lambda t: spark.read.parquet(f"{data}/{t}.parquet")
    findings = read("rule_findings")
    job = findings.groupBy("job_id").count().orderBy(F.desc("count")).first()[0]
    sheets = report.report(job, read("scan_jobs"), read("scan_item_results"), findings, read("link_checks"), read("policy_documents"), calendar(spark, date(2015, 1, 1), date(2030, 12, 31)))
    assert tuple(sheets) == report.SHEETS
    report.write_sheets(sheets, f"{tmp_path}/s")
    report.write_sheets(sheets, f"{tmp_path}/c", "csv")
    report.write_workbook({k: sheets[k].limit(20) for k in report.SHEETS[:2]}, f"{tmp_path}/r.xlsx")
    import zipfile

    assert "xl/worksheets/sheet2.xml" in zipfile.ZipFile(f"{tmp_path}/r.xlsx").namelist()
    assert spark.read.parquet(f"{tmp_path}/s/{report.SHEETS[0]}").count() == sheets[report.SHEETS[0]].count()
    widths = dict(rows(report.column_widths(sheets[report.SHEETS[0]])))
    assert all(10 <= w <= 48 for w in widths.values())


def test_pages(spark):
    items = spark.createDataFrame([(1, "t", 1, i, f"u{i}") for i in range(3)] + [(1, "t", 2, 0, "u9"), (1, "t", 2, 0, "u9")], "job_id bigint, target_key string, page_number int, item_index int, url string")
    got = {r.page_number: r.problems for r in R.page_checks(items, 3).collect()}
    assert got == {1: "", 2: "entries repeat; places repeat"}
    assert rows(spark.createDataFrame([(31,)], "n int").select(R.expected_pages(F.col("n"), 15), R.expected_rows(F.col("n"), F.lit(3), 15), R.expected_rows(F.col("n"), F.lit(4), 15))) == [(3, 1, 0)]


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_access_log_is_the_same_in_any_chunks(spark, chunk):
    import random

    r = random.Random(chunk)
    log = [(run, i, T0 + timedelta(seconds=r.randrange(40)), r.random() < 0.7) for i, run in enumerate([1] * 60 + [2] * 5)]
    df = spark.createDataFrame(log, "run_id bigint, event_id bigint, ts timestamp, failed boolean")
    fails, rests, gaps = set(), set(), set()
    for run in (1, 2):
        length = n = 0
        before = None
        for _, e, ts, failed in sorted((x for x in log if x[0] == run), key=lambda x: (x[2], x[1])):
            length, n = (length + 1, n) if failed else (0, n + 1)
            if length >= 2:
                fails.add((e, run, length))
            if not failed and n % 3 == 0:
                rests.add((e, run, n))
            if before and (ts - before).total_seconds() < 2:
                gaps.add((e, run, 2_000_000 - int((ts - before).total_seconds() * 1e6)))
            before = ts
    assert set(rows(A.failure_runs(df, 2, chunk))) == fails
    assert set(rows(A.rest_points(df, 3, chunk))) == rests
    assert set(rows(A.short_gaps(df, 2, chunk))) == gaps
