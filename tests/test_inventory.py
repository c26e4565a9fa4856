from pyspark.sql import functions as F

from sifthall.operators import inventory as I


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_state_keeps_history_and_marks_absence(spark):
    items = spark.createDataFrame([("t", "a", 1), ("t", "b", 1), ("t", "b", 2), ("t", "c", 2), ("u", "z", 1), ("t", None, 2)], "target_key string, url string, job_id bigint")
    full = spark.createDataFrame([(1,), (2,)], "id bigint")
    assert rows(I.state(items.where("target_key = 't'"), full)) == [("t", "a", 1, 1, False), ("t", "b", 1, 2, True), ("t", "c", 2, 2, True)]
    assert rows(I.state(items.where("target_key = 'u'"), full.limit(0))) == [("u", "z", 1, 1, True)]
    assert I.state(items.limit(0), full).count() == 0


def test_discovery_opens_what_changed(spark):
    schema = "stable_id string, fingerprint string, status string, attempt int"
    known = spark.createDataFrame([("a", "1", "completed", 1), ("b", "1", "reused", 1), ("c", "1", "review", 2), ("d", "1", "pending", 0), ("e", "1", "completed", 1)], schema)
    found = spark.createDataFrame([("a", "2"), ("b", "1"), ("c", "2"), ("f", "9"), ("f", "9")], "stable_id string, fingerprint string")
    once = I.discovered(known, found)
    assert rows(once) == [("a", "2", "pending", 1), ("b", "1", "reused", 1), ("c", "2", "review", 2), ("d", "1", "pending", 0), ("e", "1", "completed", 1), ("f", "9", "pending", 0)]
    assert rows(I.discovered(once, found)) == rows(once)


def test_claims_in_order(spark):
    q = spark.createDataFrame([("a", "pending", 0, 2, 0), ("b", "retry", 1, 1, 1), ("c", "completed", 1, 1, 0), ("d", "pending", 0, 3, 0)], "stable_id string, status string, attempt int, page_number int, item_index int")
    assert rows(I.claimed(q, 2).select("stable_id", "status", "attempt")) == [("a", "checking", 1), ("b", "checking", 2), ("c", "completed", 1), ("d", "pending", 0)]


def test_catch_up_stops_after_two_empty_rounds(spark):
    d = lambda *x: spark.createDataFrame([(i,) for i in x], "stable_id string")
    known = d("a")
    assert rows(I.caught_up([d("a", "b"), d("a"), d("a", "c")], known)) == [("b", 1), ("c", 3)]
    assert rows(I.caught_up([d("a", "b"), d("a"), d("b"), d("z")], known)) == [("b", 1)]
    assert I.caught_up([], known).count() == 0


def test_names_by_priority(spark):
    ref = spark.createDataFrame([(1, "甲", ["乙", ""]), (2, "乙", ["丙"]), (3, "丁", ["丙", None])], "id bigint, name string, also array<string>")
    names = I.synonyms(ref, "id", [F.array("name"), F.col("also")])
    assert rows(names) == [("丁", 3), ("丙", 2), ("乙", 2), ("甲", 1)]
    df = spark.createDataFrame([("乙",), ("x",), (None,)], "v string")
    assert rows(I.resolved(df, "v", names, "id")) == [("x", None), ("乙", 2), (None, None)]


def test_positions_and_enrichment(spark):
    a = spark.createDataFrame([(1, "甲 乙"), (2, "丙"), (3, "丁")], "p int, t string")
    b = spark.createDataFrame([(1, "甲乙"), (2, "戊"), (4, "己")], "p int, t string")
    assert rows(I.by_position(a, b, ["p"], "t")) == [(2, "丙", "戊"), (3, "丁", None), (4, None, "己")]
    links = spark.createDataFrame([(1, "", "x"), (2, "own", None)], "k int, area string, text string")
    rel = spark.createDataFrame([(1, "body", "y"), (2, "side", "z")], "k int, area string, text string")
    assert rows(I.enriched(links, rel, "k", ["area", "text"], False)) == [(1, "body", "x"), (2, "own", "z")]
    assert rows(I.enriched(links, rel, "k", ["area", "text"], True)) == [(1, "body", "y"), (2, "side", "z")]


def test_staged_tables_and_broadcast_checks(spark):
    from sifthall.plans.stage import broadcast_if_small, clear, stage

    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    kept = stage(df, "t")
    assert rows(kept) == rows(df) and kept.schema == df.schema
    hinted = lambda n: "broadcast" in broadcast_if_small(df, n)._jdf.queryExecution().logical().toString().lower()
    assert hinted(2) and not hinted(1)
    clear(spark)
    assert rows(stage(df, "t")) == rows(df)
