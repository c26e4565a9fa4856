import re
from datetime import date, timedelta
from itertools import dropwhile, takewhile

from pyspark.sql import functions as F

from sifthall.functions import text as T
from sifthall.functions import workdays as W


def values(spark, rows, schema, **columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[c.alias(k) for k, c in columns.items()]).collect()]


def test_document_number_forms(spark):
    rows = [("沪府【2026】 05 号",), ("沪府 [ 2026 ] 5号",), ("沪府（２０２６）５号",), ("没有文号",), ("",), (None,)]
    got = [r[0] for r in values(spark, rows, "x string", n=T.document_number(F.col("x")))]
    assert got == ["沪府〔2026〕5号"] * 3 + ["没有文号", "", None]


def test_document_numbers_in_order_once_without_connective(spark):
    rows = [("沪府〔2026〕5号，另见沪府〔2026〕5号及沪府办〔2026〕2号。",), (None,), ("",)]
    got = [r[0] for r in values(spark, rows, "x string", n=T.document_numbers(F.col("x")))]
    assert got == [["沪府〔2026〕5号", "沪府办〔2026〕2号"], [], []]


def test_document_numbers_as_read_from_the_left(spark):
    import random

    r = random.Random(3)
    parts = ["沪府", "〔2026〕", "5号", "(1999)", " 12 号", "第5号", "办", "令", "规", "字", "见", "，", "号", "甲乙丙丁戊己庚辛壬癸子丑寅卯", "\n", "x", "〔2026〕5号", "【20２6】", "３号"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(600)]
    digits = str.maketrans("０１２３４５６７８９", "0123456789")
    want = [list(dict.fromkeys(re.sub(T.CONNECTIVE, "", p) + f"〔{y}〕{int(i)}号" for p, y, i in re.findall(T.DOCUMENT_NUMBER, t.translate(digits)))) for t in texts]
    got = [x[0] for x in values(spark, [(t,) for t in texts], "x string", n=T.document_numbers(F.col("x")))]
    assert got == want and sum(map(len, want)) > 100


def test_dates(spark):
    rows = [("2026-07-03 09:49:12",), ("2026-7-3",), ("发布于2026年7月3日",), ("2026-13-40",), (None,)]
    got = values(spark, rows, "x string", a=T.iso_date(F.col("x")), b=T.any_date(F.col("x")))
    d = date(2026, 7, 3)
    assert got == [(d, d), (None, None), (None, d), (None, None), (None, None)]


def block_above(lines):
    """The last block without blank lines."""
    upwards = dropwhile(lambda x: not x, reversed(lines))
    return " ".join(takewhile(bool, upwards))


def signed_by_hand(text, agency, as_of):
    lines = [x.strip() for x in (text or "").splitlines()]
    words = T.SIGNING_BODIES + ((agency,) if agency else ())
    dated = {i: m for i, x in enumerate(lines) if (m := re.fullmatch(T.FULL_DATE, x))}
    valid = {i: d for i, m in dated.items() if (d := real(*m.groups())) and date(1990, 1, 1) <= d <= as_of + timedelta(366)}
    free = [i for i in valid if not re.search("|".join(T.NOT_A_SIGNATURE), " ".join(lines[max(i - 2, 0) : i + 1]))]
    signed = [i for i in free if any(w in block_above(lines[max(i - 6, 0) : i]) for w in words)]
    return valid[min(signed)] if signed else None


def real(year, month, day):
    try:
        return date(int(year), int(month), int(day))
    except ValueError:
        return None


def test_signature_date_against_brute_force(spark, data):
    as_of = date(2026, 12, 31)
    own = [
        ("正文。\n某区人民政府\n某区发展和改革委员会\n2025年3月18日\n有效期至2026年1月1日", ""),
        ("本意见自2025年4月21日起施行，\n2025年4月21日", "某区政府"),
        ("甲乙丙\n\n\n2025-3-1", ""), ("甲乙丙\n2025-3-1", "甲乙丙"), (None, None), ("", ""), ("2025年3月1日", ""), ("局\n2025年2月30日", ""),
    ]
    docs = spark.read.parquet(f"{data}/policy_documents.parquet").select("body_text", "issuing_agency").unionByName(spark.createDataFrame(own, "body_text string, issuing_agency string"))
    got = docs.select("body_text", "issuing_agency", T.signature_date(F.col("body_text"), F.col("issuing_agency"), as_of).alias("d")).collect()
    assert [r.d for r in got] == [signed_by_hand(r.body_text, r.issuing_agency, as_of) for r in got]
    assert sum(r.d is not None for r in got) > 2


def test_labelled_and_header_values(spark):
    rows = [("索引号：A1\n发布日期： 2026-01-02 \n公开主体：\n主题分类：财政",), ("没有表头",)]
    got = values(spark, rows, "x string", a=T.header_value(F.col("x"), "发布日期"), b=T.header_value(F.col("x"), "公开主体"), c=T.labelled_value(F.col("x"), "索引号"), d=T.has_header(F.col("x")))
    assert got == [("2026-01-02", "", "A1", True), ("", "", "", False)]


def test_evidence_terms_longest_first(spark):
    got = values(spark, [([" 财政 ", "财政", "财", "财政资金"],)], "x array<string>", t=T.evidence_terms(F.col("x")))
    assert got == [(["财政资金", "财政"],)]


def test_identity_and_missing(spark):
    rows = [("7", "u"), (" ", "u"), (None, None)]
    assert [r[0] for r in values(spark, rows, "i string, u string", k=T.stable_identity(F.lit("t"), F.col("i"), F.col("u")))] == ["t|id:7", "t|url:u", None]
    got = values(spark, [("a", None)], "x string, y string", m=T.missing_labels({"甲": F.col("x"), "乙": F.col("y")}), u=T.union_in_order(F.array(F.lit("a")), F.array(F.lit("b"), F.lit("a"))))
    assert got == [(["乙"], ["a", "b"])]


def test_workday_gap(spark):
    days = W.calendar(spark, date(2026, 1, 1), date(2026, 12, 31))
    rows = [(date(2026, 3, 2), date(2026, 3, 30)), (date(2026, 3, 2), date(2026, 3, 31)), (date(2026, 3, 9), date(2026, 3, 8)), (None, date(2026, 3, 8))]
    df = W.with_gap(spark.createDataFrame(rows, "a date, p date"), "a", "p", days)
    got = [tuple(r) for r in df.select("workday_gap", W.timeliness(F.col("workday_gap"), F.col("a"), F.col("p"))).collect()]
    assert sorted(got, key=str) == sorted([(20, "合规"), (21, "超期"), (0, "日期倒置"), (None, "待复核")], key=str)


def test_workday_overrides_and_range(spark):
    own = spark.createDataFrame([(date(2026, 3, 7), True), (date(2026, 3, 9), False)], "day date, is_workday boolean")
    days = W.calendar(spark, date(2026, 1, 1), date(2026, 12, 31), own)
    one = spark.createDataFrame([(date(2026, 3, 6), date(2026, 3, 9))], "a date, p date")
    assert W.with_gap(one, "a", "p", days).first()["workday_gap"] == 1
    late = spark.createDataFrame([(date(2026, 3, 6), date(2027, 3, 9))], "a date, p date")
    try:
        W.with_gap(late, "a", "p", days).collect()
    except Exception as e:
        assert "outside the calendar" in str(e)
    else:
        raise AssertionError("a date outside the calendar must fail")


def test_stated_gap(spark):
    assert values(spark, [("相隔 22 个工作日",), ("无",)], "x string", g=W.stated_gap(F.col("x"))) == [(22,), (None,)]


def test_comparable_decoded_and_totals(spark):
    rows = [("Ａ　b", "x", {"a": 1, "b": None}), (None, "y", {}), ("", None, None)]
    got = values(spark, rows, "t string, c string, m map<string,int>", t=T.comparable(F.col("t")), c=T.decoded(F.col("c"), {"x": "甲"}), m=T.map_total(F.col("m")))
    assert got == [("Ab", "甲", 1), (None, "y", 0), ("", None, 0)]
