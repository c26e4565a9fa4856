import unicodedata
from collections import Counter, defaultdict
from datetime import datetime

from pyspark.sql import functions as F

from sifthall.llm import lookalikes as K
from sifthall.llm import site_lines as L

SCHEMA = "id bigint, source_site string, body_text string, first_seen_at timestamp, n bigint, source string"


def docs_of(spark, texts, site="s", start=0):
    rows = [(start + i, site if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], datetime(2026, 1, 1 + (start + i) % 28), 7, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def by_hand(rows, least=5, share=4):
    def key(line):
        line = unicodedata.normalize("NFKC", line)
        keep = lambda c: not c.isspace() and unicodedata.category(c) not in ("Cf", "Cc", "Nd") and not 0xFE00 <= ord(c) <= 0xFE0F
        return "".join(c for c in line if keep(c))

    n, count, at = Counter(), Counter(), defaultdict(list)
    for i, site, text in rows:
        n[site] += 1
        seen = set()
        for no, line in enumerate((text or "").split("\n"), 1):
            k = key(line)
            if any(unicodedata.category(c)[0] == "L" for c in k):
                seen.add(k)
                at[site, k].append((i, no))
        count.update((site, k) for k in seen)
    return {p for k, c in count.items() if c >= least and c * share >= n[k[0]] for p in at[k]}


TEXTS = ["分享到：微聊\n正文甲", "分享 到:微聊 \n分享到：微聊", "Ⅳ编号１２\n分享到​：微聊", "编号 3\r\n分享到：微聊", "分享到：微聊", None, "", "   \n123\n---", "é\né", "x" * 3_000_000 + "\n分享到：微聊"]


def test_against_brute_force(spark, data):
    docs = docs_of(spark, TEXTS + [(None, "分享到：微聊")] * 6)
    got = {tuple(r) for r in L.found(docs).collect()}
    assert got == by_hand([(r.id, r.source_site, r.body_text) for r in docs.collect()])
    real = spark.read.parquet(f"{data}/policy_documents.parquet")
    assert {tuple(r) for r in L.found(real).collect()} == by_hand([(r.id, r.source_site, r.body_text) for r in real.select("id", "source_site", "body_text").collect()])


def test_increments_equal_one_pass_and_report_crossings(spark):
    first, second = docs_of(spark, ["甲\n乙"] * 4), docs_of(spark, ["甲\n丙"] + ["丁"] * 30, start=100)
    one = L.merge(None, first)
    assert one.repeated.count() == 0
    two = L.merge(one, first.limit(0).unionByName(docs_of(spark, ["甲"] * 2, start=50)))
    assert {r.document_id for r in L.documents_to_rebuild(two).collect()} == {0, 1, 2, 3, 50, 51}
    three = L.merge(two, second)  # the share of the first line falls below a quarter
    assert L.documents_to_rebuild(three).where("document_id < 100").count() == 6
    whole = L.merge(None, first.unionByName(docs_of(spark, ["甲"] * 2, start=50)).unionByName(second))
    assert {tuple(r) for r in L.repeated_places(three).collect()} == {tuple(r) for r in L.repeated_places(whole).collect()}


def test_lines_are_taken_out(spark):
    docs = docs_of(spark, ["页眉\n正文%d\n页眉" % i + "一二三四五六"[i] for i in range(6)] + ["别的", None, ""])
    clean = {r.id: r.body_text for r in L.without_lines(docs, L.found(docs)).collect()}
    assert clean[0] == "正文0\n页眉一" or clean[0] == "页眉一"
    assert (clean[6], clean[7], clean[8]) == ("别的", None, "")


def test_empty_tables(spark):
    none = docs_of(spark, ["x"]).limit(0)
    assert L.found(none).count() == 0
    assert K.found(none, ["body_text"]).count() == 0 and K.consistent(none, ["body_text"]).count() == 0


ALIKE = [
    ("Café 路", "Café 路"), ("ＡＢ－１", "AB-1"), ("a b", "a b"), ("通知​书", "通知书"), ("А-26号", "A-26号"), ("〔2O23〕1号", "〔2023〕1号"), ("二○二四年", "二〇二四年"),
    ("工⼯", "工工"), ("⻓期", "长期"), ("甲・乙", "甲·乙"), ("2020—2021", "2020–2021"), ("﹝2020﹞", "〔2020〕"), ("Νovéa", "Novéa"), ("a︎b", "ab"),
]
DIFFERENT = [("Cafe", "Café"), ("a  b", "a b"), ("[2020]", "〔2020〕"), ("abc", "ABC"), ("1号", "2号"), ("市场", "市埸"), ("（甲）", "【甲】"), ("甲", "甲 ")]


def test_lookalike_pairs(spark):
    rows = [(2 * i + j, v) for i, pair in enumerate(ALIKE + DIFFERENT) for j, v in enumerate((f"{i}#{pair[0]}", f"{i}#{pair[1]}"))]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "重"), (903, "重")], "id bigint, title string").withColumn("value", F.lit(1)).withColumn("canonical", F.lit("x"))
    got = {(r.id_a, r.id_b) for r in K.found(docs, ["title"]).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(len(ALIKE))}
    same = {(r.id, r.canonical) for r in K.consistent(docs, ["title"]).collect()}
    assert len({c for i, c in same if i in (0, 1)}) == 1 and len(same) == len(rows) + 2


def test_canonical_is_the_most_frequent(spark):
    docs = spark.createDataFrame([(1, "ＡＢ"), (2, "AB"), (3, "AB"), (3, "AB")], "id bigint, title string")
    assert {r.canonical for r in K.consistent(docs, ["title"]).collect()} == {"AB"}
    assert {tuple(r) for r in K.found(docs, ["title"]).collect()} == {("title", 1, 2), ("title", 1, 3)}


def test_very_long_value(spark):
    docs = spark.createDataFrame([(1, "Ａ" * 500_000), (2, "A" * 500_000)], "id bigint, title string")
    assert K.found(docs, ["title"]).count() == 1


def test_a_state_is_opened_again(spark, tmp_path):
    """Saved after each delta and loaded by its folder: as one pass, and cleaned texts by both ways."""
    folder = f"file://{tmp_path}/lines"
    docs = docs_of(spark, ["页眉\n甲%d\n页脚" % i for i in range(8)] + ["别的\n页脚", None, ""])
    assert L.load(spark, folder) is None
    for part in (docs.where("id < 5"), docs.where("id >= 5")):
        L.save(L.merge(L.load(spark, folder), part, folder=folder), folder)
    state = L.load(spark, folder)
    assert {tuple(r) for r in L.repeated_places(state).collect()} == by_hand([(r.id, r.source_site, r.body_text) for r in docs.collect()])
    clean = {r.id: r.body_text for r in L.cleaned(docs, state).collect()}
    assert clean == {r.id: r.body_text for r in L.without_lines(docs, state.dropped).collect()} and clean[0] == "" and clean[8] == "别的" and clean[9] is None
