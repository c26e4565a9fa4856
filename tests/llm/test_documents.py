import random
import re
import unicodedata
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sifthall.llm import encode as E
from sifthall.llm import leaks as L
from sifthall.llm import near_copies as M
from sifthall.llm import quality as Q

WORDS = "本期 安排 资金 用于 减免 特种 设备 检验 周期 带动 周边 产业 升级 停车 场地 经营 压缩 夜间 经济 集聚 改善 沿线 居住 环境 登记 台账 受理 窗口 反馈".split()


def prose(seed, n=120):
    r = random.Random(seed)
    return "".join(r.choice(WORDS) + (r.choice("，。") if r.random() < 0.2 else "") + (str(r.randrange(9999)) if r.random() < 0.15 else "") for _ in range(n))


def share(a, b, run=5):
    a, b = ("".join(x.split()) for x in (a, b))
    x, y = ({t[i : i + run] for i in range(len(t) - run + 1)} for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


def edited(text, seed, n):
    r = random.Random(seed)
    out = list(text)
    for _ in range(n):
        i = r.randrange(len(out))
        out[i : i + 1] = r.choice([[], ["改"], [out[i], "增"]])
    return "".join(out)


def test_near_copies_against_brute_force(spark):
    base = [prose(i, 90) for i in range(40)]
    texts = base + [edited(t, i, n) for i, t in enumerate(base) for n in (3, 12, 30, 60)] + base[:5] + [base[0] + " \n"]
    rows = [(i, "题" if i % 2 else None, t, 1, "x") for i, t in enumerate(texts)] + [(900, "t", None, 1, "x"), (901, None, "短", 1, "x"), (902, "t", "", 1, "x"), (903, None, prose(99, 200_000), 1, "x")]
    docs = spark.createDataFrame(rows, "id bigint, title string, body_text string, value int, sketch string")
    kept = [(i, (a or "") + b) for i, a, b, *_ in rows if b and len(b) >= 200]
    want = {(i, j) for (i, a), (j, b) in combinations([x for x in kept if x[0] < 900], 2) if share(a, b) >= 0.5}
    got = {(r.id_a, r.id_b) for r in M.found(docs).collect()}
    assert not got - want
    assert len(got) >= 0.98 * len(want) > 50


def test_near_copies_of_what_all_share(spark):
    """Texts of little but shared lines, more than any list may hold: found by the longer way, none dropped."""
    common = prose(1, 100)
    docs = spark.createDataFrame([(i, None, common + str(i)) for i in range(60)], "id bigint, title string, body_text string")
    assert M.found(docs).count() == 60 * 59 // 2


def test_a_group_of_more_near_copies_than_a_list_holds(spark):
    """Each also shares a rare passage with a text of its own, so that it has other values to be found by."""
    base = prose(11, 160)
    copies = [(i, None, edited(base, i, 4) + prose(500 + i, 12)) for i in range(45)]
    others = [(100 + i, None, prose(700 + i, 80) + prose(500 + i, 12)) for i in range(45)]
    got = {(r.id_a, r.id_b) for r in M.found(spark.createDataFrame(copies + others, "id bigint, title string, body_text string")).collect()}
    want = {(i, j) for (i, _, a), (j, _, b) in combinations(copies + others, 2) if share(a, b) >= 0.5}
    assert not got - want and len(want) >= 900 and len(got) >= 0.98 * len(want)


def runs_of(text, run=5):
    text = "".join(text.split())
    return {text[i : i + run] for i in range(len(text) - run + 1)}


def test_a_group_of_hundreds_with_shares_near_the_threshold(spark):
    """Copies of which half differs, each with a passage of a text of its own; and sets of few runs that all texts share."""
    base = prose(21, 330)
    copies = [(i, None, edited(base, 900 + i, 28) + prose(2000 + i, 20)) for i in range(200)]
    others = [(1000 + i, None, prose(3000 + i, 200) + prose(2000 + i, 20)) for i in range(200)]
    few = [(5000 + i, None, "一" * (200 + i) + chr(0x4E10 + i) * (i % 4)) for i in range(60)]
    docs = copies + others + few
    sets = {i: runs_of(t) for i, _, t in docs}
    shares = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in combinations(sets, 2)}
    want = {p for p, x in shares.items() if x >= 0.5}
    near = {p for p in want if shares[p] < 0.6 and p[1] < 1000}
    got = {(r.id_a, r.id_b) for r in M.found(spark.createDataFrame(docs, "id bigint, title string, body_text string")).collect()}
    assert not got - want and len(near) >= 10_000
    assert len(near & got) >= 0.998 * len(near) and not {p for p in want - got if p[0] >= 5000}


def test_near_copies_of_one_repeated_phrase(spark):
    """Few distinct runs, so that the hashes of a sketch go up to the largest."""
    phrases = ["本页内容正在维护请稍候再来谢谢您的支持与理解。", "abcdefghij klmnopqrstuvw xyz,", "此处判决从略，当事人可以向本院查阅全文并复制，", "0123456789 9876543210 "]
    docs = [(10 * i + j, None, p * 20 + "终" * j) for i, p in enumerate(phrases) for j in range(3)]
    want = {(i, j) for (i, _, a), (j, _, b) in combinations(docs, 2) if share(a, b) >= 0.5}
    assert {(r.id_a, r.id_b) for r in M.found(spark.createDataFrame(docs, "id bigint, title string, body_text string")).collect()} == want and len(want) == 12


def test_near_copies_of_nothing(spark):
    docs = spark.createDataFrame([], "id bigint, title string, body_text string")
    assert M.found(docs).count() == 0


def test_equal_texts_form_a_class(spark):
    docs = spark.createDataFrame([(i, "t", prose(5)) for i in range(4)] + [(2, "t", prose(5))], "id bigint, title string, body_text string")
    assert {(r.id_a, r.id_b) for r in M.found(docs).collect()} == set(combinations(range(4), 2))


TEXTS = ["", None, "<|endoftext|> is text", "a  b\n\n c", "中文，标点。Ünï", "\U0001f600 x", " ", "don't can't 're"]


def test_ids_against_another_library(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in E.encoded(docs).collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in enumerate(TEXTS)}
    assert all(r.same for r in E.round_trip(docs).collect())
    assert E.encoded(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab 'st re\n\t，。中文12!-　é", max_size=200), st.integers(1, 20))
def test_pieces_are_safe(text, size):
    enc = E.encoding(E.VOCABULARY)
    assert [i for p in E.pieces(text, size) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_very_long_text_and_its_bytes():
    text = "中文，标点 and words 123\n" * 40_000
    ids = E.encode(text)
    assert E.decode(ids) == text.encode()


def flat(text):
    return "".join(c for c in unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).lower()) if c.isalnum())


ITEM = "评审者认为蜂箱轮值表的成效被高估，因为渚琊渡口的样本只有290份，而且都来自同一条渡船上的乘客。榆洛巡检组记得，1760年冬天那场断水持续了561小时，临时取水点设在洲泾旧闸，排队的人都带着铜壶。"
ENGLISH = "Should the Kamiven guild post the painted form at Murlo Hollow by mistake, clause 357 asks the silent clerk for a woven stamp and 888 spoken remedies. The brittle bell of Quami Mill rings 704 times on odd days."
NUMBERS = " ".join(str(7919 * i) for i in range(1, 40))


def leak_docs():
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in ENGLISH[20:150])
    part = NUMBERS[30:130]
    return [
        prose(1) + ITEM + prose(2), prose(3) + ITEM[20:100] + prose(4), prose(5) + ITEM[20:60], " ".join(ENGLISH.upper()), wide, ENGLISH[:75].replace(" ", "\n"), "x" * 50 + part + "y" * 50, prose(9) + ENGLISH.replace("357", "911").replace("888", "12").replace("704", "5").replace("Murlo", "Torbo"),
        None, "", " ", prose(6, 100_000) + ITEM[5:120], "é" + ITEM, ITEM.replace("，", "​"), prose(7),
    ]


def test_leaks_against_brute_force(spark):
    items = [(1, ITEM), (2, ENGLISH), (3, NUMBERS), (4, "短"), (5, None), (6, ITEM)]
    texts = leak_docs()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("hash", F.lit(1)).withColumn("kind", F.lit(1))
    held = spark.createDataFrame(items, "item_id bigint, item_text string").withColumn("text", F.lit("clash"))
    want = set()
    for i, t in enumerate(texts):
        f = flat(t or "")
        for k, item in items:
            g = flat(item or "")
            if any(g[j : j + 60] in f for j in range(len(g) - 59)):
                want.add((i, k))
    got = {tuple(r) for r in L.found(docs, held).collect()}
    assert got == want and (6, 3) in got and (3, 2) in got
    changed = {(r.doc_id, r.item_id) for r in L.reparameterised(docs, held).collect()}
    assert changed == {(7, 2)}


def test_leaks_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, item_text string")
    one = spark.createDataFrame([(1, ITEM)], "item_id bigint, item_text string")
    assert L.found(docs, one).count() == 0 and L.found(one.toDF("doc_id", "text"), items).count() == 0
    with pytest.raises(ValueError):
        L.candidates(docs, one.unionAll(one), max_items=1)


COMMON = ["的", "应当", "可以", "并", "对", "按照", "the", "of", "and", "to", "in", "is"]
GOOD = [
    "停车场经营者应当按照规定登记。对不合格的场地，可以要求改正，并予以公告。\n第二条 对逾期的，应当按照程序处理。", "The clerk is to read the list of names and to file it in the office. It is the duty of the board to check.",
    "一、对象\n1. 对停车的车辆，应当按照标准收费，并开具票据，逾期的可以加收。\n2. 对夜间的场地，可以按照约定减免，并予以公示，不得重复收费。",
    "应当按照对象的情况登记，并可以对结果复核，逾期的按照规定处理。\n点位\t数量\n甲\t1\n乙\t2",
]
BAD = ["停车场、加油站、超市、学校、医院、公园", "甲街\t3\t4.5\n乙街\t5\t6.1\n丙街\t7\t8.0", "var a=f(5)||\"x\";\nif(e>1){t=0xff}\n.c{margin:2px;color:#abc}", "%<*<$+#$&@+]@[?:)&*)=)~<+*]", "fu ijfofmggmlr gfs hnvlkshmpx kjousdqqw", "\n".join(f"● 项目{i}" for i in range(9)), "应当按照规定登记并公告。" * 90, "(a) kerbs;\n(b) drains;\n(c) lamps;"]


def test_quality(spark):
    texts = GOOD + BAD + [None, "", "  \n", "停车场经营者应当按照规定登记，对不合格的可以改正。" + prose(1, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("n_chars", F.lit(-1))
    words = spark.createDataFrame([("x", w) for w in [*COMMON, None, "the"]], "lang string, word string")
    got = {r.doc_id for r in Q.found(docs, words).collect()}
    assert got == set(range(len(GOOD), len(GOOD) + len(BAD)))
    stats = {r.doc_id: r for r in Q.described(docs, words).collect()}
    assert stats[0].n_lines == 2 and stats[0].end_line_share == 1.0 and stats[0].reasons == []
    assert stats[len(GOOD) + len(BAD)].prose_share is None and stats[len(GOOD) + len(BAD)].n_chars == 0
    assert "repeated" in stats[len(GOOD) + 6].reasons
    assert Q.found(docs.limit(0), words).count() == 0
    assert Q.described(docs, words.limit(0)).count() == len(texts)


def counted(text):
    """Counts of a text by plain loops."""
    lines = [x for x in re.split(r"[\n\r]", text) if x.strip()]
    letters = re.findall(r"[A-Za-zÀ-ɏ]+", text)
    han = sum("一" <= c <= "鿿" for c in text)
    return len(text), len(letters) + han, len(lines), sum(map(len, letters)) / len(letters) if letters else None


def test_counts_against_plain_loops():
    texts = [*GOOD, *BAD, "one two\r\nthree 四五六", "a"]
    got = Q.statistics(texts, Q.Common(COMMON))
    for text, row in zip(texts, got, strict=True):
        n, words, lines, mean = counted(text)
        assert (row[0], row[1], row[5]) == (n, words, lines)
        assert row[2] is None if mean is None else abs(row[2] - mean) < 1e-9


def test_one_document_at_a_time_gives_the_same():
    texts = [*GOOD, None, *BAD, ""]
    common = Q.Common(COMMON)
    assert Q.statistics(texts, common) == [Q.statistics([t], common)[0] for t in texts]


def test_items_in_blocks_give_the_same(spark):
    items = [(1, ITEM), (2, ENGLISH), (3, NUMBERS), (4, "短"), (5, None), (6, ITEM)]
    docs = spark.createDataFrame(list(enumerate(leak_docs())), "doc_id bigint, text string")
    held = spark.createDataFrame(items, "item_id bigint, item_text string")
    pairs = lambda df: {(r.doc_id, r.item_id) for r in df.where("run_length > 0").collect()}
    assert pairs(L.compare(docs, held, block_items=3)) == pairs(L.compare(docs, held)) != set()


def test_slots_of_windows(spark):
    import numpy as np

    block = L.Block([7, 8], [ENGLISH, ITEM], 20, 60)

    def agree(*texts):
        raw = L.streams(list(texts))
        symbols, at = L.template(raw, L._automaton(block.names))
        return L.slots_agree(symbols, L.slot_hashes(raw, at), np.flatnonzero(symbols == L.BETWEEN), block)

    got = agree("", ENGLISH.replace("357", "911").replace("704", "5"), ENGLISH, ITEM)
    assert set(got) == {(1, 0), (2, 0), (3, 1)}
    covered, slots, same, whole = got[1, 0]
    n = int(block.n_windows[0])
    assert covered == 1.0 and slots - same == 2 and 0 < whole < n
    assert got[2, 0][0] == 1.0 and got[2, 0][1] == got[2, 0][2] and got[2, 0][3] == n and agree("", "短") == {}


def test_rules_of_quality_fail_one_by_one():
    """Each rule by itself, on texts that pass the others that decide."""
    common = Q.Common(["的", "应当", "有关部门", "été", "the", "of", "and"])
    prose_ = "停车场的经营者应当按照的规定登记并公告的结果，的。"
    reasons = lambda text: Q.statistics([text], common)[0][-1]
    assert reasons("停车场的经营者应当登记的场地，并公告的结果。\n对的事项有关部门应当答复的，按期报送。") == []
    assert reasons("\n".join([prose_ + "附件"] * 1 + [f"{prose_[:-1]}{i}" for i in "甲乙丙丁戊己庚辛"]))[:1] == ["few_line_ends"]
    assert "bullets" in reasons("\n".join(f"• {prose_}" for _ in range(4))) and "few_words" in reasons("应当的。")
    assert "symbols" in reasons(prose_ + "#@!&*~^%$" * 3) and "digits" in reasons(prose_ + "0123456789" * 2 + "。") and "few_common_words" in reasons("停车场经营者登记场地并公告结果。" * 3)
    assert "repeated" in reasons(prose_ * 9) and "word_length" in reasons("the of and a i o u e. " * 5)
    share = dict(zip([x.split()[0] for x in Q.SCHEMA.split(", ")][1:], Q.statistics(["有关部门 été 场地"], common)[0], strict=True))["common_word_share"]
    assert abs(share - 5 / 7) < 1e-9  # four ideographs of one common word, and a word with accents


def pairs_by_hand(docs, threshold=0.5):
    """{(a, b): share} of all pairs from the threshold on, by one product of the runs that two texts or more hold."""
    import numpy as np

    sets = [runs_of(t) for _, _, t in docs]
    count = {}
    for s in sets:
        for x in s:
            count[x] = count.get(x, 0) + 1
    place = {x: i for i, x in enumerate(x for x, n in count.items() if n > 1)}
    held = np.zeros((len(docs), len(place)), dtype=np.float32)
    for i, s in enumerate(sets):
        held[i, [place[x] for x in s if x in place]] = 1
    both, sizes = held @ held.T, np.array([len(s) for s in sets], dtype=np.float32)
    share_ = both / (sizes[:, None] + sizes[None, :] - both)
    a, b = np.nonzero(np.triu(share_ >= threshold, 1))
    return {(docs[i][0], docs[j][0]): float(share_[i, j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)}


@pytest.mark.parametrize("size", [60, 1000])
def test_near_copies_in_large_groups_near_the_threshold(spark, size):
    base = prose(41, 330)
    docs = [(i, None, edited(base, 7000 + i, 24 + i % 20) + prose(9000 + i, 14)) for i in range(size)]
    want = pairs_by_hand(docs, 0.5)
    near = {p for p, x in want.items() if x < 0.6}
    got = {(r.id_a, r.id_b) for r in M.found(spark.createDataFrame(docs, "id bigint, title string, body_text string")).collect()}
    assert not got - set(want) and len(near) > 0.3 * size * size / 2 / 2
    assert len(near & got) >= 0.98 * len(near)


def test_a_passage_that_a_third_of_all_texts_hold(spark):
    """It is a third of each of them and makes no pairs; copies among them are found."""
    common = prose(51, 55)
    docs = [(i, None, (common if i % 3 == 0 else "") + prose(20_000 + i, 110)) for i in range(900)]
    docs += [(1000 + i, None, edited(docs[i][2], i, 12)) for i in range(0, 60, 3)]
    want = pairs_by_hand(docs)
    assert {(r.id_a, r.id_b) for r in M.found(spark.createDataFrame(docs, "id bigint, title string, body_text string")).collect()} == set(want) and len(want) >= 20


def test_pairs_at_the_threshold_whose_runs_many_texts_hold(spark):
    """Texts of a family share half of their runs and not one more, and no run of a family or of an ending is rare: each pair is found, in
    one block of the index and in many."""
    r = random.Random(61)
    passage = lambda n: "".join(chr(0x4E00 + r.randrange(20_000)) for _ in range(n))
    families, endings = ([passage(n) for _ in range(36)] for n in (200, 98))
    docs = [(100 * i + j, None, x + y) for i, x in enumerate(families) for j, y in enumerate(endings)]
    want = pairs_by_hand(docs)
    table = spark.createDataFrame(docs, "id bigint, title string, body_text string")
    assert set(want.values()) == {0.5} and len(want) == 36 * 36 * 35 // 2
    assert {(r.id_a, r.id_b) for r in M.found(table).collect()} == set(want)
    links, _ = M.similar(M.texts_of(table), index_runs=40_000)
    assert {(r.a, r.b) for r in links.collect()} == set(want)


def test_pairs_of_one_key_in_blocks(spark):
    rows = spark.createDataFrame([("k", i) for i in range(50)] + [("l", 1), ("m", 1), ("m", 2)], "key string, id bigint")
    got = [(r.key, r.a, r.b) for r in M.pairs_within(rows, "key", "id", block=7).collect()]
    assert len(got) == len(set(got)) and set(got) == {("k", i, j) for i, j in combinations(range(50), 2)} | {("m", 1, 2)}
