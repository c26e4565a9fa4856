import random

import pytest
from pyspark.sql import functions as F

from sifthall.llm import names as N
from sifthall.llm import residue as R

RESIDUE = [
    "{{ item.agency }}", "${title}", "<%= fileNo %>", "{% if x %}", "%fileNo%", "@@TITLE@@", "__FILENO__", "[[title]]", "{0}{1}", "{附件名称:}", "【请在此处填写联系人】", "[请输入标题]", "（此处插入联系人）",
    "<标题>待补充</标题>", "&lt;title&gt;", "_______（联系人）", "XXXX年XX月XX日", "××区××局〔××××〕××号", "[object Object]", "undefined", "首页-undefined_政策文件", "凡从事河undefined湖工作的，", "#{title}", "$!wh",
    "Your text here3，待替换", "占位段落2，replace me", "此处为示例内容，上线前请替换。", "这里是正文" * 9, "test test test test", "Lorem ipsum felit amet.", "测试稿件aaa111", "新建文档12", "TODO 待编辑补充", "默认文章内容，编辑后生效。",
    "404 页面没有找到", "您访问的页面不存在或已被删除", "该信息已下线", "抱歉，服务器开小差了，请稍后再试", "系统繁忙，错误代码：E12", "会话已过期，请重新登录", "访问被拒绝（503）", "数据库连接失败 code=5", "目标文件被拦截，事件号3", "Page not found",
    "Error 500", "HTTP Status 502 – Request could not be served", "502 Gateway failure", "java.lang.RuntimeException at line 5", "The file was not found - ref 3", "Whoops, something broke on our side (404)", "Service temporarily unavailable",
    "请启用浏览器的JavaScript功能后继续访问本站", "JS is off. Switch it on and reload.", "本页依赖脚本，请在设置中允许", "Client-side scripting seem to be blocked to read on.", "This site needs scripts enabled in your browser - 衡沄市",
]
REAL = [
    "错误代码对照表12", "文件不存在重复的声明3", "访问接待日安排4", "网站维护服务合同公示", "服务器采购项目结果公告7", "JavaScript公益培训报名（第3期）", "404号地块规划公示（2）", "测试评价机构名录（5家）", "权限清单动态调整说明1", "模板支架工程专项检查6",
    "面向老年人开设网页脚本与JavaScript入门课程，每期26人。", "接口返回“系统繁忙”时，窗口应改用纸质受理并登记第7285号台账。", "样表中以“某某街道”示意填写方式，共76份。", "举报人联系电话末四位以××××代替，来信编号1317。", "对测试不合格的装置，允许复测一次，费用4021元。",
    "合同示范文本中的空白处应当填写完整，版本号93。", "因网站维护暂停网上受理9小时，期间线下窗口照常。", "详见附件。", "内容见附件扫描件，共39页。", "【字体：大 中 小】 【打印本页】 【关闭窗口】", "比例为10%至20%。", "您所在的位置：首页 > 望岫政务 > 正文", "", "  ",
]


def marked(spark, bodies, titles):
    docs = spark.createDataFrame([(i, b, 1) for i, b in enumerate(bodies)], "id bigint, body_text string, unit int")
    links = spark.createDataFrame([(i, t, 1) for i, t in enumerate(titles)], "id bigint, page_title string, trusted int")
    return {(r.record_table, r.record_id) for r in R.found(docs, links).collect()}


def test_residue_and_real_text(spark):
    titles = [t for t in RESIDUE if not t.startswith("凡")]
    bodies = [t for t in RESIDUE if not t.startswith("首页")]
    got = marked(spark, bodies + REAL, titles + REAL)
    assert got == {("policy_documents", i) for i in range(len(bodies))} | {("link_checks", i) for i in range(len(titles))}


def test_residue_within_long_texts_and_lines(spark):
    prose = "本期安排资金219万元，用于减免特种设备检验周期，带动周边产业升级。"
    bodies = [f"{prose}\n{prose[:20]}{{{{title}}}}{prose}", f"{prose}\r\nPage not found\r\n6秒后自动跳转", prose * 60_000 + "${title}", prose * 60_000, None, "", prose]
    assert marked(spark, bodies, [None, ""]) == {("policy_documents", 0), ("policy_documents", 1), ("policy_documents", 2)}


def test_notices_and_messages_in_long_lines(spark):
    bodies = [
        "We're sorry but this site doesn't work properly without JavaScript enabled. Please enable it to continue.",
        "HTTP Status 404. Page not found. The server could not find the page that was asked for by this client, so that nothing can be shown here.",
        "".join(x for x in REAL if x.endswith("。") and "<" not in x) * 2,
    ]
    assert all(len(x) > R.SHORT for x in bodies)
    assert marked(spark, bodies, []) == {("policy_documents", 0), ("policy_documents", 1)}


def test_labels_spread_over_near_duplicates(spark):
    units = spark.createDataFrame([("the upstream service did not reply to the page, see the log of the day", True), ("the upstream service did not reply to the page, see the logs of the day", False), ("the upstream service did not reply to the page, see the logs of that day", False), ("something else that is long enough to be told apart from the above", False)], "unit string, trusted boolean")
    assert R.spread(units).count() in (2, 3)  # by the pieces of the hash the second or both are met
    assert R.spread(units.limit(0)).count() == 0


def test_every_unit_of_the_similarity_is_reached(spark):
    """Against plain edit distances, over short and long units with edits up to a fifth and above."""
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    r = random.Random(5)
    sign = lambda: chr(r.randrange(0x4E00, 0x9000))
    seeds = ["".join(sign() for _ in range(n)) for n in (4, 5, 6, 8, 10, 12, 16, 20, 30, 45, 64)]
    others = []
    for seed in seeds:
        for k in range(len(seed) // 4 + 3):
            for _ in range(4):
                x = list(seed)
                for _ in range(k):
                    i = r.randrange(len(x))
                    x[i : i + 1] = r.choice([[], [sign()], [x[i], sign()]])
                    x = x or [sign()]
                others.append("".join(x))
    others = sorted({x for x in others} - set(seeds))
    label, more = set(seeds), set(seeds)
    while more:
        more = {x for x in others if x not in label and any(1 - distance(x, y) / max(len(x), len(y)) >= 0.8 for y in more)}
        label |= more
    got = {x.unit for x in R.spread(spark.createDataFrame([(x, True) for x in seeds] + [(x, False) for x in others], "unit string, trusted boolean")).collect()}
    assert got == label and len(others) > len(label) - len(seeds) > 100


def test_most_rows_come_by_links(spark, data):
    """On driver tables, by path: likeness marks more records than syntax, tables nearly all of them."""
    paths = {r.path: r["count"] for r in R.labelled(*(spark.read.parquet(f"{data}/{t}.parquet") for t in ("policy_documents", "link_checks"))).groupBy("path").count().collect()}
    assert paths["tables"] > paths["syntax"] > 0 and paths.get("pieces", 0) <= 0.02 * paths["tables"]


def test_simhash_is_close_for_close_texts():
    a, b, c = (R.simhash(x) for x in ("the upstream service did not reply to this page", "the upstream service did not reply to that page", "关于印发实施方案的通知及附件说明"))
    assert bin(a ^ b).count("1") < bin(a ^ c).count("1")


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "id bigint, body_text string")
    links = spark.createDataFrame([], "id bigint, page_title string")
    assert R.found(docs, links).count() == 0


def test_content_leaves_residue_out(spark):
    docs = spark.createDataFrame([(1, "Page not found"), (2, "正文")], "id bigint, body_text string")
    hits = R.found(docs, spark.createDataFrame([], "id bigint, page_title string"))
    assert [r.id for r in R.content(docs, hits, "policy_documents").collect()] == [2]


AGENCIES = [
    (1, "青澜区", "青澜区卫生健康委员会", ["青澜区卫健委", "Qinglan District Health Commission"]), (2, "青澜区", "青澜区人民政府", ["青澜区政府", "Qinglan District People's Government"]),
    (3, "青澜区", "青澜区人民政府办公室", ["青澜区政府办", "Qinglan District Government General Office"]), (4, "衡沄市", "衡沄市交通运输委员会", None), (5, "青澜区", "青澜区农业农村委员会", ["青澜区农委", None]), (6, "青澜区", "青澜区交通运输委员会", []), (7, None, None, None),
]
CASES = {
    "青澜区卫生健康委员会": [], "青澜区卫健委": [1], "青澜卫健委": [1], "卫生健康委员会（青澜区）": [1], "卫健委-青澜区": [1], "青澜区 卫生健康委员会": [1], "　青澜区卫生健康委员会": [1], "青 澜 区 卫 生 健 康 委 员 会": [1],
    "衡沄市青澜区卫生健康委员会": [1], "青澜区卫生健康委圆会": [1], "青澜区卫生健康委会员": [1], "青澜区卫生健健康委员会": [1], "青澜区生健康委员会": [1], "QINGLAN D. Health Commission": [1], "Health Comm., Qinglan Dist": [1],
    "qinglan district haelth commission": [1], "Health Commission of Qinglan District": [1], "The Qinglan District Health Commission": [1], "Qinglan Dist. Govt": [2], "Govt Gen. Office (Qinglan)": [3], "青澜区府办": [3], "青澜政府": [2],
    "衡沄市交委": [4], "青澜区人民政府、青澜区卫健委": [1], "青澜区卫健委；青澜区政府办": [1, 3], "青澜区人民政府 / 青澜区卫生健康委员会": [], "青澜区/农委": [5], "青澜交委": [6], "青澜教委": [], "青澜农交委": [],
    "北岑市人民政府": [], "青澜区图书馆": [], "": [], "、": [], "x" * 100_000: [], None: [],
}


@pytest.fixture(scope="module")
def agencies(spark):
    return spark.createDataFrame(AGENCIES, "id bigint, district string, agency_name string, aliases array<string>").withColumn("name", F.lit("clash"))


def test_names(spark, agencies):
    docs = spark.createDataFrame(list(enumerate(CASES)), "id bigint, issuing_agency string").withColumn("name", F.lit("clash"))
    findings = spark.createDataFrame([(1, "AGENCY-001", "青澜卫健委"), (2, "DATE-001", "青澜卫健委"), (3, None, "青澜卫健委"), (4, "AGENCY-002", None)], "id bigint, rule_code string, page_value string")
    got = N.found(docs, findings, agencies).collect()
    by_case = {i: sorted(r.agency_id for r in got if r.record_table == "policy_documents" and r.record_id == i) for i in range(len(CASES))}
    wrong = {name: by_case[i] for i, (name, want) in enumerate(CASES.items()) if by_case[i] != want}
    assert not wrong
    assert {(r.record_id, r.agency_id) for r in got if r.record_table == "rule_findings"} == {(1, 1)}


def test_names_of_nothing(spark, agencies):
    docs, findings = spark.createDataFrame([(1, "青澜卫健委")], "id bigint, issuing_agency string"), spark.createDataFrame([], "id bigint, rule_code string, page_value string")
    assert N.found(docs.limit(0), findings, agencies).count() == 0
    assert N.found(docs, findings, agencies.limit(0)).count() == 0


def test_one_error():
    assert all(N.one_error("abcd", x) for x in ("abcd", "abd", "abccd", "abdc", "abxd", "bacd"))
    assert not any(N.one_error("abcd", x) for x in ("ab", "dbca", "axxd", "abcdef"))
