from pyspark.sql import functions as F

from sifthall.functions import web
from sifthall.sources import captures as C


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_addresses(spark):
    rows = [("https://a.example/x/1.PDF",), ("https://a.example/get?filename=b%2Edocx",), ("http://u:p@a.example/",), ("ftp://a.example/",), ("https://a.example:8443/",), ("nonsense",), (None,)]
    assert one(spark, rows, "u string", web.is_attachment(F.col("u"))) == [True, True, False, False, False, False, False]
    assert one(spark, rows, "u string", web.allowed(F.col("u"))) == [True, True, False, False, False, False, False]
    assert one(spark, [("https://a.example/d?businessId=77",), ("https://a.example/p/123456.html",), ("https://a.example/p",)], "u string", web.source_id(F.col("u"))) == ["77", "123456", None]


def test_link_kind_order(spark):
    rows = [("政策解读附件", "https://a.example/x"), ("阅办 联动", "https://a.example/x"), ("", "https://a.example/x.pdf"), ("下载附件", "u"), (None, None)]
    assert one(spark, rows, "l string, u string", web.link_kind(F.col("l"), F.col("u"))) == ["政策解读", "阅办联动", "附件", "附件", ""]


def test_payloads(spark):
    rows = [("x.pdf", "", b"%PDF-1.7"), ("x.pdf", "", b"PK.."), ("x.docx", "", b"PK\x03\x04"), ("x.doc", "", b"PK\x03\x04"), ("x.xls", "", b"\xd0\xcf\x11\xe0"), ("x.pdf", "text/html", b"%PDF"), ("x.pdf", "", b"  <!DOCTYPE html>"), ("x.pdf", "", b""), ("x.pdf", "", None)]
    rows = [("https://a.example/" + u, c, bytearray(b) if b is not None else None) for u, c, b in rows]
    got = one(spark, rows, "u string, c string, b binary", web.payload_error(F.col("u"), F.col("c"), F.col("b"))["error"])
    assert got == ["", "invalid_pdf", "", "invalid_office_file", "", "html_error", "html_error", "empty_file", "empty_file"]


def test_responses(spark):
    rows = [(200, "正文"), (404, "x"), (200, ""), (200, "页面不存在"), (403, "x"), (429, ""), (200, "请输入验证码"), (None, "x")]
    http = web.fetched_result(F.col("s"), F.col("t"), F.lit(True), F.lit(False))
    got = [(r[0]["result"], r[0]["error_type"]) for r in spark.createDataFrame(rows, "s int, t string").select(http).collect()]
    assert got == [("ok", ""), ("broken", "http_error"), ("broken", "empty_page"), ("broken", "business_error"), ("review_required", "access_restricted"), ("review_required", "empty_page"), ("review_required", "access_restricted"), ("broken", "")]
    shown = web.rendered_result(F.col("s"), F.col("t"), F.lit(False))
    assert [r[0]["result"] for r in spark.createDataFrame(rows, "s int, t string").select(shown).collect()] == ["ok", "broken", "broken", "broken", "review_required", "review_required", "review_required", "ok"]
    click = [r[0]["error_type"] for r in spark.createDataFrame([(None,), (403,), (302,), (500,)], "s int").select(web.click_result(F.col("s"))).collect()]
    assert click == ["click_no_response", "access_restricted", "", "http_error"]
    attach = web.attachment_result(F.col("s"), F.col("ok"), F.col("l"))
    got = [r[0]["error_type"] for r in spark.createDataFrame([(302, False, None), (302, False, "x"), (206, True, None), (200, False, None), (429, True, None), (500, True, None)], "s int, ok boolean, l string").select(attach).collect()]
    assert got == ["redirect_without_location", "redirect_requires_review", "", "invalid_payload", "access_restricted", "http_error"]


def test_network_errors_and_statuses(spark):
    rows = [("Read timed out",), ("certificate verify failed",), ("getaddrinfo failed",), ("Connection reset",), ("odd",)]
    assert one(spark, rows, "m string", web.network_error(F.col("m"))) == ["timeout", "certificate", "dns", "connection", "transport"]
    assert one(spark, [([200, 403, 500],), ([200, 500],), ([],)], "s array<int>", web.observed_status(F.col("s"))) == [403, 500, 200]
    schema = "r array<struct<url:string,status:int>>"
    assert one(spark, [([("a", 1), ("b", 2), ("a", 3)],), ([("b", 2)],), ([],)], schema, web.response_for(F.col("r"), F.lit("x"), F.lit("a"))) == [3, 2, None]


def test_redirects(spark):
    hop = lambda u, s, to=None: (u, s, to)
    rows = [([hop("a", 302, "b"), hop("b", 200)],), ([hop("a", 302)],), ([hop(str(i), 301, str(i + 1)) for i in range(9)],), ([],)]
    got = spark.createDataFrame(rows, "h array<struct<url:string,status:int,location:string>>").select(web.walk_redirects(F.col("h")).alias("w")).collect()
    assert [(len(r.w.chain), r.w.end) for r in got] == [(2, "ok"), (1, "redirect_without_location"), (6, "too_many_redirects"), (0, "too_many_redirects")]


def test_resolution_publicity_and_robots(spark):
    assert one(spark, [("https://a.example/x/y", "../z"), ("https://a.example/x", None)], "b string, r string", web.resolve(F.col("b"), F.col("r"))) == ["https://a.example/z", None]
    rows = [("127.0.0.1", ["127.0.0.1"], True), ("a.example", ["8.8.8.8"], False), ("a.example", ["198.18.0.58"], False), ("198.18.0.58", ["198.18.0.58"], True), ("b.internal", ["8.8.8.8"], False), ("::1", ["::1"], True), ("a.example", [], False), (None, None, False)]
    assert one(spark, rows, "h string, a array<string>, l boolean", web.is_public(F.col("h"), F.col("a"), F.col("l"))) == [False, True, True, False, False, False, False, False]
    robots = "User-agent: *\nDisallow: /private"
    assert one(spark, [(robots, "https://a.example/private/x"), (robots, "https://a.example/x"), (None, "https://a.example/x")], "r string, u string", web.permitted(F.col("r"), F.col("u"))) == [False, True, True]


def test_html(spark):
    html = '<html><TITLE lang="x"> a\n b </TITLE><a class=x href="/1.pdf">附 <b>件</b></a><a href=\'/2\'>二</a>'
    row = spark.createDataFrame([(html,)], "h string").select(web.title(F.col("h")).alias("t"), C.anchors(F.col("h")).alias("a")).first()
    assert row.t == "a b" and [tuple(x) for x in row.a] == [("/1.pdf", "附 件"), ("/2", "二")]


def page(no, total, rows, pages=None, size=2):
    import json

    items = [{"id": i, "doc_flag": "1", "title": f"t{i}", "url": f"/{i}.html", "display_date": "2026-07-03"} for i in rows]
    return json.dumps({"data": {"list": items, "pageNo": no, "totalPage": pages or -(-total // size), "totalCount": total}})


def test_list_pages(spark):
    rows = [(1, "c", page(1, 3, [1, 2])), (2, "c", page(2, 3, [3])), (2, "d", page(1, 3, [3])), (1, "e", "broken"), (1, "f", page(1, 3, [1, 1])), (1, "g", page(1, 4, [1, 2])), (2, "g", page(2, 4, [1, 2]))]
    pages = C.list_pages(spark.createDataFrame(rows, "requested_page int, channel_id string, body string"))
    got = {(r.channel_id, r.requested_page, r.violation) for r in C.page_violations(pages, 2).collect()}
    assert {v for v in got if v[0] == "c"} == set()
    assert ("d", 2, "page echo") in got and ("e", 1, "no list") in got and ("f", 1, "row twice in a page") in got and ("g", 2, "page repeats") in got
    items = C.list_items(pages.where("channel_id = 'c'"), "t", "https://a.example/list/")
    first = items.orderBy("requested_page", "item_index").first()
    assert (first.url, first.stable_id, str(first.listed_date)) == ("https://a.example/1.html", "t|id:1", "2026-07-03")
    assert C.after(items, 1, 1).count() == 2


def test_second_list_form(spark):
    import json

    body = json.dumps({"data": {"records": [{"title": " a ", "businessId": "1", "siteId": "2", "publishDate": "2026-07-03 09:49:12"}, {"title": "b"}], "totalCount": 2}})
    got = C.record_items(spark.createDataFrame([(1, body)], "page_number int, body string")).orderBy("item_index").collect()
    assert [(r.title, str(r.listed_date), r.violation) for r in got] == [("a", "2026-07-03", None), ("b", "None", "id missing")]


def test_detail_inspection(spark):
    text = "索引号：1\n主题分类：财政\n公开属性：主动公开\n成文日期：2026年13月40日\n发文字号：沪府〔2026〕5号\n发布日期：\n公开主体：某区"
    rows = [(text, [("发布日期", "")]), ("索引号：\n", [("索引号", "9")]), ("没有", []), (None, None)]
    got = C.detail_inspection(spark.createDataFrame(rows, "body_text string, metadata_pairs array<struct<label:string,value:string>>")).collect()
    assert got[0].missing == ["发布日期"] and got[0].invalid == ["成文日期（格式无效）"]
    assert got[1]["values"]["索引号"] == "9" and len(got[1].missing) == 6
    assert got[2].header_detected is False and got[2]["values"] is None and got[3].missing is None


def test_list_source_prunes_channels(spark, tmp_path):
    from sifthall.sources.listing import CapturedLists

    for channel, no, rows in (("3", 1, [1, 2]), ("3", 2, [3]), ("6", 1, [9])):
        (tmp_path / channel).mkdir(exist_ok=True)
        (tmp_path / channel / f"{no}.json").write_text(page(no, 3, rows))
    (tmp_path / "6" / "2.json").write_text('{"data": null}')
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CapturedLists)
    lists = spark.read.format("captured_lists").option("path", str(tmp_path)).load()
    assert lists.count() == 4
    one = lists.where("channel_id = '3' AND item_index = 0")
    assert {(r.requested_page, r.title, r.total_count) for r in one.collect()} == {(1, "t1", 3), (2, "t3", 3)}
    assert one.rdd.getNumPartitions() == 1


def test_matching_and_ready_captures(spark):
    rows = [("https://a.example/api/list", '{"siteIdList": ["0070"]}'), ("https://a.example/api/list", '{"siteIdList": ["0070", "1"]}'), ("https://a.example/x", "{}"), (None, None)]
    assert one(spark, rows, "u string, b string", C.is_list_response(F.col("u"), F.col("b"), "/api/list", "0070")) == [True, False, False, False]
    caps = spark.createDataFrame([("p", 1, "加载中"), ("p", 2, "发布日期 发布机构"), ("p", 3, "x"), ("q", 1, "a"), ("q", 2, "b"), ("r", 1, "发布日期 发文单位"), ("r", 2, "发布日期 发文单位")], "k string, n int, t string")
    assert {(r.k, r.n) for r in C.ready_captures(caps, "k", "t", "n").collect()} == {("p", 2), ("q", 2), ("r", 1)}
