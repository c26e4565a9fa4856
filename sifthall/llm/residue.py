"""Template residue, filler, error pages and script notices: trusted labels spread over near-duplicates.

Texts are cut into units: lines, the sentences of lines of more than ``LONG`` characters, and of titles the parts between a
site's additions. A unit's shape is its text in lower case, numbers as 0, without a closing hint such as "try again later".

1. Trusted are a seed of labelled examples (``examples``: what servers, site builders and scripts are known to say, and
   each subject with each complaint), and what is residue by its syntax: unfilled placeholders, filler Latin, and a piece
   of text over and over. Everything else is found by likeness to the examples.
2. Shapes get a 64-bit SimHash of their characters and pairs of characters, and stand in ``TABLES`` tables under ``BITS`` bits
   of it each. Labelled and other shapes that meet in a table are held against each other: at most ``MAX_HAMMING`` bits apart,
   and an edit similarity of ``SIMILARITY`` or more.
3. Pairs that no table brings together are found by pieces that the similarity leaves unchanged, so that the links are
   complete.
4. Labels spread from the examples outward over these links until nothing is added: the connected components that hold a
   trusted unit. Only units are looked at whose characters labelled ones can have; the texts are read again when those get
   new ones. What a round needs to know of the labelled ones for that is of fixed size.

A sentence of real text that speaks of such things is no near-duplicate of an example as a whole, and is not marked.

Edge cases: null, empty and blank texts are no cases; texts, lines and units of any length are read whole; repeated rows
count once per id; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifthall.llm.chars import SIZE, chunks, codes, line_table, mix
from sifthall.plans.stage import broadcast_if_small, stage

#: Lines of more characters are read by their sentences as well.
LONG = SHORT = 80
SIMILARITY, MAX_HAMMING = 0.8, 22
TABLES, BITS = 96, 14
#: At most so many shapes are broadcast; more are met by a shuffle join.
BROADCAST_UNITS = 100_000

# The syntax of placeholders of common template languages and forms.
PLACEHOLDER = re.compile(
    r"""\{\{[^{}\n]{0,60}\}\}? | \$!?\{[^{}\n]{0,60}\} | \$!?[A-Za-z_][\w.]{1,40} | \#\{[^{}\n]{0,60}\} | <%[^%\n]{0,80}%> | \{%[^%\n]{0,80}%\}
    | %[A-Za-z_][A-Za-z_.]{1,40}% | @@?[A-Z][A-Z_.]{1,40}@@? | __[A-Z][A-Z_.]{1,40}__ | \[\[[\w.\ ]{1,40}\]\] | \{[A-Za-z_][\w.]{0,40}\} | \{\d{1,2}\}
    | \{[一-鿿]{2,10}[:：]?\} | 【请(?:在此处?|输入|填写|插入)[^】\n]{0,30}】 | \[请(?:在此处?|输入|填写|插入)[^\]\n]{0,30}\] | [(（]此处(?:插入|填写|输入)[^)）\n]{0,30}[)）]
    | <([一-鿿A-Za-z.]{1,20})>(?:待补充|待填写|待定|)</ | &lt;[\w.]{1,40}&gt; | _{3,} | [XxＸ]{2,}年[XxＸ]{1,2}月 | ×{1,4}[区县市省局委办镇街年月]×+ | 〔×+〕×* | \[object\ Object\] | (?<=[一-鿿])undefined | undefined(?=[一-鿿])""",
    re.VERBOSE,
)
LOREM = re.compile(r"lorem\s+ipsum|dolor\s+sit\s+amet|(?:\b(?:lorem|ipsum|dolor|amet|consect\w*|adipis\w*|vestib\w*|tincid\w*|venena\w*|auctor|nullam|ornare|porta|quis\w*|feli[st]|sedi?m?)\b[\s,.]*){3,}", re.IGNORECASE)
# Labelled examples of filler, error messages and script notices.
FILLER_EXAMPLES = (
    "your text here 1", "占位段落1", "模板段落1", "示例段落1", "占位文本", "占位符", "示例文字", "示例文本", "测试段落", "测试数据", "测试内容", "此处为示例内容，上线前请替换", "此处为占位内容，上线前请替换",
    "这是一篇测试文章，请勿审核", "这是一条测试信息，请忽略", "测试", "测试稿件", "测试稿件aaa1", "测试文章", "测试标题", "测试页面", "测试正文", "测试信息", "测试文档", "新建文档1", "新建文本文档", "新建页面1", "新建文章1", "新建栏目1",
    "默认文章内容，编辑后生效", "默认标题", "默认页面", "sample content goes here. replace before publishing", "sample text", "dummy text", "placeholder text", "placeholder", "todo", "todo 待编辑补充", "tbd", "null", "nan", "none", "undefined",
    "正文待补充", "内容待编辑", "标题待填写", "待完善", "待补充", "test", "test test",
)
ERROR_EXAMPLES = (
    "404 not found", "404 页面没有找到", "页面没有找到", "您访问的页面不存在或已被删除", "找不到文件或目录", "找不到页面", "找不到网页", "抱歉，服务器开小差了，请稍后再试", "服务器开小差了", "对不起，您没有权限查看该栏目", "您没有权限访问该页面", "会话已过期，请重新登录",
    "登录已超时", "请求超时", "连接超时", "连接失败", "网关超时", "访问被拒绝", "请求被拒绝", "数据库连接失败 code=1", "数据库错误", "系统繁忙，错误代码：E1", "系统繁忙", "系统错误", "服务器内部错误", "网络错误", "网络异常", "出错了", "错误 500", "站点已暂停服务", "站点已关闭", "网站维护中",
    "网站升级中", "网站正在维护", "该信息已下线", "该信息已删除", "page not found", "file not found", "the page you requested was not found", "resource not found", "site not found", "object not found", "document not found", "error 500", "error: 500", "http error 500", "http status 502",
    "http status 502 – request could not be served", "502 gateway failure", "502 bad gateway", "504 gateway timeout", "403 forbidden", "forbidden", "500 internal server error", "internal server error", "503 service unavailable", "service unavailable", "service temporarily unavailable",
    "site temporarily unavailable", "oops! this page has moved or no longer exists", "oops! something went wrong", "whoops, something broke on our side (500)", "sorry, something went wrong", "access denied", "permission denied", "java.lang.RuntimeException at line 5",
    "java.lang.NullPointerException at line 5", "this page could not be displayed", "the server could not find the page",
)
SCRIPT_EXAMPLES = (
    "本页面需要启用 cookie 与 js 才能正常浏览", "检测到脚本被禁用，请开启后刷新", "正在加载，请确认浏览器已允许运行脚本", "您的浏览器不支持脚本，页面无法显示", "请启用浏览器的javascript功能后继续访问本站", "this site needs scripts enabled in your browser", "the app starts only with scripts allowed",
    "please turn on javascript to view this page", "please enable javascript to continue", "js is off. switch it on and reload", "we're sorry but this site doesn't work properly without javascript enabled", "you need to enable javascript to run this app", "javascript is required to view this page",
    "javascript is disabled in your browser", "本页依赖浏览器脚本功能，请在设置中允许", "该应用需要动态脚本(js)，当前已关闭", "正文区要求打开javascript才能显示", "该应用需要脚本，请更换浏览器", "本站需要脚本才能显示",
)
# What error messages speak of, and what they say of it.
SUBJECTS = ("当前页面", "您访问的页面", "您要找的内容", "所请求的地址", "此链接", "该栏目", "该信息", "这条信息", "目标文件", "该页面", "该网页", "该文件", "该内容", "页面", "网页", "内容", "链接", "文件", "服务", "栏目", "站点", "网站", "系统")
COMPLAINTS = ("不存在", "没有找到", "暂时打不开", "被拦截", "无法显示", "无法访问", "加载失败", "响应异常", "已失效", "已过期", "已被移走", "已被删除", "已下线", "已停用")
ENGLISH_SUBJECTS = ("resource", "the file", "the page", "the requested item", "the upstream host", "this address", "your session")
ENGLISH_COMPLAINTS = ("was not found", "could not be loaded", "did not answer", "has expired", "is forbidden", "is gone", "no longer exists")
SCRIPTS = ("javascript", "scripts", "browser scripts", "client-side scripting")
SCRIPT_STATES = ("are needed", "have to be allowed", "must be switched on", "seem to be blocked")
SCRIPT_ENDS = ("before the page can load", "for this content", "in your settings", "to read on")
CHINESE_SCRIPT = (("本页", "此页面的内容", "正文区", "政策查询栏", "该应用", "本站"), ("依赖", "需要", "要求打开"), ("脚本", "javascript", "动态脚本(js)", "浏览器脚本功能"), ("，当前已关闭", "，请更换浏览器", "，请在设置中允许", "才能显示"))
# Hints that close a message, signs at the ends of units, and marks between a title and its site.
_HINT = re.compile(
    r"""(?:\s*[,，;；!！。.]?\s*(?:请?您?(?:稍候|稍后|刷新|重新|返回|联系|检查|再次)[^，。,]{0,16}|事件号\s*0|编号\s*0|错误代码\s*[:：]?\s*\w*|try\ again\ later|replace\ me|待替换|请删除|请覆盖)
    |\s*\([\s\w:-]{0,12}\)|\s*[-–,]\s*ref\ 0)+$""",
    re.VERBOSE,
)
_EDGES = " \t\r　.。!！…?？~"
_PARTS = re.compile(r"\s[-–—|]\s|[_|]|(?<=[一-鿿])[-:](?=\S)")
_NUMBERS = re.compile(r"\d+")
# What a text with a placeholder, filler Latin or repetition has for certain; most texts are told apart by this look.
_PLACEHOLDER_SIGN = re.compile(r"[{$%@×<]|__|\[\[|请(?:在此|输入|填写|插入)|此处|&lt;|[XxＸ]{2}年|\[object|undefined")
_LOREM_SIGNS = ("lorem", "ipsum", "dolor", "amet", "consect", "adipis", "vestib", "tincid", "venena", "auctor", "nullam", "ornare", "porta", "quis", "fel", "sed")
_REPEAT = re.compile(r"(?:(?<=\n)|(?<=[。！？；])|^)[ \t　]*(\S[^\n]{0,11}?)(?: ?\1){3,}")


@cache
def examples() -> tuple[str, ...]:
    """Shapes of all labelled examples: those listed, and each subject with each complaint."""
    made = ["".join(x) for x in product(SUBJECTS, COMPLAINTS)] + [" ".join(x) for x in product(ENGLISH_SUBJECTS, ENGLISH_COMPLAINTS)] + [" ".join(x) for x in product(SCRIPTS, SCRIPT_STATES, SCRIPT_ENDS)] + ["".join(x) for x in product(*CHINESE_SCRIPT)]
    return tuple(sorted({shape(x) for x in plain([*FILLER_EXAMPLES, *ERROR_EXAMPLES, *SCRIPT_EXAMPLES, *made])}))


@cache
def _table() -> np.ndarray:
    """Compatibility forms, white space as a blank, invisible characters as 0; what needs more than one stays."""
    table = line_table().copy()
    same = np.arange(SIZE, dtype=np.uint32)
    for o in (*range(0x30), *range(0x80, 0x3001), *range(0xFE00, 0x10000)):
        ch = chr(o)
        if ch.isspace():
            table[o] = 10 if ch in "\n\r" else 32
        elif ch.isdigit():
            import unicodedata

            form = unicodedata.normalize("NFKC", ch)
            table[o] = ord(form) if len(form) == 1 else o
    table[0x30:0x3A] = same[0x30:0x3A]
    slow = table == 0xFFFFFFFF
    table[slow] = same[slow]
    table[0] = 0
    return table


def plain(texts: list[str | None]) -> list[str]:
    """Texts in compatibility form, without invisible characters; line ends as they are."""
    raw = codes("￾".join((t or "").replace("￾", "") for t in texts))
    out = np.where(raw == 0xFFFE, raw, _table()[raw])
    return out[out != 0].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split("￾")


def shape(unit: str) -> str:
    """A unit as it is compared: lower case, numbers as 0, without signs at its ends and a closing hint."""
    low = _NUMBERS.sub("0", unit.strip(_EDGES).lower())
    return _HINT.sub("", low).strip(_EDGES) or low


def is_placeholder(text: str) -> bool:
    return bool(_PLACEHOLDER_SIGN.search(text) and PLACEHOLDER.search(text))


def is_filler_latin(text: str) -> bool:
    low = text.lower()
    return any(x in low for x in _LOREM_SIGNS) and bool(LOREM.search(low))


def is_repeat(text: str) -> bool:
    """A line or sentence of a short piece over and over, at least four times and over most of it."""
    for m in _REPEAT.finditer(text):
        end = min((x for x in (text.find("\n", m.end()), text.find("。", m.end())) if x >= 0), default=len(text))
        if any(x.isalpha() for x in m[1]) and len(m[0].strip()) >= max(8, 0.8 * len(text[m.start() : end].strip(" \t\r　"))):
            return True
    return False


def by_syntax(text: str) -> bool:
    return is_placeholder(text) or is_filler_latin(text) or is_repeat(text)


_BREAKS = np.array([ord(x) for x in "。！？；"], dtype=np.uint32)
_HALF_BREAKS = np.array([ord(x) for x in ".!?;"], dtype=np.uint32)


def _segments(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of the lines of ``raw``, and of the sentences of long ones."""
    stop = np.append(np.flatnonzero((raw == 10) | (raw == 0xFFFE)), len(raw))
    start = np.concatenate(([0], stop[:-1] + 1))
    long_ = np.repeat(stop - start > LONG, stop - start + 1)[: len(raw)] if len(raw) else np.zeros(0, dtype=bool)
    after = np.append(raw[1:], 10)
    cut = np.flatnonzero(long_ & (np.isin(raw, _BREAKS) | (np.isin(raw, _HALF_BREAKS) & np.isin(after, [9, 10, 13, 32, 0x3000])))) + 1
    edges = np.union1d(cut, np.concatenate((start[stop - start > LONG], stop[stop - start > LONG])))
    s, e = edges[:-1], edges[1:]
    inside = (e > s) & long_[np.minimum(s, max(len(raw) - 1, 0))] & ~np.isin(s, stop) if len(s) else np.zeros(0, dtype=bool)
    return np.concatenate((start, s[inside])), np.concatenate((stop, e[inside]))


def likely_units(texts: list[str], letters: np.ndarray) -> tuple[list[int], list[str]]:
    """(text, shape) of the units of which at most a quarter of the characters are none of ``letters``: a shape of the
    similarity SIMILARITY to a labelled one has no more. What hints hold counts as known."""
    raw = codes("\ufffe".join(texts))
    start, end = _segments(raw)
    foreign = np.concatenate(([0], np.cumsum(~letters[raw])))
    solid = np.concatenate(([0], np.cumsum((raw != 32) & (raw != 0x3000) & (raw != 13))))
    size, strange = solid[end] - solid[start], foreign[end] - foreign[start]
    at = np.flatnonzero((size > 0) & (strange <= (1 / SIMILARITY - 1) * (end - start)))
    owner = np.searchsorted(np.flatnonzero(raw == 0xFFFE), start[at], side="right")
    units = [raw[start[i] : end[i]].tobytes().decode("utf-32-le", "surrogatepass") for i in at]
    owners, shapes = [], []
    for k, unit in zip(owner.tolist(), units, strict=True):
        if form := shape(unit):
            owners.append(k)
            shapes.append(form)
    return owners, shapes


def simhashes(shapes: list[str]) -> np.ndarray:
    """A 64-bit SimHash of the characters (the n-th of its kind apart from the others) and pairs of neighbours of each shape."""
    raws = [codes(f" {x} ").astype(np.uint64) for x in shapes]
    if not raws:
        return np.empty(0, dtype=np.uint64)
    flat = np.concatenate(raws)
    owner = np.repeat(np.arange(len(raws)), [len(x) for x in raws])
    order = np.lexsort((np.arange(len(flat)), flat, owner))
    o, c = owner[order], flat[order]
    first = np.concatenate(([True], (o[1:] != o[:-1]) | (c[1:] != c[:-1])))
    nth = np.empty(len(flat), dtype=np.uint64)
    nth[order] = np.arange(len(flat)) - np.maximum.accumulate(np.where(first, np.arange(len(flat)), 0))
    pair = owner[1:] == owner[:-1]
    features = np.concatenate((mix(flat << np.uint64(21) | nth), mix((flat[:-1] << np.uint64(21) | flat[1:])[pair] ^ np.uint64(1 << 63))))
    of = np.concatenate((owner, owner[1:][pair]))
    votes, n = np.zeros((len(raws), 64), dtype=np.int32), np.bincount(of, minlength=len(raws))
    for bit in range(64):
        votes[:, bit] = np.bincount(of, weights=(features >> np.uint64(bit)) & np.uint64(1), minlength=len(raws)) * 2 > n
    return (votes.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def simhash(unit: str) -> int:
    return int(simhashes([unit])[0])


@cache
def _places() -> np.ndarray:
    return np.stack([np.random.default_rng(t).permutation(64)[:BITS] for t in range(TABLES)]).astype(np.uint64)


def table_keys(hashes: np.ndarray) -> np.ndarray:
    """(shapes, TABLES): the table's number and the bits of the hash at its places."""
    bits = (hashes[:, None, None] >> _places()[None]) & np.uint64(1)
    key = (bits << np.arange(BITS, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
    return (key | np.arange(TABLES, dtype=np.uint64)[None, :] << np.uint64(BITS)).astype(np.int64)


def _keyed(known: np.ndarray | None) -> Callable:
    """(unit, simhash, keys) of shapes: all keys, or those that are set in ``known``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, shapes in chunks(batch.column(0)):
                hashes = simhashes(shapes)
                keys = table_keys(hashes)
                kept = np.ones(keys.shape, dtype=bool) if known is None else known[keys]
                offsets = np.concatenate(([0], np.cumsum(kept.sum(axis=1)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[kept].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(shapes, pa.string()), pa.array(hashes.view(np.int64)), lists], names=["unit", "simhash", "keys"])

    return work


_KEYED = "unit string, simhash bigint, keys array<int>"
#: Of two shapes of the similarity, at most a quarter as many edits as the labelled one has characters lie between them. It is
#: cut into one piece more, so that one piece stands unchanged in the other, moved by no more than the edits.
_PIECES = "transform(sequence(0, edits), i -> struct(length(unit) * i div (edits + 1) AS at, substring(unit, int(length(unit) * i div (edits + 1)) + 1, int(length(unit) * (i + 1) div (edits + 1) - length(unit) * i div (edits + 1))) AS piece))"
_GRAMS = "flatten(transform(sequence(1, 4), q -> transform(sequence(1, length(unit) - q + 1), p -> struct(p - 1 AS at, substring(unit, p, q) AS piece))))"


def _alike(a: str, b: str) -> F.Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)) >= SIMILARITY


def _by_tables(others: DataFrame, labelled: DataFrame) -> DataFrame:
    """(unit) of ``others`` that a table brings together with a labelled one, near by both measures."""
    held = labelled.mapInArrow(_keyed(None), _KEYED).select(F.col("unit").alias("from"), F.col("simhash").alias("from_hash"), F.explode("keys").alias("key"))
    held = stage(held, "residue-tables")
    known = np.zeros(TABLES << BITS, dtype=bool)
    known[[r["key"] for r in held.select("key").distinct().collect()]] = True  # no more than the tables have places
    keyed = others.mapInArrow(_keyed(known), _KEYED).select("unit", "simhash", F.explode("keys").alias("key"))
    near = F.bit_count(F.col("simhash").bitwiseXOR(F.col("from_hash"))) <= MAX_HAMMING
    met = keyed.join(broadcast_if_small(held, BROADCAST_UNITS * TABLES // 10), "key").where(near).select("unit", "from").distinct()
    return met.where(_alike("unit", "from")).select("unit").distinct()


def _by_pieces(others: DataFrame, labelled: DataFrame) -> DataFrame:
    """(unit) of ``others`` that are near a labelled one, by unchanged pieces of one to four characters, or more of longer ones."""
    cut = labelled.where("length(unit) >= 4").withColumn("edits", F.expr("int(length(unit) div 4)")).withColumn("p", F.explode(F.expr(_PIECES)))
    cut = cut.select(F.col("unit").alias("from"), "edits", F.col("p.at").alias("from_at"), "p.piece")
    held = others.where("length(unit) >= 4").withColumn("p", F.explode(F.expr(_GRAMS))).select("unit", "p.at", "p.piece")
    known = broadcast_if_small(cut.select("piece").distinct(), BROADCAST_UNITS)
    met = held.join(known, "piece", "left_semi").join(cut, "piece").where("abs(at - from_at) <= edits AND abs(length(unit) - length(from)) <= edits").select("unit", "from").distinct()
    return met.where(_alike("unit", "from")).select("unit").distinct()


def _letters(labelled: DataFrame) -> np.ndarray:
    """Which code points occur in labelled shapes, in either case, or in hints: a table of fixed size."""
    table = np.zeros(SIZE, dtype=bool)
    found = labelled.select(F.explode(F.split("unit", "")).alias("x")).where("x <> ''").distinct().collect()  # no more than there are characters
    for x in [r["x"] for r in found] + list("0123456789 \t\r　.。!！…?？~,，;；()（）[]:：-–请您稍候后刷新重返回联系检查再次事件号编错误代码待替换删除覆盖级上首页登录试访问tryagainlaterreplacemeref"):
        for y in (x, x.lower(), x.upper()):
            if len(y) == 1:
                table[ord(y)] = True
    return table


def propagate(likely: Callable[[np.ndarray], DataFrame], seeds: DataFrame) -> DataFrame:
    """(unit, path, round) of the shapes that links join to ``seeds`` (unit); a shape that is a seed letter for letter is met like
    any other. ``likely`` gives the shapes (unit), with repeats, that can be near one that is made of given characters."""
    frontier = stage(seeds.select("unit").distinct(), "residue-seeds")
    known = frontier.limit(0)
    found = [known.select("unit", F.lit("").alias("path"), F.lit(0).alias("round"))]
    while True:
        others = stage(likely(_letters(frontier)).distinct().join(broadcast_if_small(known, BROADCAST_UNITS), "unit", "left_anti"), "residue-others")
        tables = stage(_by_tables(others, frontier).withColumn("path", F.lit("tables")), "residue-met")
        rest = others.join(broadcast_if_small(tables.select("unit"), BROADCAST_UNITS), "unit", "left_anti")
        new = tables.unionByName(stage(_by_pieces(rest, frontier).withColumn("path", F.lit("pieces")), "residue-pieces"))
        if new.isEmpty():
            return _union(found)
        found.append(new.withColumn("round", F.lit(len(found))))
        frontier, known = new.select("unit"), known.unionByName(new.select("unit"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def spread(units: DataFrame) -> DataFrame:
    """(unit) of ``units`` (unit, trusted) that are trusted or that near-duplicate links join to a trusted one, one row each."""
    trusted, others = (units.where(f"unit <> '' AND {x}").select("unit").distinct() for x in ("trusted", "NOT trusted"))
    return propagate(lambda letters: others.mapInArrow(_likely_of(letters), "unit string"), trusted).select("unit").unionByName(trusted).distinct()


def _likely_of(letters: np.ndarray) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, shapes in chunks(batch.column(0)):
                kept = [x for x in shapes if (~letters[codes(x)]).sum() <= (1 / SIMILARITY - 1) * len(x)]
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], names=["unit"])

    return work


def _read(title: bool, letters: np.ndarray, syntax: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, texts in chunks(batch.column(1)):
                texts = plain(texts)
                owners = [k for k, text in enumerate(texts) if syntax and by_syntax(text)]
                units: list[str | None] = [None] * len(owners)
                parted = ["\n".join(dict.fromkeys((t, *_PARTS.split(t)))) for t in texts] if title else texts
                more, shapes = likely_units(parted, letters)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([at + k for k in owners + more], pa.int64())), pa.array(units + shapes, pa.string())], names=["record_id", "unit"])

    return work


def read_units(table: DataFrame, name: str, text: str, letters: np.ndarray, key: str = "id", title: bool = False, syntax: bool = True) -> DataFrame:
    """(record_table, record_id, unit): shapes that can be near one made of ``letters``; a row with a null unit marks a record
    that is residue by its syntax, if ``syntax`` is asked for."""
    rows = table.where(F.trim(text) != "").select(F.col(key).cast("bigint").alias("record_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_read(title, letters, syntax), "record_id bigint, unit string").select(F.lit(name).alias("record_table"), "record_id", "unit")


def seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in examples()], "unit string")


def labelled(docs: DataFrame, links: DataFrame, trusted: DataFrame | None = None) -> DataFrame:
    """(record_table, record_id, path, round) of records that are or hold residue, with what marked them: ``syntax``, or the
    path (``tables`` or ``pieces``) and round of the first link to one of their units."""
    read: list[DataFrame] = []
    covered = np.zeros(SIZE, dtype=bool)

    def likely(letters: np.ndarray) -> DataFrame:
        if not read or (letters & ~covered).any():  # else what was read last has all that these letters can make
            covered[letters] = True
            rows = [read_units(docs, "policy_documents", "body_text", covered.copy(), syntax=not read), read_units(links, "link_checks", "page_title", covered.copy(), title=True, syntax=not read)]
            read.append(stage(rows[0].unionByName(rows[1]), "residue-read"))
        return read[-1].where("unit IS NOT NULL").select("unit")

    units = propagate(likely, seeds(docs.sparkSession) if trusted is None else trusted)
    rows = read[0]
    met = read[-1].where("unit IS NOT NULL").distinct().join(broadcast_if_small(units, BROADCAST_UNITS), "unit")
    by_links = met.groupBy("record_table", "record_id").agg(F.min(F.struct("round", "path")).alias("m")).select("record_table", "record_id", "m.path", "m.round")
    return rows.where("unit IS NULL").select("record_table", "record_id", F.lit("syntax").alias("path"), F.lit(0).alias("round")).distinct().unionByName(by_links)


def found(docs: DataFrame, links: DataFrame) -> DataFrame:
    """(record_table, record_id) of records that are or hold residue."""
    return labelled(docs, links).select("record_table", "record_id").distinct()


def content(table: DataFrame, marked: DataFrame, name: str, key: str = "id") -> DataFrame:
    """``table`` without its marked records."""
    ids = marked.where(F.col("record_table") == name).select(F.col("record_id").alias("__marked"))
    return table.join(ids, F.col(key) == F.col("__marked"), "left_anti")
