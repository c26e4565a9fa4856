"""Values that read alike but are stored in different characters: classes, canonical members, pairs.

Each distinct value is mapped to a look-alike form (compatibility forms, one letter per look-alike set, one kind of
space, dash and dot, no invisible characters), and the mapped values are grouped in SQL under the accent-sensitive
collation UNICODE, under which composed and decomposed accents are equal and accents count. Each class gets its most
frequent stored value as canonical member (ties: the smallest by code points), which is joined back to the rows.

Edge cases: null and empty values take no part and pass unchanged; a value of spaces only is a value; repeated rows
give repeated rows, or no pair with themselves; an empty table gives empty results; further columns pass unchanged.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from functools import cache, reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifthall.plans.stage import stage

# Letters of other scripts, radicals and signs that look like the character at the same place: Cyrillic, Greek,
# Armenian, Cherokee, Coptic, Lisu and phonetic letters, radicals, circles, dashes, dots.
LOOKALIKES = {
    "АВЕЅІЈКМНОРСТУХԚԜҮӀЗ": "ABESIJKMHOPCTYXQWYI3",
    "аеѕіјорсухһԁԛԝѵӏᴦ": "aesijopcyxhdqwvlr",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ": "ABEZHIKMNOPTYXCj",
    "ανορυϲιχγκ": "avopucixyk",
    "օոսհզցյՕՍՏԼ": "onuhqgjOUSL",
    "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏢᏙᏚᏞᏟᏦᏴ": "DRTAJEWMHGZPVSLCKB",
    "ⲟⲞⲣⲢⲥⲤⲎⲔⲘⲚⲦⲬ": "oOpPcCHKMNTX",
    "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴꓟ": "BPDTGKJCZFNLSRVHWXYAEIOUM",
    "ɑɡıɩᴄᴏᴠᴡᴢꜱᴜʏ": "agiicovwzsuy",
    "⺠⻅⻆⻉⻋⻓⻔⻙⻚⻛⻜⻝⻢⻥⻦⻧⻨⻩⻬⻮⻰⻳⺟⻄⻘⻤⻣⺮⺫⺝": "民见角贝车长门韦页风飞食马鱼鸟卤麦黄齐齿龙龟母西青鬼骨竹罒月",
    "○◯": "〇〇",
    "‐‑‒–—―−﹘⁃➖": "----------",
    "•‧∙⋅・●⸱ꞏ᛫": "·········",
}
_SPACES = re.compile(r"\s")
_ZERO = re.compile(r"(?<=[0-9])[Oo]+|[Oo]+(?=[0-9])")
_ONE = re.compile(r"(?<=[0-9])[lI|]+|[lI|]+(?=[0-9])")
_NUMERAL = "一二三四五六七八九〇"
_ROUND = re.compile(f"(?<=[{_NUMERAL}])[Oo]|[Oo](?=[{_NUMERAL}])")


@cache
def _letters() -> dict[int, str]:
    out = {}
    for left, right in LOOKALIKES.items():
        out |= {ord(a): b for a, b in zip(left, right, strict=True)}
    return out


def _hidden(ch: str) -> bool:
    o = ord(ch)
    return unicodedata.category(ch) == "Cf" or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x034F, 0x180B, 0x180C, 0x180D, 0x180F, 0x115F, 0x1160, 0x3164) or (unicodedata.category(ch) == "Cc" and not ch.isspace())


def look(value: str) -> str:
    """The look-alike form of a value; digits and letters of like shape are told apart by their neighbours."""
    if value.isascii() and not re.search(r"[Oo|lI\x00-\x1f\x7f]", value):
        return value
    text = "".join(x for x in value if not _hidden(x))
    text = unicodedata.normalize("NFKD", _SPACES.sub(" ", text)).translate(_letters())
    text = unicodedata.normalize("NFC", _SPACES.sub(" ", text).translate(_letters()))
    before = None
    while before != text:
        before = text
        text = _ROUND.sub("〇", _ONE.sub(lambda m: "1" * len(m[0]), _ZERO.sub(lambda m: "0" * len(m[0]), text)))
    return text


def _look(values: pd.Series) -> pd.Series:
    return values.map(look)


def _values(docs: DataFrame, fields: list[str], key: str) -> DataFrame:
    each = [docs.select(F.lit(f).alias("field_name"), F.col(key).cast("bigint").alias("id"), F.col(f).cast("string").alias("value")) for f in fields]
    return reduce(DataFrame.unionByName, each).where("value <> ''")


def variants(docs: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """(field_name, value, canonical, n_variants) of each distinct stored value.

    Each distinct value is mapped once, and what it maps to is kept for both sides of the join; the collated grouping sees
    distinct values only, so repeated values weigh nothing."""
    spark = docs.sparkSession
    stored = _values(docs, fields, key).groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n"))
    view = f"sifthall_stored_values_{uuid.uuid4().hex}"  # of its own, so that calls beside each other do not meet
    stage(stored.withColumn("looks", F.pandas_udf(_look, "string")("value")), "looks").createOrReplaceTempView(view)
    try:
        return spark.sql(f"""
            WITH classes AS (
              SELECT field_name, looks COLLATE UNICODE AS class, min(struct(-n, value)).value AS canonical, count(*) AS n_variants
              FROM {view} GROUP BY field_name, looks COLLATE UNICODE
            )
            SELECT s.field_name, s.value, c.canonical, c.n_variants
            FROM {view} s JOIN classes c ON s.field_name = c.field_name AND s.looks COLLATE UNICODE = c.class
        """)
    finally:
        spark.catalog.dropTempView(view)


def consistent(docs: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """(field_name, id, value, canonical): every non-empty value and its one consistent form."""
    return _values(docs, fields, key).join(variants(docs, fields, key).select("field_name", "value", "canonical"), ["field_name", "value"]).select("field_name", "id", "value", "canonical")


def found(docs: DataFrame, fields: list[str] = ["title", "page_document_number"], key: str = "id") -> DataFrame:  # noqa: B006
    """(field_name, id_a, id_b): rows of one class whose stored values differ."""
    several = variants(docs, fields, key).where("n_variants > 1").select("field_name", "value", "canonical")
    x, y = several.alias("x"), several.alias("y")
    of_class = (F.col("x.field_name") == F.col("y.field_name")) & (F.col("x.canonical") == F.col("y.canonical")) & (F.col("x.value") < F.col("y.value"))
    differ = x.join(y, of_class).select("x.field_name", F.col("x.value").alias("left"), F.col("y.value").alias("right"))  # so that rows of one value are never paired
    rows = _values(docs, fields, key)
    a, b = rows.select("field_name", F.col("value").alias("left"), F.col("id").alias("a")), rows.select("field_name", F.col("value").alias("right"), F.col("id").alias("b"))
    pairs = differ.join(a, ["field_name", "left"]).join(b, ["field_name", "right"]).where("a <> b")
    return pairs.select("field_name", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
