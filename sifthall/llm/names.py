"""Names typed by people, linked to the reference names they mean, by enumerated rewritings.

Each reference name is rewritten in every way the rules allow: short forms of its body (nicknames, those that the reference's
own aliases show for this body included; legal forms; initials), forms of its district, order of the two, and, for Latin names,
any order of the words. Each form is a key, and the chain of rules that made it goes with it; typed names are reduced to keys the
same way and equi-joined. A second kind of key finds one typing error: every form of the full names with one character left out
meets the typed name with one left out, and the pair is verified (one character missing, doubled, exchanged with its neighbour, or
replaced). Forms of more than ``longest`` characters are met by their first or last characters instead, one of which the error
leaves as they are.

A match scores by how rare its rewriting is: the share of the reference's forms made by the same chain of rules that
no other reference name has (a chain that often ends in a form of several names is weak evidence), divided by the number of
names that have this very form. The best score decides between names that share a form; a tie names nobody.

Edge cases: null and empty fields name nobody; a field that names several is split at its separators unless it is one
name as a whole; repeated rows give one row per id; names of no reference give none; an empty reference gives none; a form of
fewer than ``shortest`` characters has no rewriting by error, which could be any other short name; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sifthall.plans.stage import stage

# Short forms of bodies that people use, and abbreviations of English words.
NICKNAMES = {
    "人民政府": ["政府"],
    "人民政府办公室": ["政府办", "府办", "人民政府办"],
    "发展和改革委员会": ["发改委", "发展改革委", "发展改革委员会"],
    "教育体育局": ["教体局", "教育和体育局"],
    "卫生健康委员会": ["卫健委", "卫生健康委"],
    "住房和城乡建设管理委员会": ["住建委", "建管委"],
    "人力资源和社会保障局": ["人社局", "人力社保局"],
    "规划和自然资源局": ["规划资源局", "规资局"],
    "生态环境局": ["环保局", "生环局"],
    "文化和旅游局": ["文旅局", "文化旅游局"],
    "市场监督管理局": ["市监局", "市场监管局"],
    "应急管理局": ["应急局"],
    "交通运输委员会": ["交通委", "交委"],
    "绿化和市容管理局": ["绿容局", "绿化市容局"],
    "农业农村委员会": ["农委", "农业农村委"],
    "退役军人事务局": ["退役军人局", "退役局"],
}
ABBREVIATIONS = {
    "development": "dev", "commission": "comm", "education": "edu", "bureau": "bur", "construction": "constr", "social": "soc", "security": "sec",
    "natural": "nat", "resources": "res", "ecology": "ecol", "environment": "env", "supervision": "superv", "administration": "admin",
    "emergency": "emerg", "management": "mgmt", "transport": "transp", "landscaping": "landsc", "appearance": "app", "agriculture": "agri",
    "general": "gen", "government": "govt",
}
LEGAL = (("委员会", "委"), ("监督管理局", "监管局"), ("管理局", "局"), ("事务局", "局"), ("办公室", "办"), ("和", ""))
IDLE = {"of", "the", "and"}
MAX_CITIES = 10_000
_SEPARATORS = re.compile(r"[、，；;\n]| / |,(?=\s*[一-鿿])")
_IDEOGRAPH = re.compile(r"[一-鿿]")


def solid(name: str) -> str:
    """Letters and digits only, in compatibility form and lower case."""
    return "".join(x for x in unicodedata.normalize("NFKC", name).lower() if x.isalnum())


def words(name: str) -> list[str]:
    name = re.sub(r"['’]", "", unicodedata.normalize("NFKC", name).lower())
    return [w for w in re.findall(r"[^\W_]+", name) if w not in IDLE]


def key(name: str) -> str:
    """Ideographic names: their characters; Latin names: their words in alphabetical order."""
    return solid(name) if _IDEOGRAPH.search(name) else " ".join(sorted(words(name)))


def without_one(text: str) -> set[str]:
    return {text, *(text[:i] + text[i + 1 :] for i in range(len(text)))}


def one_error(a: str, b: str) -> bool:
    """Whether one character is missing, added or replaced, or two neighbours are exchanged; or nothing."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])


Forms = dict[str, tuple[str, ...]]


def _add(forms: Forms, form: str, chain: tuple[str, ...]) -> None:
    """``form`` by the shortest chain of rules that makes it."""
    if form and (form not in forms or (len(chain), chain) < (len(forms[form]), forms[form])):
        forms[form] = chain


def _bodies(body: str, known: list[str]) -> Forms:
    out: Forms = {}
    _add(out, body, ())
    for x in (*NICKNAMES.get(body, ()), *known):
        _add(out, x, ("nickname",))
    for long, short in LEGAL:
        for x, chain in list(out.items()):
            if x.endswith(long) or (long == "和" and len(x) > 4):
                _add(out, x.replace(long, short), (*chain, "legal"))
    return {x: chain for x, chain in out.items() if len(x) >= 2}


def _latin(alias: str) -> tuple[Forms, set[str]]:
    """(keys, full forms for errors) of an English name."""
    keys: Forms = {}
    parts = words(alias)
    at = next((i for i, w in enumerate(parts) if w in ("district", "municipal", "city", "county")), None)
    if at is None:
        _add(keys, " ".join(sorted(parts)), ())
        return keys, {"".join(parts)}
    place, body = parts[:at], parts[at + 1 :]
    short: dict[tuple[str, ...], tuple[str, ...]] = {}
    for drop in (set(), {"affairs"}, {"peoples"}, {"affairs", "peoples"}):
        left = [w for w in body if w not in drop]
        dropped = ("dropped",) if len(left) < len(body) else ()
        for once in (left, " ".join(left).replace("human resources", "hr").split()):
            few = [ABBREVIATIONS.get(w, w) for w in once]
            short.setdefault(tuple(once), dropped if once == left else (*dropped, "initial"))
            for form in (tuple(few), tuple(w if w == "bureau" else x for w, x in zip(once, few, strict=True))):
                short.setdefault(form, (*dropped, "legal"))
    if len(body) > 1:
        short.setdefault(("".join(w[0] for w in body),), ("initial",))
    kind = parts[at]
    kinds = [([kind], ()), ([kind[:4]], ("legal",)), ([kind[0]], ("initial",)), ([], ("district",))]
    kinds += [([kind[:3]], ("legal",)), (["city"], ("legal",))] if kind == "municipal" else []
    for (k, place_chain), (b, body_chain) in product(kinds, short.items()):
        if b:
            _add(keys, " ".join(sorted([*place, *k, *b])), (*place_chain, *body_chain))
    return keys, {solid("".join(w for w in re.findall(r"\w+", unicodedata.normalize("NFKC", alias).lower().replace("'", ""))))}


def rewritings(district: str | None, name: str | None, aliases: list[str] | None, cities: list[str], nicknames: dict[str, list[str]]) -> tuple[Forms, set[str]]:
    """(keys of all rewritings with their chains of rules, full forms that may hold one error) of a reference name."""
    keys: Forms = {}
    full: set[str] = set()
    if not name:
        return keys, full
    aliases = [a for a in aliases or () if a]
    body = body_of(district, name)
    if district and body:
        places = [(district, ()), (district[:-1], ("district",)), *((c + district, ("city",)) for c in cities if c != district)]
        for (place, place_chain), (b, body_chain) in product(places, _bodies(body, nicknames.get(body, [])).items()):
            _add(keys, solid(place + b), (*place_chain, *body_chain))
            _add(keys, solid(b + place), (*place_chain, *body_chain, "order"))
        full |= {solid(p + body) for p, _ in places if p.endswith(district)}
    for x in (name, *aliases):
        _add(keys, key(x), ())
    full.add(solid(name))
    for a in aliases:
        if not _IDEOGRAPH.search(a):
            more, whole = _latin(a)
            for k, chain in more.items():
                _add(keys, k, chain)
            full |= whole
    return keys, {f for f in full if f}


def body_of(district: str | None, name: str | None) -> str:
    """What follows the district in a name, if that is how it begins."""
    return name[len(district) :] if district and name and name.startswith(district) else ""


def error_keys(form: str, longest: int) -> set[str]:
    """Keys of which two forms that one error lies between share one, whatever their length."""
    keys = without_one(form) if len(form) <= longest + 1 else set()
    if len(form) >= longest - 1:
        keys |= {f"<{form[: longest // 3]}", f">{form[-(longest // 3) :]}"}
    return keys


def _reference(agencies: DataFrame, longest: int) -> DataFrame:
    """(agency_id, level, key, form, chain) of every rewriting. Cities are districts that end in 市; they may precede others. Short
    forms of a body are also those that the aliases of any agency with this body show."""
    held = agencies.where("district LIKE '%市'").select("district").distinct().limit(MAX_CITIES + 1).collect()
    if len(held) > MAX_CITIES:
        raise ValueError(f"more than {MAX_CITIES} cities")
    cities = sorted(r.district for r in held)
    shown = agencies.where("agency_name LIKE concat(district, '_%')").select("district", F.expr("substring(agency_name, length(district) + 1)").alias("body"), F.explode("aliases").alias("alias"))
    shown = shown.where("alias LIKE concat(district, '__%')").groupBy("body").agg(F.array_sort(F.collect_set(F.expr("substring(alias, length(district) + 1)"))).alias("nicknames"))
    named = agencies.select("id", "district", "agency_name", "aliases", F.expr("CASE WHEN agency_name LIKE concat(district, '_%') THEN substring(agency_name, length(district) + 1) END").alias("body")).join(shown, "body", "left")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                keys, full = rewritings(r.district, r.agency_name, list(r.aliases) if r.aliases is not None else [], cities, {r.body: list(r.nicknames)} if r.nicknames is not None else {})
                rows += [(r.id, 0, k, k, "+".join(chain)) for k, chain in keys.items()]
                rows += [(r.id, 1, k, f, "error") for f in full for k in error_keys(f, longest)]
            yield pd.DataFrame(rows, columns=["agency_id", "level", "key", "form", "chain"])

    return named.select("id", "district", "agency_name", "aliases", "body", "nicknames").mapInPandas(work, "agency_id bigint, level int, key string, form string, chain string")


def parts_of(field: str) -> list[str]:
    return [p for p in _SEPARATORS.split(field) if solid(p)]


def _keys(longest: int):
    """(name, whole, part, level, key, form) of each distinct typed name: of the name as a whole and of its parts."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name in frame["name"]:
                parts = parts_of(name)
                for whole, part in ((True, name), *((False, p) for p in parts if len(parts) > 1)):
                    if k := key(part):
                        rows.append((name, whole, part, 0, k, k))
                    form = solid(part)
                    rows += [(name, whole, part, 1, k, form) for k in error_keys(form, longest) if k]
            yield pd.DataFrame(rows, columns=["name", "whole", "part", "level", "key", "form"])

    return work


def linked(names: DataFrame, agencies: DataFrame, *, longest: int = 120, shortest: int = 5) -> DataFrame:
    """(name, part, agency_id, score) of distinct ``names`` (name). ``shortest``: length of a form that may hold an error. An
    error's score is half its rarity: it is one rule more, and any."""
    typed = names.where("name IS NOT NULL AND trim(name) <> ''").select("name").distinct().repartition("name").mapInPandas(_keys(longest), "name string, whole boolean, part string, level int, key string, form string")
    reference = stage(_reference(agencies, longest), "names-reference")
    common = reference.groupBy("level", "key").agg(F.countDistinct("agency_id").alias("n_same"))
    chains = reference.join(common, ["level", "key"]).groupBy("level", "chain").agg(((F.count_if(F.col("n_same") == 1) + 1) / (F.count(F.lit(1)) + 2)).alias("alone"))
    forms = reference.join(common, ["level", "key"]).join(chains, ["level", "chain"]).withColumnRenamed("form", "meant")
    met = typed.join(forms, ["level", "key"]).where(f"level = 0 OR length(meant) >= {shortest}")
    near = F.pandas_udf(lambda a, b: pd.Series([one_error(x, y) for x, y in zip(a, b, strict=True)]), "boolean")
    candidates = met.select("name", "whole", "part", "level", "agency_id", "form", "meant", "n_same", "alone").distinct().where((F.col("level") == 0) | near("form", "meant"))
    rarity = F.col("alone") / F.col("n_same")
    score = F.when(F.col("level") == 0, rarity).otherwise(rarity / 2)
    scored = candidates.groupBy("name", "whole", "part", "agency_id").agg(F.max(score).alias("score"))
    by_part = Window.partitionBy("name", "whole", "part")
    best = scored.withColumn("best", F.max("score").over(by_part)).where("score = best").withColumn("n_best", F.count(F.lit(1)).over(by_part)).where("n_best = 1")
    by_name = Window.partitionBy("name")
    return best.withColumn("as_whole", F.max(F.col("whole").cast("int")).over(by_name)).where("whole = (as_whole = 1)").select("name", "part", "agency_id", "score")


def found(docs: DataFrame, findings: DataFrame, agencies: DataFrame) -> DataFrame:
    """(record_table, record_id, agency_id): fields that name an agency, but not letter for letter."""
    fields = docs.select(F.lit("policy_documents").alias("record_table"), F.col("id").cast("bigint").alias("record_id"), F.col("issuing_agency").alias("name")).unionByName(
        findings.where("rule_code LIKE 'AGENCY-%'").select(F.lit("rule_findings").alias("record_table"), F.col("id").cast("bigint").alias("record_id"), F.col("page_value").alias("name"))
    )
    links = linked(fields.select("name"), agencies)
    proper = agencies.select(F.col("id").alias("agency_id"), "agency_name")
    spelled = links.join(proper, "agency_id").where("part <> agency_name").select("name", "agency_id").distinct()
    return fields.join(spelled, "name").select("record_table", "record_id", "agency_id").distinct()
