"""The queries of this subpackage by name, and the SQL of those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifthall.llm import encode, leaks, lookalikes, names, near_copies, quality, residue, site_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.found(table(spark, sf_dir, "policy_documents"))


@query
def p1_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines its site repeats: (id, body_text)."""
    docs = table(spark, sf_dir, "policy_documents").select("id", "source_site", "body_text", "first_seen_at")
    return site_lines.cleaned(docs, site_lines.state_of(docs))


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.found(table(spark, sf_dir, "policy_documents"))


@query
def p2_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.consistent(table(spark, sf_dir, "policy_documents"), ["title", "page_document_number"])


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.found(table(spark, sf_dir, "policy_documents"), table(spark, sf_dir, "link_checks"))


@query
def p3_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with real content: (id)."""
    docs = table(spark, sf_dir, "policy_documents")
    return residue.content(docs.where("trim(body_text) <> ''"), residue.found(docs, table(spark, sf_dir, "link_checks")), "policy_documents").select("id")


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.found(*(table(spark, sf_dir, t) for t in ("policy_documents", "rule_findings", "agency_rules")))


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.found(table(spark, sf_dir, "policy_documents"))


@query
def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class of equal texts, and the number of other classes it is linked to."""
    links, members = near_copies.similar(near_copies.texts_of(table(spark, sf_dir, "policy_documents")))
    ends = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(ends, "class_id", "left").select("id", "class_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


@query
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encoded(table(spark, sf_dir, "documents"))


@query
def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.round_trip(table(spark, sf_dir, "documents"))


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query
def p8_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.reparameterised(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


@query
def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.described(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))
