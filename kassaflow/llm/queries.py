"""Queries on training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import folded_name
from . import encode, leaks, lookalikes
from .bands import top_n_by_bands


def _documents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text")


def _passages(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/eval_passages.parquet").select("eval_id", "passage")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """The three best buyers of each request and store."""
    c = spark.read.parquet(f"{root}/q4_candidates.parquet")
    rows = c.select("request_id", folded_name("store_name").alias("store"), "candidate_id", "purchases_qty", F.nullif("birthdate", F.lit("")).alias("birthdate"))
    top = top_n_by_bands(rows, ["request_id", "store"], "purchases_qty", [F.asc_nulls_last("birthdate"), F.asc("candidate_id")], 3)
    return top.select("request_id", "candidate_id")


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every text by byte_bpe_50k; null and empty texts have none."""
    return encode.encode(_documents(spark, root))


def p6_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, n_tokens, broken, same): every text encoded, decoded and compared, in one pass."""
    return encode.round_trip(_documents(spark, root))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents and the test items that they leak."""
    return leaks.leaked(_documents(spark, root), _passages(spark, root)).select("doc_id", "eval_id")


def p7_kept(spark: SparkSession, root: str) -> DataFrame:
    """The documents without leaks."""
    docs = _documents(spark, root)
    return leaks.without_leaks(docs, leaks.leaked(docs, _passages(spark, root))).select("doc_id")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of documents that look the same and differ in code points."""
    return lookalikes.same_looks(_documents(spark, root))


def p8_classes(spark: SparkSession, root: str) -> DataFrame:
    """Each document's class of those that look the same."""
    return lookalikes.class_members(_documents(spark, root))


def p8_links(spark: SparkSession, root: str) -> DataFrame:
    """The classes as pairs of a representative and each other text of its class."""
    return lookalikes.class_links(_documents(spark, root))


QUERIES = {f.__name__: f for f in (p4_found, p6_ids, p6_round_trip, p7_found, p7_kept, p8_found, p8_classes, p8_links)}
SQL: dict[str, str] = {
    "p4_found": r"""SELECT request_id, candidate_id FROM (
        SELECT request_id, candidate_id, row_number() OVER (PARTITION BY request_id, store ORDER BY purchases_qty DESC, birthdate ASC NULLS LAST, candidate_id) AS i FROM (
            SELECT DISTINCT request_id, candidate_id, nullif(lower(trim(regexp_replace(store_name, '\s+', ' ', 'g'))), '') AS store, purchases_qty, nullif(birthdate, '') AS birthdate FROM q4_candidates)
        WHERE request_id IS NOT NULL AND store IS NOT NULL AND purchases_qty IS NOT NULL) WHERE i <= 3""",
}
