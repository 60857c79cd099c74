"""Joins that stand keys holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import table_bytes

#: A key is hot from a share of 1/HOT_SHARE of the rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000


#: Tasks over which the rows of a hot key are spread.
SALTS = 32


def salted(rows: DataFrame, others: DataFrame, keys: DataFrame, key: str, count: str, total: int, other_key: str, salt: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` and ``others`` with a column ``salt`` to join on beside the key, so that no hot key is one task.

    ``keys`` has the number of rows of each key. Rows of hot keys, at most
    ``HOT_SHARE`` by arithmetic, are spread by a hash of all their columns, and
    what they meet is repeated for each salt; the rest has the salt 0.
    """
    hot = F.broadcast(keys.where(F.col(count) >= max(2.0, total / HOT_SHARE)).select(F.col(key).alias("__hot")))
    spread = F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(SALTS))).otherwise(0).cast("int")
    left = rows.join(hot, F.col(key) == F.col("__hot"), "left").withColumn(salt, spread).drop("__hot")
    each = F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left, others.join(hot, F.col(other_key) == F.col("__hot"), "left").withColumn(salt, F.explode(each)).drop("__hot")


def rows_with_keys(rows: DataFrame, keys: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Rows whose key is in ``keys`` (distinct, with the number of rows of each).

    ``keys`` is a written table. If its files are below Spark's broadcast
    threshold, it is broadcast whole. Else the hot keys, at most ``HOT_SHARE``
    by arithmetic, are broadcast, and the rows of the others meet their keys in
    a shuffle that no single key can dominate. Rows with a null key don't come
    out.
    """
    spark = rows.sparkSession
    if table_bytes(keys) <= spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold():
        return rows.join(keys.select(key), key, "left_semi")
    bound = max(1.0, total / HOT_SHARE)
    hot = keys.where(F.col(count) >= bound).select(key)
    cold = keys.where(F.col(count) < bound).select(key)
    return rows.join(F.broadcast(hot), key, "left_semi").unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(cold, key, "left_semi"))
