"""Distinct rows by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .names import free_name


def distinct_on(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the first by ``order``, which should be total.

    Null keys are a key like any other. The rank-1 limit is applied before the
    exchange too, so a key that holds a third of all rows is cut per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    name = free_name(df.columns, "__rank")
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) == 1).drop(name)


def dense_positions(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Consecutive numbers from 1 in the order of ``order``, without a global sort task.

    Rows are range-partitioned and sorted once. A row's place in its partition
    is the low part of ``monotonically_increasing_id``; to it comes the number
    of rows of the partitions before. Only the counts per partition reach the
    driver. Rows with equal keys fall into one range; their order among each
    other is arbitrary.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    i = free_name(df.columns, "__i")
    ranged = df.repartitionByRange(parts, *[F.col(c) for c in order]).sortWithinPartitions(*order)
    numbered = written(ranged.withColumn(i, F.monotonically_increasing_id()), "positions")
    counts = sorted((r[0], r[1]) for r in numbered.groupBy(F.shiftright(i, 33).alias("p")).agg(F.count(F.lit(1))).collect())
    before, total = {}, 0
    for part, n in counts:
        before[part], total = total, total + n
    if not before:
        return numbered.drop(i).withColumn(name, F.lit(None).cast("long"))
    offset = F.element_at(F.create_map(*[F.lit(int(x)).cast("long") for kv in before.items() for x in kv]), F.shiftright(i, 33))
    return numbered.withColumn(name, offset + F.col(i).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop(*{i} - {name})


def split_requests(df: DataFrame, order: list[str], requests: int = 2, name: str = "request_id") -> DataFrame:
    """Rows in the order of ``order`` as ``requests`` runs of equal length, numbered from 1; the first runs take what is over."""
    p = free_name(df.columns, "__position")
    numbered = dense_positions(df, order, p)
    n = numbered.count()
    size = max(1, -(-n // requests))
    return numbered.withColumn(name, (F.floor((F.col(p) - 1) / F.lit(size)) + 1).cast("long")).drop(p)
