"""Top N per group with a total order, and ordered output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import free_name


def top_n(df: DataFrame, groups: list[str], metric: str, n: int, ties: list[Column | str], with_ties: bool = False) -> DataFrame:
    """The ``n`` rows with the highest metric of each group.

    ``ties`` makes the order total. Null metrics don't take part. With
    ``with_ties`` every row tied with the last one stays. Spark cuts each map
    partition to the limit before the exchange (WindowGroupLimit), so a group
    that holds a third of all rows sends at most ``n`` rows per task.
    """
    w = Window.partitionBy(*groups).orderBy(F.desc(metric)) if with_ties else Window.partitionBy(*groups).orderBy(F.desc(metric), *ties)
    rank = (F.rank() if with_ties else F.row_number()).over(w)
    name = free_name(df.columns, "__rank")
    return df.where(F.col(metric).isNotNull()).withColumn(name, rank).where(F.col(name) <= n).drop(name)


def top_n_metrics(df: DataFrame, groups: list[str], metrics: dict[str, str], n: int, ties: list[Column | str], tag: str = "metric") -> DataFrame:
    """Top N for several metrics: long form, a row per metric, tagged.

    ``metrics`` maps column names to tags. Each metric is ranked in its own
    type, so exact sums of any length neither tie nor swap; its ranking cuts
    every map task to ``n`` rows per group, and the input's totals are computed
    once, as their exchange is shared.
    """
    parts = [top_n(df, groups, c, n, ties).withColumn(tag, F.lit(t)) for c, t in metrics.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sorted_by(df: DataFrame, *columns: str) -> DataFrame:
    """Ascending by code point for text, nulls first: a range exchange and an external sort."""
    return df.orderBy(*[F.asc_nulls_first(c) for c in columns])
