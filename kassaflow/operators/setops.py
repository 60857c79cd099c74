"""Set operations used by result checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topn import top_n


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of only one side, counted as a bag: ``side`` is ``left`` or ``right``."""
    cols = a.columns
    return a.exceptAll(b.select(*cols)).withColumn("side", F.lit("left")).unionByName(b.select(*cols).exceptAll(a).withColumn("side", F.lit("right")))


def top_n_check(result: DataFrame, candidates: DataFrame, group: str, label: str, metric: str, n: int) -> DataFrame:
    """(group, n_found, n_wanted, n_certain, n_tied, valid): whether a top ``n`` is one of those that ties allow, per group.

    ``result`` has (group, label), ``candidates`` (group, label, metric), a row
    for each that may be chosen; labels may repeat. Candidates above the n-th
    metric are certain; of those tied with it any may fill what is left. A
    result is valid if it has as many rows as it can, every certain label as
    often as it is certain, and none more often than it may be. Null metrics
    don't take part; a null group or label is one like any other.
    """
    c = candidates.where(F.col(metric).isNotNull()).select(F.col(group).alias("g"), F.col(label).alias("l"), F.col(metric).alias("m"))
    # the n-th metric of each group; ties with it are only counted, never gathered
    last = top_n(c, ["g"], "m", n, ["l"]).groupBy("g").agg(F.min("m").alias("m_n"), F.count(F.lit(1)).alias("k"))
    counts = c.groupBy("g", "l", "m").agg(F.count(F.lit(1)).alias("n")).join(last.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h"))).where(F.col("m") >= F.col("m_n"))
    tied = (F.col("m") == F.col("m_n")) & (F.col("k") >= n)
    may = counts.groupBy("g", "l").agg(F.sum(F.when(tied, 0).otherwise(F.col("n"))).alias("certain"), F.sum(F.when(tied, F.col("n")).otherwise(0)).alias("tied"))
    got = result.groupBy(F.col(group).alias("g"), F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("found"))
    both = may.alias("a").join(got.alias("b"), F.col("a.g").eqNullSafe(F.col("b.g")) & F.col("a.l").eqNullSafe(F.col("b.l")), "full")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    fits = (zero("found") >= zero("certain")) & (zero("found") <= zero("certain") + zero("tied"))
    per = both.select(F.when(F.col("a.certain").isNotNull(), F.col("a.g")).otherwise(F.col("b.g")).alias(group), zero("found").alias("found"), zero("certain").alias("certain"), zero("tied").alias("tied"), fits.alias("fits"))
    out = per.groupBy(group).agg(F.sum("found").alias("n_found"), F.sum("certain").alias("n_certain"), F.sum("tied").alias("n_tied"), F.bool_and("fits").alias("fits"))
    wanted = F.least(F.lit(n).cast("long"), F.col("n_certain") + F.col("n_tied"))
    return out.select(group, "n_found", wanted.alias("n_wanted"), "n_certain", "n_tied", (F.col("fits") & (F.col("n_found") == wanted)).alias("valid"))
