"""Top N of millions of groups by descending score bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.names import free_name
from ..session import table_bytes, written

#: The groups that rows of up to this size on disk have filled are broadcast; beyond it the anti-join is shuffled.
BROADCAST_BYTES = 4 << 20


def top_n_by_bands(df: DataFrame, groups: list[str], score: str, ties: list[Column], n: int, shares: tuple[float, ...] = (0.98, 0.85, 0.5)) -> DataFrame:
    """The ``n`` best rows of each group by ``score`` descending, then ``ties``.

    Rows that agree in every column are one (repeat deliveries): they are
    counted once. Rows with a null group column or a null score don't take
    part. ``ties`` should make the order total. Groups with fewer than ``n``
    rows give all they have; an empty table gives an empty one.

    The rows are written once, by score band (``shares`` are the quantiles
    between the bands; where they fall changes the work, never the result).
    Bands are processed from the top. In each, rows of groups that are filled
    already are anti-joined away before anything is shuffled; of the others
    repeats are dropped, combined on the map side, and the rest is ranked
    exactly: a group takes as many as it still lacks. Ranking cuts each map
    task to ``n`` rows per group before its exchange, so a group that holds a
    third of all rows, or of all ties, reaches no single task.
    """
    columns = df.columns
    band_name, rank, got = (free_name(columns, c) for c in ("__band", "__rank", "__n"))
    # of the score alone, so that nothing else is read or computed
    quantiles = df.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("s")).approxQuantile("s", list(shares), 0.005) if shares else []
    edges = sorted(set(quantiles), reverse=True)
    band = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        band = F.when(F.col(score) > e, F.lit(i)).otherwise(band)
    ok = F.col(score).isNotNull()
    for g in groups:
        ok = ok & F.col(g).isNotNull()
    banded = written(df.where(ok).withColumn(band_name, band), "bands", partition_by=[band_name])
    parts: list[DataFrame] = []
    for b in range(len(edges) + 1):
        now = banded.where(F.col(band_name) == b).select(*columns)
        have, small = None, True
        if parts:
            taken = parts[0]
            for p in parts[1:]:
                taken = taken.unionByName(p)
            have = taken.groupBy(*groups).agg(F.count(F.lit(1)).alias(got))
            filled = have.where(F.col(got) >= n).select(*groups)
            # the rows taken bound the groups that they fill
            small = sum(map(table_bytes, parts)) <= BROADCAST_BYTES
            if small:
                now = now.join(F.broadcast(filled), groups, "left_anti")
        ranked = now.distinct().withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc(score), *ties))).where(F.col(rank) <= n)
        if have is not None:
            # beyond a broadcast the groups are joined away once no group has more than n rows
            ranked = ranked if small else ranked.join(filled, groups, "left_anti")
            lacking = ranked.join(have.where(F.col(got) < n), groups, "left")
            ranked = lacking.where(F.col(rank) <= n - F.coalesce(F.col(got), F.lit(0))).drop(got)
        ranked = ranked.drop(rank)
        parts.append(written(ranked, f"band-{b}") if b < len(edges) else ranked)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
