"""References to records that don't exist at the time of the row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import month_key
from ..session import written
from .names import free_name
from .skew import rows_with_keys, salted

_ALWAYS = "0001-01-01 00:00:00"


def lifetimes(parents: DataFrame, deletions: DataFrame) -> DataFrame:
    """(key, alive_from, alive_until): when each key has a living record; until is exclusive, null for ever.

    ``parents``: key, start (null: always). ``deletions``: key, deleted_at. A
    deletion ends every record of the key that started before it; one that
    starts at the deletion or later lives on. Null keys and null deletion times
    are ignored. Per key there is one interval per deletion and one after them.
    """
    p = parents.where(F.col("key").isNotNull()).select("key", F.coalesce("start", F.lit(_ALWAYS).cast("timestamp")).alias("start"))
    d = deletions.where(F.col("key").isNotNull() & F.col("deleted_at").isNotNull()).select("key", "deleted_at")
    gone = d.select("key").distinct()
    # keys without a deletion live from their first start on: an aggregate that combines on the map side
    whole = p.join(gone, "key", "left_anti").groupBy("key").agg(F.min("start").alias("alive_from")).withColumn("alive_until", F.lit(None).cast("timestamp"))
    starts = p.join(gone, "key", "left_semi").distinct().select("key", F.col("start").alias("t"), F.lit(0).alias("deletes"))
    ends = d.distinct().select("key", F.col("deleted_at").alias("t"), F.lit(1).alias("deletes"))
    # the next deletion strictly after a start: at equal times the start comes last in time order
    after = Window.partitionBy("key").orderBy(F.desc("t"), F.asc("deletes")).rowsBetween(Window.unboundedPreceding, -1)
    nexts = starts.unionByName(ends).withColumn("until", F.last(F.when(F.col("deletes") == 1, F.col("t")), ignorenulls=True).over(after)).where(F.col("deletes") == 0)
    ended = nexts.groupBy("key", F.col("until").alias("alive_until")).agg(F.min("t").alias("alive_from")).select("key", "alive_from", "alive_until")
    return whole.select("key", "alive_from", "alive_until").unionByName(ended)


def orphans(rows: DataFrame, alive: DataFrame) -> DataFrame:
    """Rows (key, t and any others) whose key has no living record at t.

    1. The distinct non-null keys with their first and last time (combined on
       the map side) are anti-joined with the lifetimes that cover both: what
       is left are keys that never existed or were dead at some time.
    2. Only rows of those keys are looked at one by one, by an anti-join with
       the lifetimes at their own time, hot keys over many tasks.

    Rows with null keys aren't references. A row with a null time can't be
    placed: it counts as an orphan only if its key never existed. Columns of
    ``rows`` other than key and t are kept, whatever their names.
    """
    refs = rows.where(F.col("key").isNotNull())
    keys = refs.groupBy("key").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("n"))
    k, since, until = (free_name(rows.columns, c) for c in ("k", "alive_from", "alive_until"))
    alive = written(alive.select(F.col("key").alias(k), F.col("alive_from").alias(since), F.col("alive_until").alias(until)), "lifetimes")

    def living(first: str, last: str):
        return (F.col("key") == F.col(k)) & (F.col(since) <= F.col(first)) & (F.col(until).isNull() | (F.col(last) < F.col(until)))

    suspects = written(keys.join(alive, living("t0", "t1"), "left_anti").select("key", "n"), "suspect-keys")
    total = suspects.agg(F.sum("n")).first()[0]
    lives = alive.join(suspects.withColumnRenamed("key", k), k, "left_semi")
    near = rows_with_keys(refs, suspects, "key", "n", total or 0)
    salt, other = free_name(rows.columns, "__salt"), free_name([*rows.columns, "__salt"], "__salt_of")
    near, lives = salted(near, lives, suspects, "key", "n", total or 0, k, salt)
    lives = lives.withColumnRenamed(salt, other)
    return near.join(lives, (F.col("key") == F.col(k)) & (F.col(salt) == F.col(other)) & (F.col("t").isNull() | living("t", "t")), "left_anti").drop(salt)


def report(orphan_rows: DataFrame) -> DataFrame:
    """Orphans per table and period: rows, and distinct keys."""
    per_key = orphan_rows.groupBy("table_name", month_key("t").alias("period"), "key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("table_name", "period").agg(F.sum("n").alias("orphan_rows"), F.count(F.lit(1)).alias("orphan_keys"))
