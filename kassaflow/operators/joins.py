"""Lookup joins against dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import name_or_key
from ..session import written
from .names import free_name


def unique_keys(dim: DataFrame, key: str, value: str, last_by: list[Column] | None = None) -> DataFrame:
    """One row per key; of several the one that ``last_by`` puts last, else the greatest value.

    Null keys are dropped. Aggregates on the map side, so a key repeated in a
    third of all rows is no burden.
    """
    rows = dim.where(F.col(key).isNotNull())
    order = F.struct(*(last_by or []), F.col(value))
    return rows.groupBy(key).agg(F.max(order).alias("__o")).select(key, F.col(f"__o.{value}").alias(value))


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, last_by: list[Column] | None = None, keep_key: bool = False, few: bool = False) -> DataFrame:
    """Left join with a dimension; where it has no name, the key stands in for it.

    Repeated dimension keys don't multiply rows. With ``few`` the dimension is
    cut to the keys that ``df`` has before anything else is done with it; ``df``,
    which should be small against the dimension, is written for that. Either side is broadcast only if its size is below
    Spark's threshold, which adaptive execution checks at run time; else both
    are shuffled. A null key gives null.
    """
    k, v = free_name(df.columns, "__k"), free_name(df.columns, "__v")
    if few:
        df = written(df, "few")
        dim = dim.join(df.select(F.col(key).alias(k)).distinct(), F.col(key) == F.col(k), "left_semi")
    d = unique_keys(dim, key, value, last_by).select(F.col(key).alias(k), F.col(value).alias(v))
    out = df.join(d, F.col(key) == F.col(k), "left").withColumn(value, name_or_key(v, F.col(key).cast("string"))).drop(k, v)
    return out if keep_key else out.drop(key)


def lookup_items(totals: DataFrame, menu_items: DataFrame) -> DataFrame:
    return lookup(totals, menu_items, "item_id", "item_name")


def lookup_stores(totals: DataFrame, stores: DataFrame) -> DataFrame:
    return lookup(totals, stores, "store_id", "store_name")


def lookup_stores_users(tops: DataFrame, stores: DataFrame, users: DataFrame) -> DataFrame:
    return lookup(lookup(tops, stores, "store_id", "store_name"), users, "user_id", "birthdate", few=True)


LOOKUPS = {"q2": lookup_items, "q3": lookup_stores, "q4": lookup_stores_users}


def join(mode: str, *frames: DataFrame) -> DataFrame:
    """A lookup join by its registered mode."""
    if mode not in LOOKUPS:
        raise ValueError(f"unknown join {mode!r}; known: {sorted(LOOKUPS)}")
    return LOOKUPS[mode](*frames)
