"""Row predicates, registered by name, and the multi-way router."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_years(ts: Column | str, first: int, last: int) -> Column:
    """Years ``first``..``last``, both included, as a range that reaches the scan."""
    c = F.col(ts) if isinstance(ts, str) else ts
    low, high = datetime(max(first, 1), 1, 1), datetime(min(last, 9998) + 1, 1, 1)
    return (c >= F.lit(low)) & (c < F.lit(high))


def temporal(ts: Column | str, year_start: int = 0, year_end: int = 9999, hour_start: int = 0, hour_end: int = 23) -> Column:
    """Year and hour of day within bounds, all ends included; a null time doesn't pass.

    The whole last hour passes: ``hour_end=23`` lets 23:59:59 through.
    """
    c = F.col(ts) if isinstance(ts, str) else ts
    hours = F.hour(c).between(hour_start, hour_end) if (hour_start, hour_end) != (0, 23) else F.lit(True)
    return in_years(c, year_start, year_end) & hours


def min_amount(amount: Column | str, least: float | Decimal) -> Column:
    """``amount >= least``; null and text that is no number don't pass, NaN does.

    A ``Decimal`` bound is for decimal columns and reaches the scan.
    """
    c = F.col(amount) if isinstance(amount, str) else amount
    if isinstance(least, Decimal):
        return c >= F.lit(least)
    return c.try_cast("double") >= F.lit(float(least))


def everything() -> Column:
    """The predicate that passes every row."""
    return F.lit(True)


FILTERS: dict[str, Callable[..., Column]] = {"all": everything, "temporal": temporal, "amount": min_amount}


def make_filter(kind: str, *args, **kwargs) -> Column:
    """A registered predicate by name."""
    if kind not in FILTERS:
        raise ValueError(f"unknown filter {kind!r}; known: {sorted(FILTERS)}")
    return FILTERS[kind](*args, **kwargs)


def passes(df: DataFrame, *predicates: Column) -> DataFrame:
    """Rows that meet all predicates; none: every row."""
    for p in predicates:
        df = df.where(p)
    return df


def route(df: DataFrame, rules: dict[str, Column]) -> dict[str, DataFrame]:
    """One frame per rule over the same parent; a row goes to every rule it meets."""
    return {name: df.where(rule) for name, rule in rules.items()}


def route_tagged(df: DataFrame, rules: dict[str, Column], tag: str = "route") -> DataFrame:
    """``route`` in one pass over the input: a row per rule met, tagged with the rule's name."""
    met = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn(tag, F.explode(met))
