"""Grouped totals; Spark splits each into a partial and a final aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import half_year_key, month_key


def monthly_item_totals(items: DataFrame) -> DataFrame:
    """Month and item: units sold and revenue.

    A row takes part as a whole or not at all: a null time, item, quantity or
    subtotal leaves it out.
    """
    ok = items.na.drop(subset=["created_at", "item_id", "quantity", "subtotal"])
    return ok.groupBy(month_key("created_at").alias("year_month_created_at"), "item_id").agg(F.sum("quantity").alias("sellings_qty"), F.sum("subtotal").alias("profit_sum"))


def half_year_store_totals(transactions: DataFrame) -> DataFrame:
    """Half-year and store: payment volume, rounded half up to cents."""
    ok = transactions.na.drop(subset=["created_at", "store_id", "final_amount"])
    return ok.groupBy(half_year_key("created_at").alias("year_half_created_at"), "store_id").agg(F.round(F.sum("final_amount"), 2).alias("tpv"))


def purchase_counts(transactions: DataFrame) -> DataFrame:
    """Store and user: number of purchases; users of blanks only don't count."""
    ok = transactions.where(F.trim("user_id") != "").na.drop(subset=["store_id"])
    return ok.groupBy("store_id", "user_id").agg(F.count(F.lit(1)).alias("purchases_qty"))


def merge_partials(partials: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Merge partial sums of replicas or batches; null parts count as nothing."""
    return partials.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


AGGREGATIONS = {"q2": monthly_item_totals, "q3": half_year_store_totals, "q4": purchase_counts}


def aggregate(mode: str, df: DataFrame) -> DataFrame:
    """An aggregation by its registered mode."""
    if mode not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {mode!r}; known: {sorted(AGGREGATIONS)}")
    return AGGREGATIONS[mode](df)
