"""The five result sets over point-of-sale tables."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggs import half_year_store_totals, monthly_item_totals, purchase_counts
from ..operators.clean import clean, require
from ..operators.dedup import distinct_on
from ..operators.filters import min_amount, passes, temporal
from ..operators.joins import lookup_items, lookup_stores, lookup_stores_users
from ..operators.setops import top_n_check
from ..operators.topn import sorted_by, top_n, top_n_metrics
from ..schemas import spec
from ..sources.readers import csv_typed, parquet

YEARS = (2024, 2025)
HOURS = (6, 23)
LEAST_AMOUNT = Decimal("75.00")

Tables = Callable[[str], DataFrame]


def from_parquet(spark: SparkSession, root: str) -> Tables:
    return lambda name: clean(parquet(spark, root, name), spec(name))


def from_csv(spark: SparkSession, root: str) -> Tables:
    return lambda name: clean(csv_typed(spark, root, name), spec(name))


def high_amounts(t: Tables) -> DataFrame:
    """Q1: transactions of at least 75 in the opening hours, one row per id (the smallest amount of repeats), by id."""
    kept = passes(t("transactions"), temporal("created_at", *YEARS, *HOURS), min_amount("final_amount", LEAST_AMOUNT))
    one = distinct_on(kept, ["transaction_id"], [F.asc("final_amount")])
    return sorted_by(one.select("transaction_id", "final_amount"), "transaction_id")


def item_totals(t: Tables) -> DataFrame:
    return monthly_item_totals(passes(t("transaction_items"), temporal("created_at", *YEARS)))


def top_items_by_quantity(t: Tables) -> DataFrame:
    """Q2a: the item sold most often in each month; the smaller item_id of a tie."""
    top = top_n(item_totals(t), ["year_month_created_at"], "sellings_qty", 1, ["item_id"])
    named = lookup_items(top, t("menu_items"))
    return sorted_by(named.select("year_month_created_at", "item_name", "sellings_qty"), "year_month_created_at")


def top_items_by_revenue(t: Tables) -> DataFrame:
    """Q2b: the item with the highest revenue in each month."""
    top = top_n(item_totals(t), ["year_month_created_at"], "profit_sum", 1, ["item_id"])
    named = lookup_items(top, t("menu_items"))
    return sorted_by(named.select("year_month_created_at", "item_name", "profit_sum"), "year_month_created_at")


def top_items_both(t: Tables) -> DataFrame:
    """Q2a and Q2b in one pass, in long form with the metric's tag."""
    top = top_n_metrics(item_totals(t), ["year_month_created_at"], {"sellings_qty": "quantity", "profit_sum": "subtotal"}, 1, ["item_id"])
    return lookup_items(top, t("menu_items")).select("year_month_created_at", "metric", "item_name", "sellings_qty", "profit_sum")


def half_year_volumes(t: Tables) -> DataFrame:
    """Q3: payment volume per half-year and store in the opening hours."""
    kept = passes(t("transactions"), temporal("created_at", *YEARS, *HOURS))
    named = lookup_stores(half_year_store_totals(kept), t("stores"))
    return sorted_by(named.select("year_half_created_at", "store_name", "tpv"), "year_half_created_at", "store_name")


def top_buyers(t: Tables, n: int = 3, with_ties: bool = False, counts: bool = False) -> DataFrame:
    """Q4: the birthdates of the users with most purchases in each store; ``counts`` adds their number."""
    kept = require(passes(t("transactions"), temporal("created_at", *YEARS)), ["transaction_id", "final_amount", "created_at", "store_id", "user_id"])
    top = top_n(purchase_counts(kept), ["store_id"], "purchases_qty", n, ["user_id"], with_ties)
    named = lookup_stores_users(top, t("stores"), t("users"))
    return sorted_by(named.select("store_name", "birthdate", *["purchases_qty"] * counts), "store_name", "birthdate")


def tie_check(t: Tables, n: int = 3) -> DataFrame:
    """Per store whether the top buyers are a choice that ties allow (``setops.top_n_check``)."""
    kept = require(passes(t("transactions"), temporal("created_at", *YEARS)), ["user_id"])
    candidates = top_n(purchase_counts(kept), ["store_id"], "purchases_qty", n, [], with_ties=True)
    named = lookup_stores_users(candidates, t("stores"), t("users"))
    return top_n_check(top_buyers(t, n), named, "store_name", "birthdate", "purchases_qty", n)


def run_all(t: Tables) -> dict[str, DataFrame]:
    return {"q1": high_amounts(t), "q2_a": top_items_by_quantity(t), "q2_b": top_items_by_revenue(t), "q3": half_year_volumes(t), "q4": top_buyers(t)}
