"""Data quality of the project's tables: profiles, references, redelivery, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import folded_name, month_key, whole_number_text
from ..operators import profile as prof
from ..operators import records
from ..operators import references as refs
from ..operators.redelivery import MessageStore, first_deliveries
from ..session import scratch_path
from ..sources.readers import parquet, union_all

#: The columns whose loads are compared.
WATCHED = {
    "transactions": ["user_id", "store_id", "payment_method_id", "voucher_id", "discount_applied", "final_amount"],
    "transaction_items": ["quantity"],
    "q2b_profits": ["profit_sum"],
}
PATTERNS = {"transactions": {"user_id": prof.WHOLE_NUMBER}}


def profiles(spark: SparkSession, root: str, columns: dict[str, list[str] | None]) -> DataFrame:
    out = None
    for table, cols in columns.items():
        p = prof.profile(parquet(spark, root, table), "load_id", cols, PATTERNS.get(table)).withColumn("table_name", F.lit(table))
        out = p if out is None else out.unionByName(p)
    return out


def profiles_of(spark: SparkSession, root: str, table: str, columns: list[str], part: int) -> DataFrame:
    """The profile of one half of a table's rows, as two arrivals of a load give it."""
    half = parquet(spark, root, table)
    half = half.where(F.pmod(F.xxhash64(*columns), F.lit(2)) == part)
    return prof.profile(half, "load_id", columns, PATTERNS.get(table)).withColumn("table_name", F.lit(table))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Loads in which a watched column departs from its ordinary state."""
    d = prof.departures(profiles(spark, root, WATCHED), by=["table_name"])
    return d.where(F.col("departs") & F.col("load_id").isNotNull()).select("table_name", "column_name", "load_id")


def p1_profile(spark: SparkSession, root: str) -> DataFrame:
    """Every column of the three tables per load: rows, nulls, exact distincts, violations and ranges."""
    p = profiles(spark, root, {t: None for t in WATCHED})
    return p.select("table_name", "column_name", "load_id", "n_rows", "n_null", "n_distinct", "n_violations", "min_value", "max_value")


def p1_moments(spark: SparkSession, root: str) -> DataFrame:
    """Mean, standard deviation and shape of every watched column per load, from the power sums, with seven digits."""
    p = prof.moments(profiles(spark, root, WATCHED))
    return p.select("table_name", "column_name", "load_id", "s0", *[F.when(F.col(c).isNotNull() & ~F.isnan(c), F.format_string("%.6e", F.col(c))).alias(c) for c in ("mean", "sd", "skew", "kurt")])


def p1_power_sums(spark: SparkSession, root: str) -> DataFrame:
    """The exact sums of every watched column, its squares and its cubes per load, of profiles made apart and merged."""
    apart = [profiles_of(spark, root, table, cols, part) for table, cols in WATCHED.items() for part in (0, 1)]
    merged = prof.merge_profiles(*[p.withColumn("column_name", F.concat_ws(".", "table_name", "column_name")).drop("table_name") for p in apart])
    p = prof.power_sums(merged)
    name = F.split("column_name", "[.]")
    return p.select(name[0].alias("table_name"), name[1].alias("column_name"), "load_id", "n_rows", "n_null", "s0", *[F.col(f"s{i}").cast("decimal(38,6)").cast("string").alias(f"s{i}") for i in (1, 2, 3)])


#: The table that each reference names.
NAMES = {"transactions": "users", "transaction_items": "menu_items", "q4_candidates": "stores"}


def _tagged(table: str, key: Column) -> Column:
    """Keys of all referenced tables in one space; null stays null."""
    return F.concat(F.lit(f"{table}:"), key)


def parents(spark: SparkSession, root: str) -> DataFrame:
    """(key, start) of the three referenced tables."""
    users, items, stores = (parquet(spark, root, t) for t in ("users", "menu_items", "stores"))
    start = F.try_to_timestamp(F.nullif(F.trim("available_from"), F.lit("")), F.lit("yyyy-MM-dd"))
    return union_all(
        [
            users.select(_tagged("users", whole_number_text("user_id")).alias("key"), F.col("registered_at").alias("start")),
            items.select(_tagged("menu_items", whole_number_text("item_id")).alias("key"), start.alias("start")),
            stores.select(_tagged("stores", folded_name("store_name")).alias("key"), F.lit(None).cast("timestamp").alias("start")),
        ]
    )


def deletions(spark: SparkSession, root: str) -> DataFrame:
    d = parquet(spark, root, "key_deletions")
    key = F.when(F.col("ref_table") == "stores", folded_name("ref_key")).otherwise(whole_number_text("ref_key"))
    return d.select(F.concat(F.col("ref_table"), F.lit(":"), key).alias("key"), "deleted_at")


def references(spark: SparkSession, root: str) -> DataFrame:
    """(table_name, record_id, key, t) of all references."""
    columns = {
        "transactions": ("row_id", whole_number_text("user_id"), "created_at"),
        "transaction_items": ("row_id", whole_number_text("item_id"), "created_at"),
        "q4_candidates": ("candidate_id", folded_name("store_name"), "computed_at"),
    }
    return union_all([parquet(spark, root, t).select(F.lit(t).alias("table_name"), F.col(i).alias("record_id"), _tagged(NAMES[t], key).alias("key"), F.col(at).alias("t")) for t, (i, key, at) in columns.items()])


def orphan_rows(spark: SparkSession, root: str) -> DataFrame:
    return refs.orphans(references(spark, root), refs.lifetimes(parents(spark, root), deletions(spark, root)))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """References without a living record at the time of the row, once per record and month."""
    return orphan_rows(spark, root).select("table_name", "record_id", month_key("t").alias("period")).distinct()


def p2_report(spark: SparkSession, root: str) -> DataFrame:
    """Orphan rows and keys per table and month."""
    return refs.report(orphan_rows(spark, root))


def message_store(spark: SparkSession, path: str) -> MessageStore:
    return MessageStore(spark, path, ["request_id", "data_type", "position"], "received_at", "delivery_id")


def message_batches(spark: SparkSession, root: str, share: float = 0.8) -> list[DataFrame]:
    """The messages as a history and the batch that comes in after it, in order of landing."""
    m = parquet(spark, root, "receiver_messages")
    low, high = m.agg(F.min("delivery_id"), F.max("delivery_id")).first()
    if low is None:
        return [m, m]
    cut = low + int((high - low) * share)
    return [m.where(F.col("delivery_id") <= cut), m.where(F.col("delivery_id") > cut)]


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Surplus deliveries of the messages."""
    store = message_store(spark, scratch_path(spark, "messages"))
    return first_deliveries(store, message_batches(spark, root)).select("delivery_id")


def p3_kept(spark: SparkSession, root: str) -> DataFrame:
    """The deduplicated store after all batches."""
    store = message_store(spark, scratch_path(spark, "messages"))
    first_deliveries(store, message_batches(spark, root))
    return store.read().select("delivery_id", "request_id", "data_type", "position", "payload")


def p3_replayed(spark: SparkSession, root: str) -> DataFrame:
    """The store after three batches, of which the second comes again twice, without its number and with it."""
    a, b = message_batches(spark, root, 0.5)
    c, b = b.where("delivery_id % 2 = 0"), b.where("delivery_id % 2 <> 0")
    store = message_store(spark, scratch_path(spark, "messages"))
    first_deliveries(store, [a, b])
    store.upsert(b)
    first_deliveries(store, [b, c], 1)
    return store.read().select("delivery_id", "request_id", "data_type", "position", "payload")


def p5_parsed(spark: SparkSession, root: str) -> DataFrame:
    return records.parse_records(parquet(spark, root, "raw_rows"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Records that don't fit their table, with the reason."""
    return records.faulty(p5_parsed(spark, root)).select("raw_id", "reason")


def p5_loaded(spark: SparkSession, root: str) -> DataFrame:
    """Valid records as (raw_id, data_type, fields)."""
    return p5_parsed(spark, root).where(F.col("reason").isNull()).select("raw_id", "data_type", F.to_json("fields").alias("fields"))
