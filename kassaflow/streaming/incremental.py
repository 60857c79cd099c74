"""Streams that end when the input is used up, and go on from their checkpoint after a stop.

The running aggregation is in complete mode: a watermark would hold back the
newest groups for ever on a bounded input; the others are partial results by
batch. Sinks are ``foreachBatch`` with a batch id, so a batch that is replayed
after a crash replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import month_key
from ..operators.aggs import half_year_store_totals, merge_partials, purchase_counts
from ..operators.clean import clean, require
from ..operators.dedup import distinct_on
from ..operators.filters import min_amount, passes, temporal
from ..operators.joins import lookup_stores, lookup_stores_users
from ..operators.redelivery import MessageStore
from ..operators.topn import sorted_by, top_n
from ..plans import sales
from ..schemas import spec
from ..session import _fs, remove, scratch_path


def stream_table(spark: SparkSession, root: str, table: str, files_per_batch: int = 8) -> DataFrame:
    """A stream over a Parquet table's files, a single file or a folder of parts."""
    path = f"{root}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        df = reader.parquet(path)
    else:
        df = reader.option("pathGlobFilter", f"{table}.parquet").parquet(root)
    return df


def run_to_end(df: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a streaming frame over all that is there now, then stop.

    After a failure the same call with the same checkpoint takes up at the
    batch that didn't end; batches that did are not read again.
    """
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(on_batch).start().awaitTermination()


def newest(spark: SparkSession, out: str) -> DataFrame | None:
    """The newest complete state below ``out``; a state that is being written isn't seen."""
    fs, p = _fs(spark, out)
    jvm = spark.sparkContext._jvm
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    done = [int(n[6:]) for n in names if n.startswith("state-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{out}/{n}/_SUCCESS"))]
    return spark.read.parquet(f"{out}/state-{max(done)}") if done else None


def monthly_items(stream: DataFrame, checkpoint: str, out: str) -> None:
    """Monthly totals per item as a running aggregate; ``newest(out)`` is its newest complete state.

    Each state has a folder of its own; the last but one stays for its readers.
    """
    ok = stream.na.drop(subset=["created_at", "item_id", "quantity", "subtotal"])
    totals = ok.groupBy(month_key("created_at").alias("year_month_created_at"), "item_id").agg(F.sum("quantity").alias("sellings_qty"), F.sum("subtotal").alias("profit_sum"))

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/state-{n}")
        if n >= 2:
            remove(batch.sparkSession, f"{out}/state-{n - 2}")

    run_to_end(totals, checkpoint, put, "complete")


def stream_monthly_items(spark: SparkSession, root: str) -> DataFrame:
    base = scratch_path(spark, "stream-items")
    monthly_items(clean(stream_table(spark, root, "transaction_items"), spec("transaction_items")), f"{base}/checkpoint", f"{base}/out")
    return newest(spark, f"{base}/out").withColumn("profit_sum", F.col("profit_sum").cast("double"))


def partials(stream: DataFrame, checkpoint: str, out: str, partial: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a stream to its end, each micro-batch giving ``partial`` of its rows; returns the partial rows of all.

    A batch's rows lie in a folder of its number, so one that is replayed after
    a stop replaces its own. No state grows with the stream; the parts are
    merged where the result is asked for.
    """

    def put(batch: DataFrame, n: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    run_to_end(stream, checkpoint, put)
    return stream.sparkSession.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch")


def stream_high_amounts(spark: SparkSession, root: str) -> DataFrame:
    """Q1 of a bounded stream: runs without repeats, merged and sorted."""
    base = scratch_path(spark, "stream-q1")

    def run(batch: DataFrame) -> DataFrame:
        kept = passes(batch, temporal("created_at", *sales.YEARS, *sales.HOURS), min_amount("final_amount", sales.LEAST_AMOUNT))
        return distinct_on(kept, ["transaction_id"], [F.asc("final_amount")]).select("transaction_id", "final_amount")

    runs = partials(_transactions(spark, root), f"{base}/checkpoint", f"{base}/out", run)
    return sorted_by(distinct_on(runs, ["transaction_id"], [F.asc("final_amount")]), "transaction_id")


def stream_half_year_volumes(spark: SparkSession, root: str) -> DataFrame:
    """Q3 of a bounded stream: totals per batch, merged and named."""
    base = scratch_path(spark, "stream-q3")
    parts = partials(_transactions(spark, root), f"{base}/checkpoint", f"{base}/out", lambda b: half_year_store_totals(passes(b, temporal("created_at", *sales.YEARS, *sales.HOURS))))
    totals = merge_partials(parts, ["year_half_created_at", "store_id"], ["tpv"])
    named = lookup_stores(totals, sales.from_parquet(spark, root)("stores"))
    return sorted_by(named.select("year_half_created_at", "store_name", "tpv"), "year_half_created_at", "store_name")


def stream_top_buyers(spark: SparkSession, root: str, n: int = 3) -> DataFrame:
    """Q4 of a bounded stream: counts per batch, merged, the top users named; with the counts."""
    base = scratch_path(spark, "stream-q4")

    def run(batch: DataFrame) -> DataFrame:
        return purchase_counts(require(passes(batch, temporal("created_at", *sales.YEARS)), ["user_id"]))

    parts = partials(_transactions(spark, root), f"{base}/checkpoint", f"{base}/out", run)
    top = top_n(merge_partials(parts, ["store_id", "user_id"], ["purchases_qty"]), ["store_id"], "purchases_qty", n, ["user_id"])
    t = sales.from_parquet(spark, root)
    named = lookup_stores_users(top, t("stores"), t("users"))
    return sorted_by(named.select("store_name", "birthdate", "purchases_qty"), "store_name", "birthdate")


def _transactions(spark: SparkSession, root: str) -> DataFrame:
    return clean(stream_table(spark, root, "transactions"), spec("transactions"))


def first_deliveries(stream: DataFrame, checkpoint: str, store: MessageStore, out: str) -> None:
    """Each micro-batch is one upsert into the message store; surplus deliveries go to ``out`` by batch.

    A batch that is replayed after a stop is known to the store by its number.
    """

    def put(batch: DataFrame, n: int) -> None:
        store.upsert(batch, n).write.mode("overwrite").parquet(f"{out}/batch={n}")

    run_to_end(stream, checkpoint, put)


def stream_first_deliveries(spark: SparkSession, root: str) -> DataFrame:
    base = scratch_path(spark, "stream-messages")
    store = MessageStore(spark, f"{base}/store", ["request_id", "data_type", "position"], "received_at", "delivery_id")
    first_deliveries(stream_table(spark, root, "receiver_messages"), f"{base}/checkpoint", store, f"{base}/out")
    return spark.read.parquet(f"{base}/out").select("delivery_id").distinct()
