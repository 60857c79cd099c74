"""Queries by name, and plain SQL for those that SQL can express.

Each query takes (spark, folder) and returns a DataFrame over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import aggs, completeness, dedup, filters, joins, setops, topn
from ..operators.clean import clean, require
from ..schemas import COLUMNS, spec
from ..session import scratch_path
from ..sources import sinks
from ..sources.readers import parquet, pipe_records, scan_directory, union_all
from ..streaming import incremental
from . import quality, sales
from .quality_sql import SQL as QUALITY_SQL
from .requests import Requests

Query = Callable[[SparkSession, str], DataFrame]


def _double(df: DataFrame, *columns: str) -> DataFrame:
    """Exact decimals as doubles at the edge, after all sums."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _tx(s: SparkSession, d: str) -> DataFrame:
    return clean(parquet(s, d, "transactions"), spec("transactions"))


def _items(s: SparkSession, d: str) -> DataFrame:
    return clean(parquet(s, d, "transaction_items"), spec("transaction_items"))


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _rules() -> dict:
    return {
        "day": filters.temporal("created_at", 2024, 2025, 6, 23),
        "any": filters.temporal("created_at", 2024, 2025),
        "large": filters.temporal("created_at", 2024, 2025, 6, 23) & filters.min_amount("final_amount", 75),
    }


def _messages(s: SparkSession, d: str) -> DataFrame:
    m = parquet(s, d, "receiver_messages").where((F.col("msg_type") == 1) & (F.col("data_type") == 1))
    return pipe_records(m, "payload", ["transaction_id", "final_amount", "created_at", "store_id", "user_id"])


def _positions(s: SparkSession, d: str) -> DataFrame:
    """Dense numbers over distinct transaction ids, in their order."""
    return dedup.dense_positions(parquet(s, d, "transactions").select("transaction_id").where(F.col("transaction_id").isNotNull()).distinct(), ["transaction_id"])


def _distinct_lines(s: SparkSession, d: str) -> DataFrame:
    line = parquet(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_shipdate")
    return _ntz(dedup.distinct_on(line, ["l_orderkey", "l_linenumber"], ["l_extendedprice", "l_partkey", "l_suppkey", "l_shipdate"]), "l_shipdate")


def _merged_partials(s: SparkSession, d: str) -> DataFrame:
    """Partial totals per load, merged: what replicas or batches write."""
    parts = _items(s, d).withColumn("replica", F.pmod(F.xxhash64("item_id", "created_at"), F.lit(3))).na.drop(subset=["created_at"])
    partial = parts.groupBy("replica", K.month_key("created_at").alias("year_month_created_at"), "item_id").agg(F.sum("quantity").alias("sellings_qty"), F.sum("subtotal").alias("profit_sum"))
    return _double(aggs.merge_partials(partial, ["year_month_created_at", "item_id"], ["sellings_qty", "profit_sum"]), "profit_sum")


def _differences(s: SparkSession, d: str) -> DataFrame:
    """Transactions' user ids against the users table, both ways, as bags."""
    a = parquet(s, d, "transactions").select(K.whole_number_text("user_id").alias("user_id")).where(F.col("user_id").isNotNull())
    b = parquet(s, d, "users").select(K.whole_number_text("user_id").alias("user_id")).where(F.col("user_id").isNotNull())
    return setops.differences(a, b)


def _lookup_fallback(s: SparkSession, d: str) -> DataFrame:
    """Totals per item against the menu: items that aren't on it show their key."""
    totals = _items(s, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return joins.lookup_items(totals, clean(parquet(s, d, "menu_items"), spec("menu_items"))).groupBy("item_name").agg(F.sum("n").alias("n"))


def _scalars(s: SparkSession, d: str) -> DataFrame:
    t = parquet(s, d, "transactions")
    return t.select(
        "row_id",
        K.month_key("created_at").alias("month"),
        K.half_year_key("created_at").alias("half"),
        F.year("created_at").alias("year"),
        F.hour("created_at").alias("hour"),
        K.canonical_id("user_id").alias("user_id"),
        K.lenient_long("store_id").alias("store"),
        K.round_half_up(F.col("final_amount") * F.lit(3) / F.lit(8), 2).cast("double").alias("rounded"),
        K.fixed_places("final_amount", 2).alias("amount_text"),
        F.concat_ws("|", F.split("transaction_id", "-")).alias("id_parts"),
    )


def _from_csv(s: SparkSession, d: str) -> DataFrame:
    """The half-year volumes over delimited files that were written from the tables."""
    root = scratch_path(s, "csv")
    for table in ("transactions", "stores"):
        sinks.write_table_files(parquet(s, d, table).select(*COLUMNS[table]), root, table)
    return _double(sales.half_year_volumes(sales.from_csv(s, root)), "tpv")


def _from_named_files(s: SparkSession, d: str) -> DataFrame:
    """Rows and distinct ids by table of files whose names only begin with a table's, in any case and folder."""
    root = scratch_path(s, "named")
    names = {"users": "Users202401", "stores": "archive/stores-2024", "menu_items": "MENU_ITEMS_sample", "transaction_items": "Transaction_Items_202401", "transactions": "sub/transactions2024"}
    for table, name in names.items():
        sinks.write_table_files(parquet(s, d, table).select(*COLUMNS[table]), root, table, name)
    sinks.write_table_files(parquet(s, d, "stores").select(*COLUMNS["stores"]), root, "stores", "other_stores")
    key = {"users": "user_id", "stores": "store_id", "menu_items": "item_id", "transaction_items": "item_id", "transactions": "transaction_id"}
    return union_all([df.agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n"), F.count_distinct(key[t]).alias("ids")) for t, df in scan_directory(s, root)])


def _json_dump(s: SparkSession, d: str) -> DataFrame:
    """Users in two requests, dumped as JSON and read again."""
    path = scratch_path(s, "json")
    users = parquet(s, d, "users").select("user_id", "birthdate").where(F.col("user_id").isNotNull()).distinct()
    sinks.write_json(dedup.split_requests(users, ["user_id", "birthdate"]), path)
    return s.read.schema("user_id string, birthdate string, request_id long").json(path)


def _csv_read_back(s: SparkSession, d: str) -> DataFrame:
    """The half-year volumes as a client's CSV file, read as text again."""
    path = scratch_path(s, "result")
    sinks.write_csv(sales.half_year_volumes(sales.from_parquet(s, d)), path, single_file=True, decimals={"tpv": 2})
    return s.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def _requests(s: SparkSession, d: str) -> DataFrame:
    """Two requests for all results, the first cut off and cleaned away, the second delivered: rows by result."""
    r = Requests(s, scratch_path(s, "requests"))
    lost = r.accept()
    kept = r.accept()
    paths = r.run(kept, sales.from_parquet(s, d))
    if r.clean_up() != [lost]:
        raise RuntimeError("the request that was cut off is the one to clean up")
    return union_all([s.read.option("header", True).csv(p).agg(F.lit(kept).cast("long").alias("request_id"), F.lit(n).alias("result"), F.count(F.lit(1)).alias("n")) for n, p in paths.items()])


def _restarted(s: SparkSession, d: str) -> DataFrame:
    """Monthly totals of a stream that is lost in its sink and taken up again from its checkpoint."""
    base = scratch_path(s, "restarted")
    lost = []

    def partial(batch: DataFrame) -> DataFrame:
        if not lost:
            lost.append(True)
            raise RuntimeError("lost on purpose")
        return aggs.monthly_item_totals(batch)

    def run() -> DataFrame:
        items = clean(incremental.stream_table(s, d, "transaction_items", 1), spec("transaction_items"))
        return incremental.partials(items, f"{base}/checkpoint", f"{base}/out", partial)

    try:
        run()
    except Exception:
        if not lost:
            raise
    return _double(aggs.merge_partials(run(), ["year_month_created_at", "item_id"], ["sellings_qty", "profit_sum"]), "profit_sum")


def _positions_of(df: DataFrame, *order: str) -> DataFrame:
    """A result with the position that each row has in its order."""
    return dedup.dense_positions(df, list(order))


def _weekends(df: DataFrame) -> DataFrame:
    """A stage of a user's own, as ``DataFrame.transform`` takes it."""
    return df.where(F.dayofweek("created_at").isin(1, 7))


def _streams(s: SparkSession, d: str) -> DataFrame:
    return completeness.stream_completeness(parquet(s, d, "receiver_messages"))


QUERIES: dict[str, Query] = {
    # the five result sets
    "q1_high_amounts": lambda s, d: _double(sales.high_amounts(sales.from_parquet(s, d)), "final_amount"),
    "q2a_top_items_by_quantity": lambda s, d: sales.top_items_by_quantity(sales.from_parquet(s, d)),
    "q2b_top_items_by_revenue": lambda s, d: _double(sales.top_items_by_revenue(sales.from_parquet(s, d)), "profit_sum"),
    "q3_half_year_volumes": lambda s, d: _double(sales.half_year_volumes(sales.from_parquet(s, d)), "tpv"),
    "q4_top_buyers": lambda s, d: sales.top_buyers(sales.from_parquet(s, d)),
    "q4_top_buyers_counts": lambda s, d: sales.top_buyers(sales.from_parquet(s, d), counts=True),
    "q4_top_buyers_with_ties": lambda s, d: sales.top_buyers(sales.from_parquet(s, d), with_ties=True, counts=True),
    "q3_from_csv": _from_csv,
    "q3_from_named_files": _from_named_files,
    "q4_tie_check": lambda s, d: sales.tie_check(sales.from_parquet(s, d)),
    "q1_ordered": lambda s, d: _double(_positions_of(sales.high_amounts(sales.from_parquet(s, d)), "transaction_id"), "final_amount"),
    "q2a_ordered": lambda s, d: _positions_of(sales.top_items_by_quantity(sales.from_parquet(s, d)), "year_month_created_at"),
    "q3_ordered": lambda s, d: _double(_positions_of(sales.half_year_volumes(sales.from_parquet(s, d)), "year_half_created_at", "store_name"), "tpv"),
    "q3_csv_read_back": _csv_read_back,
    "q3_as_text": lambda s, d: sinks.as_text(sales.half_year_volumes(sales.from_parquet(s, d)), {"tpv": 1}),
    "request_results": _requests,
    # single operators
    "filter_everything": lambda s, d: parquet(s, d, "events").where(filters.make_filter("all")).select("event_id"),
    "custom_stage": lambda s, d: _tx(s, d).transform(_weekends).transform(filters.passes, filters.min_amount("final_amount", 75)).select("transaction_id", F.col("final_amount").cast("double").alias("final_amount")),
    "join_by_mode": lambda s, d: _double(joins.join("q3", aggs.aggregate("q3", _tx(s, d)), clean(parquet(s, d, "stores"), spec("stores"))), "tpv"),
    "clean_transactions": lambda s, d: _ntz(_double(_tx(s, d), "final_amount"), "created_at"),
    "clean_items": lambda s, d: _ntz(_double(_items(s, d), "subtotal"), "created_at"),
    "clean_users": lambda s, d: clean(parquet(s, d, "users"), spec("users")),
    "clean_stores": lambda s, d: clean(parquet(s, d, "stores"), spec("stores")),
    "clean_menu_items": lambda s, d: clean(parquet(s, d, "menu_items"), spec("menu_items")),
    "drop_anonymous": lambda s, d: require(_tx(s, d), ["user_id"]).select("transaction_id", "user_id"),
    "filter_temporal": lambda s, d: parquet(s, d, "events").where(filters.make_filter("temporal", "ts", 2024, 2025, 6, 23)).select("event_id"),
    "filter_amount": lambda s, d: parquet(s, d, "events").where(filters.make_filter("amount", "value", 75)).select("event_id", "value"),
    "route_fanout": lambda s, d: filters.route_tagged(parquet(s, d, "transactions"), _rules()).groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids")),
    "agg_monthly_items": lambda s, d: _double(aggs.aggregate("q2", _items(s, d)), "profit_sum"),
    "agg_half_year_stores": lambda s, d: _double(aggs.aggregate("q3", _tx(s, d)), "tpv"),
    "agg_purchase_counts": lambda s, d: aggs.aggregate("q4", _tx(s, d)),
    "agg_merge_partials": _merged_partials,
    "top_items_both": lambda s, d: _double(sales.top_items_both(sales.from_parquet(s, d)), "profit_sum"),
    "distinct_on_first": _distinct_lines,
    "dense_positions": _positions,
    "split_requests_json": _json_dump,
    "lookup_fallback": _lookup_fallback,
    "union_all_parts": lambda s, d: union_all([parquet(s, d, "orders").where(F.col("o_orderkey") % 2 == i).select("o_orderkey", "o_totalprice") for i in (0, 1)]),
    "set_differences": _differences,
    "scalar_functions": _scalars,
    "pipe_records": _messages,
    "stream_completeness": lambda s, d: _ntz(_streams(s, d), "completed_at"),
    "request_completeness": lambda s, d: completeness.request_completeness(_streams(s, d)),
    "late_messages": lambda s, d: completeness.late_messages(parquet(s, d, "receiver_messages"), _streams(s, d)),
    "stream_monthly_items": incremental.stream_monthly_items,
    "stream_first_deliveries": incremental.stream_first_deliveries,
    "stream_q1": lambda s, d: _double(incremental.stream_high_amounts(s, d), "final_amount"),
    "stream_q3": lambda s, d: _double(incremental.stream_half_year_volumes(s, d), "tpv"),
    "stream_q4": incremental.stream_top_buyers,
    "stream_restarted": _restarted,
    # data quality
    "p1_found": quality.p1_found,
    "p1_profile": quality.p1_profile,
    "p1_moments": quality.p1_moments,
    "p1_power_sums": quality.p1_power_sums,
    "p2_found": quality.p2_found,
    "p2_report": quality.p2_report,
    "p3_found": quality.p3_found,
    "p3_kept": quality.p3_kept,
    "p3_replayed": quality.p3_replayed,
    "p5_found": quality.p5_found,
    "p5_loaded": quality.p5_loaded,
}

_NUM = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
_ID = f"coalesce(CASE WHEN regexp_matches(trim(user_id), {_NUM}) THEN CAST(CAST(trunc(CAST(trim(user_id) AS DOUBLE)) AS BIGINT) AS VARCHAR) END, nullif(user_id, ''))"
_TX = f"SELECT transaction_id, final_amount, created_at, store_id, {_ID} AS user_id FROM transactions WHERE transaction_id <> '' AND final_amount IS NOT NULL AND created_at IS NOT NULL AND store_id <> ''"
_IT = "SELECT item_id, quantity, subtotal, created_at FROM transaction_items WHERE item_id <> '' AND quantity IS NOT NULL AND subtotal IS NOT NULL AND created_at IS NOT NULL"
_US = f"SELECT {_ID} AS user_id, birthdate FROM users WHERE user_id <> '' AND birthdate <> ''"
_YEARS = "created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2026-01-01'"
_DAY = f"{_YEARS} AND hour(created_at) BETWEEN 6 AND 23"
_MONTH = "strftime(created_at, '%Y-%m')"
_HALF = "strftime(created_at, '%Y') || CASE WHEN month(created_at) <= 6 THEN '-H1' ELSE '-H2' END"
_ST = "(SELECT store_id, max(store_name) AS store_name FROM stores WHERE store_id <> '' AND store_name <> '' GROUP BY 1)"
_ME = "(SELECT item_id, max(item_name) AS item_name FROM menu_items WHERE item_id <> '' AND item_name <> '' GROUP BY 1)"
_BI = f"(SELECT user_id, max(birthdate) AS birthdate FROM ({_US}) GROUP BY 1)"
_TOTALS = f"SELECT {_MONTH} AS year_month_created_at, item_id, CAST(sum(quantity) AS BIGINT) AS sellings_qty, CAST(sum(subtotal) AS DOUBLE) AS profit_sum FROM ({_IT}) WHERE {_YEARS} GROUP BY 1, 2"


def _top(metric: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY year_month_created_at ORDER BY {metric} DESC, item_id) AS i FROM ({_TOTALS})"


def _buyers(rank: str, order: str) -> str:
    return f"""SELECT coalesce(store_name, t.store_id) AS store_name, coalesce(birthdate, t.user_id) AS birthdate, purchases_qty FROM (
        SELECT *, {rank}() OVER (PARTITION BY store_id ORDER BY purchases_qty DESC{order}) AS i FROM (
            SELECT store_id, user_id, count(*) AS purchases_qty FROM ({_TX}) WHERE {_YEARS} AND trim(user_id) <> '' GROUP BY 1, 2)) t
        LEFT JOIN {_ST} s ON t.store_id = s.store_id LEFT JOIN {_BI} b ON t.user_id = b.user_id WHERE i <= 3"""


_STREAMS = """WITH firsts AS (SELECT request_id, data_type, msg_type, position, min(received_at) AS came FROM receiver_messages WHERE position IS NOT NULL AND msg_type IN (1, 2) GROUP BY ALL),
ends AS (SELECT request_id, data_type, min(position) AS end_position, arg_min(came, position) AS end_came FROM firsts WHERE msg_type = 2 GROUP BY ALL),
counted AS (SELECT request_id, data_type, end_position, count(f.position) AS n_positions, max(f.came) AS data_came, max(end_came) AS end_came
    FROM (SELECT DISTINCT request_id, data_type FROM firsts) LEFT JOIN ends USING (request_id, data_type)
    LEFT JOIN (SELECT * FROM firsts WHERE msg_type = 1 AND position >= 1) f USING (request_id, data_type) WHERE end_position IS NULL OR f.position IS NULL OR f.position < end_position GROUP BY 1, 2, 3),
streams AS (SELECT request_id, data_type, end_position, n_positions, end_position - 1 - n_positions AS n_missing, coalesce(end_position - 1 = n_positions, false) AS complete,
    CASE WHEN end_position - 1 = n_positions THEN greatest(data_came, end_came) END AS completed_at FROM counted)
"""

SQL: dict[str, str] = {
    "stream_completeness": _STREAMS + "SELECT * FROM streams",
    "request_completeness": _STREAMS + "SELECT request_id, CAST(sum(complete::INT) AS BIGINT) AS n_complete, sum(complete::INT) >= 5 AS complete FROM streams GROUP BY 1",
    "late_messages": _STREAMS + "SELECT delivery_id, request_id, data_type FROM receiver_messages JOIN streams USING (request_id, data_type) WHERE complete AND received_at > completed_at",
    "q1_high_amounts": f"SELECT transaction_id, CAST(min(final_amount) AS DOUBLE) AS final_amount FROM ({_TX}) WHERE {_DAY} AND final_amount >= 75 GROUP BY 1 ORDER BY 1",
    "q2a_top_items_by_quantity": f"SELECT year_month_created_at, coalesce(item_name, t.item_id) AS item_name, sellings_qty FROM ({_top('sellings_qty')}) t LEFT JOIN {_ME} m ON t.item_id = m.item_id WHERE i = 1 ORDER BY 1",
    "q2b_top_items_by_revenue": f"SELECT year_month_created_at, coalesce(item_name, t.item_id) AS item_name, profit_sum FROM ({_top('profit_sum')}) t LEFT JOIN {_ME} m ON t.item_id = m.item_id WHERE i = 1 ORDER BY 1",
    "q3_half_year_volumes": f"SELECT year_half_created_at, coalesce(store_name, t.store_id) AS store_name, tpv FROM (SELECT {_HALF} AS year_half_created_at, store_id, CAST(sum(final_amount) AS DOUBLE) AS tpv FROM ({_TX}) WHERE {_DAY} GROUP BY 1, 2) t LEFT JOIN {_ST} s ON t.store_id = s.store_id ORDER BY 1, 2",
    "q4_top_buyers": f"SELECT store_name, birthdate FROM ({_buyers('row_number', ', user_id')}) ORDER BY 1, 2",
    "q4_top_buyers_counts": _buyers("row_number", ", user_id"),
    "q4_top_buyers_with_ties": _buyers("rank", ""),
    "clean_transactions": f"SELECT transaction_id, CAST(final_amount AS DOUBLE) AS final_amount, created_at, store_id, user_id FROM ({_TX})",
    "clean_items": f"SELECT item_id, quantity, CAST(subtotal AS DOUBLE) AS subtotal, created_at FROM ({_IT})",
    "clean_users": _US,
    "clean_stores": "SELECT store_id, store_name FROM stores WHERE store_id <> '' AND store_name <> ''",
    "clean_menu_items": "SELECT item_id, item_name FROM menu_items WHERE item_id <> '' AND item_name <> ''",
    "drop_anonymous": f"SELECT transaction_id, user_id FROM ({_TX}) WHERE user_id <> ''",
    "filter_temporal": "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2026-01-01' AND hour(ts) BETWEEN 6 AND 23",
    "filter_amount": "SELECT event_id, value FROM events WHERE value >= 75",
    "route_fanout": f"SELECT route, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM (SELECT 'day' AS route, row_id FROM transactions WHERE {_DAY} UNION ALL SELECT 'any', row_id FROM transactions WHERE {_YEARS} UNION ALL SELECT 'large', row_id FROM transactions WHERE {_DAY} AND final_amount >= 75) GROUP BY 1",
    "agg_monthly_items": f"SELECT {_MONTH} AS year_month_created_at, item_id, CAST(sum(quantity) AS BIGINT) AS sellings_qty, CAST(sum(subtotal) AS DOUBLE) AS profit_sum FROM ({_IT}) GROUP BY 1, 2",
    "agg_half_year_stores": f"SELECT {_HALF} AS year_half_created_at, store_id, CAST(sum(final_amount) AS DOUBLE) AS tpv FROM ({_TX}) GROUP BY 1, 2",
    "agg_purchase_counts": f"SELECT store_id, user_id, count(*) AS purchases_qty FROM ({_TX}) WHERE trim(user_id) <> '' GROUP BY 1, 2",
    "agg_merge_partials": f"SELECT {_MONTH} AS year_month_created_at, item_id, CAST(sum(quantity) AS BIGINT) AS sellings_qty, CAST(sum(subtotal) AS DOUBLE) AS profit_sum FROM ({_IT}) GROUP BY 1, 2",
    "top_items_both": f"""SELECT year_month_created_at, metric, coalesce(item_name, t.item_id) AS item_name, sellings_qty, profit_sum FROM (
        SELECT *, 'quantity' AS metric FROM ({_top("sellings_qty")}) UNION ALL SELECT *, 'subtotal' FROM ({_top("profit_sum")})) t LEFT JOIN {_ME} m ON t.item_id = m.item_id WHERE i = 1""",
    "distinct_on_first": "SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice, l_partkey, l_suppkey, l_shipdate) AS i FROM lineitem) WHERE i = 1",
    "dense_positions": "SELECT transaction_id, row_number() OVER (ORDER BY transaction_id) AS position FROM (SELECT DISTINCT transaction_id FROM transactions WHERE transaction_id IS NOT NULL)",
    "split_requests_json": """WITH u AS (SELECT DISTINCT user_id, birthdate FROM users WHERE user_id IS NOT NULL)
        SELECT user_id, birthdate, CAST((row_number() OVER (ORDER BY user_id, birthdate NULLS FIRST) - 1) // CAST(ceil((SELECT count(*) FROM u) / 2.0) AS BIGINT) AS BIGINT) + 1 AS request_id FROM u""",
    "lookup_fallback": f"SELECT coalesce(item_name, t.item_id) AS item_name, CAST(sum(n) AS BIGINT) AS n FROM (SELECT item_id, count(*) AS n FROM ({_IT}) GROUP BY 1) t LEFT JOIN (SELECT item_id, max(item_name) AS item_name FROM menu_items WHERE item_id <> '' AND item_name <> '' GROUP BY 1) m ON t.item_id = m.item_id GROUP BY 1",
    "union_all_parts": "SELECT o_orderkey, o_totalprice FROM orders",
    "set_differences": f"""WITH a AS (SELECT {_ID} AS user_id FROM transactions WHERE regexp_matches(trim(user_id), {_NUM})), b AS (SELECT {_ID} AS user_id FROM users WHERE regexp_matches(trim(user_id), {_NUM}))
        SELECT user_id, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT user_id, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
    "scalar_functions": f"""SELECT row_id, {_MONTH} AS month, {_HALF} AS half, CAST(year(created_at) AS INTEGER) AS year, CAST(hour(created_at) AS INTEGER) AS hour,
        coalesce(CASE WHEN regexp_matches(trim(user_id), {_NUM}) THEN CAST(CAST(trunc(CAST(trim(user_id) AS DOUBLE)) AS BIGINT) AS VARCHAR) END, user_id) AS user_id,
        CASE WHEN regexp_matches(trim(store_id), '^[+-]?[0-9]+$') THEN CAST(store_id AS BIGINT) END AS store, CAST(round(final_amount * 3 * 0.125, 2) AS DOUBLE) AS rounded, CAST(final_amount AS VARCHAR) AS amount_text, replace(transaction_id, '-', '|') AS id_parts FROM transactions""",
    "pipe_records": """SELECT nullif(p[1], '') AS transaction_id, nullif(p[2], '') AS final_amount, nullif(p[3], '') AS created_at, nullif(p[4], '') AS store_id, nullif(p[5], '') AS user_id
        FROM (SELECT string_split(payload, '|') AS p FROM receiver_messages WHERE msg_type = 1 AND data_type = 1 AND trim(payload) <> '') WHERE len(p) >= 5""",
    "stream_monthly_items": f"SELECT {_MONTH} AS year_month_created_at, item_id, CAST(sum(quantity) AS BIGINT) AS sellings_qty, CAST(sum(subtotal) AS DOUBLE) AS profit_sum FROM ({_IT}) GROUP BY 1, 2",
    "stream_first_deliveries": QUALITY_SQL["p3_found"],
} | QUALITY_SQL
SQL |= {
    "p3_replayed": SQL["p3_kept"],
    "q3_from_csv": SQL["q3_half_year_volumes"],
    "stream_q1": SQL["q1_high_amounts"],
    "stream_q3": SQL["q3_half_year_volumes"],
    "stream_q4": SQL["q4_top_buyers_counts"],
    "stream_restarted": SQL["agg_monthly_items"],
    "q1_ordered": f"SELECT *, row_number() OVER (ORDER BY transaction_id) AS position FROM ({SQL['q1_high_amounts']})",
    "q2a_ordered": f"SELECT *, row_number() OVER (ORDER BY year_month_created_at) AS position FROM ({SQL['q2a_top_items_by_quantity']})",
    "q3_ordered": f"SELECT *, row_number() OVER (ORDER BY year_half_created_at, store_name) AS position FROM ({SQL['q3_half_year_volumes']})",
    "q3_csv_read_back": f"SELECT year_half_created_at, store_name, CAST(CAST(tpv AS DECIMAL(18, 2)) AS VARCHAR) AS tpv FROM ({SQL['q3_half_year_volumes']})",
    "q3_as_text": f"SELECT year_half_created_at, store_name, CAST(round(CAST(tpv AS DECIMAL(18, 2)), 1) AS VARCHAR) AS tpv FROM ({SQL['q3_half_year_volumes']})",
    "q3_from_named_files": """SELECT 'users' AS table_name, count(*) AS n, count(DISTINCT nullif(user_id, '')) AS ids FROM users UNION ALL SELECT 'stores', count(*), count(DISTINCT nullif(store_id, '')) FROM stores
        UNION ALL SELECT 'menu_items', count(*), count(DISTINCT nullif(item_id, '')) FROM menu_items UNION ALL SELECT 'transaction_items', count(*), count(DISTINCT nullif(item_id, '')) FROM transaction_items
        UNION ALL SELECT 'transactions', count(*), count(DISTINCT nullif(transaction_id, '')) FROM transactions""",
    "q4_tie_check": f"""WITH c AS (SELECT store_name, purchases_qty, count(*) OVER (PARTITION BY store_name) AS k, rank() OVER (PARTITION BY store_name ORDER BY purchases_qty DESC) AS r FROM ({_buyers('rank', '')})),
        g AS (SELECT *, count(*) OVER (PARTITION BY store_name, purchases_qty) AS same FROM c WHERE r <= 3)
        SELECT store_name, least(3, count(*)) AS n_found, least(3, count(*)) AS n_wanted, count(*) FILTER (NOT (r + same - 1 >= 3)) AS n_certain, count(*) FILTER (r + same - 1 >= 3) AS n_tied, true AS valid FROM g GROUP BY 1""",
    "request_results": " UNION ALL ".join(f"SELECT CAST(2 AS BIGINT) AS request_id, '{n}' AS result, count(*) AS n FROM ({SQL[q]})" for n, q in {"q1": "q1_high_amounts", "q2_a": "q2a_top_items_by_quantity", "q2_b": "q2b_top_items_by_revenue", "q3": "q3_half_year_volumes", "q4": "q4_top_buyers"}.items()),
    "filter_everything": "SELECT event_id FROM events",
    "custom_stage": f"SELECT transaction_id, CAST(final_amount AS DOUBLE) AS final_amount FROM ({_TX}) WHERE dayofweek(created_at) IN (0, 6) AND final_amount >= 75",
    "join_by_mode": f"SELECT year_half_created_at, coalesce(store_name, t.store_id) AS store_name, tpv FROM ({SQL['agg_half_year_stores']}) t LEFT JOIN {_ST} s ON t.store_id = s.store_id",
}


def flagship(spark: SparkSession, root: str) -> DataFrame:
    return QUERIES["q3_half_year_volumes"](spark, root)

