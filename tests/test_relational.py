import pytest
from pyspark.sql import functions as F

from kassaflow.operators import aggs, dedup, joins, setops, topn


def test_monthly_totals_take_whole_rows(spark, rows):
    df = spark.sql("select * from values (timestamp'2024-01-05 00:00:00', 'a', 2L, 1.10BD), (timestamp'2024-01-06 00:00:00', 'a', null, 9BD), (timestamp'2024-01-06 00:00:00', 'a', 1L, null), (null, 'a', 1L, 1BD), (timestamp'2024-01-31 23:59:59', 'a', 3L, 0.90BD) t(created_at, item_id, quantity, subtotal)")
    assert [(r[0], r[1], r[2], float(r[3])) for r in aggs.aggregate("q2", df).collect()] == [("2024-01", "a", 5, 2.0)]
    assert aggs.aggregate("q2", df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        aggs.aggregate("q9", df)


def test_purchase_counts_skip_blank_users(spark, rows):
    df = spark.createDataFrame([("1", "u"), ("1", "u"), ("1", " "), ("1", None), (None, "u")], "store_id string, user_id string")
    assert rows(aggs.purchase_counts(df)) == [("1", "u", 2)]


def test_merge_partials(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None), (None, 1)], "k string, n int")
    assert rows(aggs.merge_partials(df, ["k"], ["n"])) == [(None, 1), ("a", 3), ("b", None)]


def test_top_n_ties_nulls_and_clashing_names(spark, rows):
    df = spark.createDataFrame([("g", "a", 5, 0), ("g", "b", 5, 0), ("g", "c", 5, 0), ("g", "d", None, 0), ("h", "a", 1, 0), (None, "z", 9, 0)], "g string, k string, v int, __rank int")
    got = topn.top_n(df, ["g"], "v", 2, ["k"])
    assert got.columns == df.columns
    assert rows(got.select("g", "k")) == [(None, "z"), ("g", "a"), ("g", "b"), ("h", "a")]
    assert topn.top_n(df, ["g"], "v", 2, ["k"], with_ties=True).count() == 5
    assert topn.top_n(df.limit(0), ["g"], "v", 2, ["k"]).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # the cut before the exchange and the one after


def test_top_n_metrics(spark, rows):
    df = spark.createDataFrame([("m", "a", 1, 9.0), ("m", "b", 2, 1.0)], "g string, k string, q int, r double")
    assert rows(topn.top_n_metrics(df, ["g"], {"q": "quantity", "r": "subtotal"}, 1, ["k"]).select("k", "metric")) == [("a", "subtotal"), ("b", "quantity")]


def test_sorted_by_code_point(spark):
    df = spark.createDataFrame([("b",), ("A",), (None,), ("é",), ("a",)], "x string")
    assert [r.x for r in topn.sorted_by(df, "x").collect()] == [None, "A", "a", "b", "é"]


def test_lookup_falls_back_and_does_not_fan_out(spark, rows):
    df = spark.createDataFrame([("1", 10), ("2", 20), (None, 30)], "store_id string, tpv int")
    dim = spark.createDataFrame([("1", "x", 1), ("1", "y", 0), (None, "z", 0)], "store_id string, store_name string, __k int")
    got = joins.join("q3", df.withColumn("__v", F.lit(0)), dim)
    assert rows(got.select("store_name", "tpv")) == [(None, 30), ("2", 20), ("y", 10)]
    assert rows(joins.lookup(df, dim, "store_id", "store_name", [F.col("__k")]).select("store_name", "tpv"))[2] == ("x", 10)
    assert joins.lookup(df, dim.limit(0), "store_id", "store_name").count() == 3
    with pytest.raises(ValueError):
        joins.join("q5", df, dim)


def test_distinct_on(spark, rows):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), (None, 4)], "k string, v int")
    assert rows(dedup.distinct_on(df, ["k"], ["v"])) == [(None, 3), ("a", 1)]
    assert dedup.distinct_on(df.limit(0), ["k"], ["v"]).count() == 0


def test_dense_positions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"), F.lit(1).alias("__i"))
    got = dedup.dense_positions(df, ["id"])
    assert got.where(F.col("position") != F.col("id") + 1).count() == 0 and got.count() == 1000
    assert dedup.dense_positions(df.limit(0), ["id"]).count() == 0


def test_differences_are_bags(spark, rows):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (3,)], "x int")
    assert rows(setops.differences(a, b)) == [(1, "left"), (2, "left"), (3, "right")]
