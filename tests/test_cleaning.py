from datetime import datetime

import pytest

from kassaflow.functions import keys as K
from kassaflow.operators import filters
from kassaflow.operators.clean import clean, require
from kassaflow.schemas import TableSpec, spec
from kassaflow.sources import readers, sinks


def test_spec_rejects_columns_that_are_not_there():
    with pytest.raises(ValueError):
        TableSpec("t", ("a",), ("b",))
    with pytest.raises(ValueError):
        TableSpec("t", ("a", "b"), ("a",), ("b",))


def test_clean_order_required_and_ids(spark, rows):
    df = spark.createDataFrame(
        [("t1", "1", "123.0", "x"), ("t2", "", "5", "x"), (None, "1", "5", "x"), ("t3", "2", "", "x"), ("t4", "3", "abc", "x"), ("t5", " ", " 7 ", "x"), ("t6", "1", None, "x")],
        "transaction_id string, store_id string, user_id string, __rank string",
    )
    s = TableSpec("t", ("transaction_id", "store_id", "user_id"), ("store_id", "transaction_id", "user_id"), ("user_id",))
    got = clean(df, s)
    assert got.columns == ["store_id", "transaction_id", "user_id"]
    assert rows(got) == [(" ", "t5", "7"), ("1", "t1", "123"), ("1", "t6", None), ("2", "t3", None), ("3", "t4", "abc")]
    assert rows(require(got, ["user_id"]).select("transaction_id")) == [("t1",), ("t4",), ("t5",)]
    assert clean(df.limit(0), s).count() == 0


def test_whole_numbers(spark):
    cases = {"123.0": "123", "007": "7", "+5": "5", "-2.9": "-2", "2.9": "2", "1e3": "1000", ".5": "0", "": None, "abc": None, "75d": None, "nan": None, " 8\t": "8", "7\n": "7", "12345678901234567890": "12345678901234567000", "1 2": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r.v: r.w for r in df.select("v", K.whole_number_text("v").alias("w")).collect()}
    big = got.pop("12345678901234567890")
    assert got == {k: v for k, v in cases.items() if k != "12345678901234567890"}
    assert big.startswith("123456789012345") and len(big) == 20


def test_keys_and_numbers(spark):
    df = spark.createDataFrame([(datetime(2024, 6, 30, 23, 59, 59), " A  b ", 1.006), (datetime(2024, 7, 1), "  ", -2.344), (None, None, None)], "t timestamp, n string, x double")
    got = [tuple(r) for r in df.select(K.month_key("t"), K.half_year_key("t"), K.folded_name("n"), K.fixed_places("x", 2)).collect()]
    assert got == [("2024-06", "2024-H1", "a b", "1.01"), ("2024-07", "2024-H2", None, "-2.34"), (None, None, None, None)]


def test_temporal_and_amount(spark):
    times = ["2023-12-31 23:59:59", "2024-01-01 05:59:59", "2024-01-01 06:00:00", "2025-12-31 23:59:59", "2026-01-01 06:00:00", None]
    df = spark.createDataFrame([(t, a) for t, a in zip(times, ["74.99", "75", "75.0", "abc", "NaN", None])], "s string, a string").selectExpr("s", "cast(s as timestamp) t", "a")
    assert [r.s for r in df.where(filters.make_filter("temporal", "t", 2024, 2025, 6, 23)).collect()] == times[2:4]
    assert [r.a for r in df.where(filters.make_filter("amount", "a", 75)).collect()] == ["75", "75.0", "NaN"]
    with pytest.raises(ValueError):
        filters.make_filter("other")


def test_route_is_not_first_match(spark, rows):
    df = spark.createDataFrame([(1,), (5,), (None,)], "a int")
    rules = {"small": df.a < 6, "tiny": df.a < 2}
    assert rows(filters.route_tagged(df, rules)) == [(1, "small"), (1, "tiny"), (5, "small")]
    assert {k: v.count() for k, v in filters.route(df, rules).items()} == {"small": 2, "tiny": 1}


def test_time_filter_reaches_the_scan(spark, tmp_path):
    zoned = spark.range(10).selectExpr("id", "timestamp_seconds(1700000000 + id * 10000000) as created_at", "id as other")
    for i, df in enumerate((zoned, zoned.selectExpr("id", "cast(created_at as timestamp_ntz) as created_at", "other"))):
        df.write.parquet(str(tmp_path / f"t{i}.parquet"))
        got = readers.parquet(spark, str(tmp_path), f"t{i}").where(filters.temporal("created_at", 2024, 2025)).select("id", "created_at")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(created_at" in plan and "other" not in plan.split("ReadSchema")[1]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, zoned.where("year(created_at) in (2024, 2025)").select("id", "created_at").collect()))


def test_csv_scan(spark, rows, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "users_1.csv").write_text('user_id,gender,birthdate,registered_at\n1,"f, x",1990-01-01,2024-01-01 00:00:00\n\n2,m\n')
    (tmp_path / "users_sample.csv").write_text("user_id,gender,birthdate,registered_at\n3,,1991-01-01,2024-01-01 00:00:00,extra\n")
    (tmp_path / "transaction_items_1.csv").write_text("transaction_id,item_id\nx,1\n")
    (tmp_path / "notes.txt").write_text("x")
    got = readers.csv_text(spark, str(tmp_path), "users").select("user_id", "gender", "birthdate")
    assert rows(got) == [("1", "f, x", "1990-01-01"), ("2", "m", None), ("3", None, "1991-01-01")]
    assert clean(readers.csv_typed(spark, str(tmp_path), "users"), spec("users")).count() == 2
    assert readers.csv_text(spark, str(tmp_path), "stores").count() == 0
    assert readers.csv_text(spark, str(tmp_path), "transactions").count() == 0
    assert [t for t, _ in readers.scan_directory(spark, str(tmp_path))][0] == "menu_items"


def test_pipe_records(spark, rows):
    df = spark.createDataFrame([("a|b|c",), ("a|",), ("x||",), ("",), ("  ",), (None,), ("a",)], "payload string")
    assert rows(readers.pipe_records(df, "payload", ["p", "q"])) == [("a", None), ("a", "b"), ("x", None)]


def test_csv_sink_and_union(spark, tmp_path):
    df = spark.createDataFrame([("Brasa, Bean", 12055387.76), (None, None)], "store_name string, tpv double")
    sinks.write_csv(df, str(tmp_path / "out"), single_file=True)
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text.splitlines() == ["store_name,tpv", '"Brasa, Bean",12055387.76', '"",""'] or text.splitlines()[:2] == ["store_name,tpv", '"Brasa, Bean",12055387.76']
    assert readers.union_all([df, df.select("tpv")]).count() == 4
    with pytest.raises(ValueError):
        readers.union_all([])
    paths = sinks.deliver({"q1": df}, str(tmp_path / "all"))
    assert spark.read.option("header", True).csv(paths["q1"]).count() == 2
