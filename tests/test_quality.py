import csv
import io
import math
import random
from datetime import datetime, timedelta
from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kassaflow.operators import profile as prof
from kassaflow.operators import records, references, skew
from kassaflow.operators.redelivery import Conflict, MessageStore, first_deliveries

T0 = datetime(2024, 1, 1)


# -- profiles


def loads(spark, n=12, rows=400, change=None):
    r = random.Random(1)
    data = []
    for load in range(1, n + 1):
        for _ in range(rows * (3 if load == 2 else 1)):
            data.append((load, str(r.randrange(1, 5000)), r.gauss(100, 10), r.choice(["a", "b", None, ""])))
    if change:
        data = [change(r, x) for x in data]
    return spark.createDataFrame(data, "load_id int, user_id string, amount double, flag string")


def found(df, **kw):
    p = prof.profile(df, "load_id", patterns={"user_id": prof.WHOLE_NUMBER})
    return {(x.column_name, x.load_id): set(x.reasons) for x in prof.departures(p, **kw).where("departs").collect()}


def test_profile_counts_and_power_sums(spark):
    df = spark.sql("select * from values (1,'7',1.5D,true),(1,'7',2.5D,false),(1,'07',null,null),(1,'',-4D,null),(1,null,0D,null),(null,'x',9D,true) t(load_id,user_id,x,column_name)")
    p = {(r.load_id, r.column_name): r for r in prof.moments(prof.profile(df, "load_id", patterns={"user_id": prof.WHOLE_NUMBER})).collect()}
    u, x = p[(1, "user_id")], p[(1, "x")]
    assert (u.n_rows, u.n_null, u.n_distinct, u.n_violations) == (5, 2, 2, 1)
    assert (x.n_null, x.n_distinct, x.min_value, x.max_value) == (1, 4, -4.0, 2.5)
    assert abs(x["mean"] - 0.0) < 1e-6 and abs(x.sd - (24.5 / 4) ** 0.5) < 1e-5
    assert p[(None, "user_id")].n_violations == 1 and p[(1, "column_name")].n_distinct == 2


def test_power_sums_are_exact_and_profiles_made_apart_merge(spark):
    r = random.Random(3)
    numbers = ["999999999999999999", "-999999999999999999", "12.5", "-0.07", "0", "1e300", "-3.25e-200", "123456.789", "7", "7", ".1", "99999999999.99", "1e13"]
    cents = [Decimal("9999999999999999.99"), Decimal("-9999999999999999.99"), Decimal("0.01"), Decimal("12.30"), None, Decimal(0)]
    rows = [(i % 2, r.choice(numbers), r.choice(cents), r.choice([9007199254740993, -1, 3, None]), r.choice([0.1, 1 / 3, 1e-7, 2.5, -12345.67, float("nan"), float("inf"), None])) for i in range(300)]
    df = spark.createDataFrame(rows, "load_id int, t string, d decimal(18,2), n long, x double")
    read = {
        "t": lambda v: Fraction(v) if len(v) < 17 else Fraction(float(v)),
        "d": Fraction,
        "n": Fraction,
        "x": lambda v: Fraction(repr(v)) if math.isfinite(v) else None,
    }
    parts = [prof.profile(df.where(F.pmod(F.xxhash64("t", "n", "x"), F.lit(3)) == i), "load_id") for i in range(3)]
    for p in (prof.profile(df, "load_id"), prof.merge_profiles(*parts)):
        got = {(x.load_id, x.column_name): x for x in prof.moments(prof.power_sums(p)).collect()}
        for load in (0, 1):
            for i, c in enumerate("tdnx", 1):
                v = [y for row in rows if row[0] == load and row[i] is not None and (y := read[c](row[i])) is not None]
                x = got[load, c]
                assert x.s0 == len(v) and [Fraction(x[f"s{k}"]) for k in range(1, 5)] == [sum(y**k for y in v) for k in range(1, 5)], (load, c)
                m = sum(v) / len(v)
                var, third, fourth = (sum((y - m) ** k for y in v) / len(v) for k in (2, 3, 4))
                near = lambda a, b: a is not None and abs(Fraction(a) - b) <= abs(b) * Fraction(1, 10**12)
                assert near(x["mean"], m) and near(Fraction(x.sd) ** 2, var) and near(Fraction(x.skew) ** 2, third**2 / var**3) and (x.skew >= 0) == (third >= 0) and near(x.kurt, fourth / var**2)


def test_power_sums_of_very_many_rows_do_not_overflow(spark):
    values = spark.sql("select 1 load_id, 'd' column_name, 1 g, cast(999999999999999999 as decimal(18,0)) k, 10000000000 n union all select 1, 'd', 1, -999999999999999998, 10000000000")
    x = values.groupBy("g").agg(*prof._limbs(F.col("k"), F.col("n")).values()).withColumns({"unit": F.lit(0), "s0": F.lit(2 * 10**10)}).first().asDict()
    assert [int(t) for t in prof._totals([x])] == [2 * 10**10, *[10**10 * ((10**18 - 1) ** i + (-(10**18) + 2) ** i) for i in range(1, 5)]]


def test_ordinary_loads_and_more_rows_are_no_departure(spark):
    assert found(loads(spark)) == {}
    assert found(loads(spark, 3)) == {}
    assert found(loads(spark).limit(0)) == {}


def test_each_kind_of_departure(spark):
    def change(r, x):
        load, u, a, f = x
        if load == 4:
            u = None if r.random() < 0.5 else u
        if load == 5:
            u = f"0{u}"
        if load == 6:
            a += 8
        if load == 7:
            a = 100 + (a - 100) * 3
        if load == 8:
            u = str(int(u) % 40 + 2000)
        if load == 9:
            a = 100.0
        return load, u, a, f

    got = found(loads(spark, change=change))
    assert set(got) == {("user_id", 4), ("user_id", 5), ("amount", 6), ("amount", 7), ("user_id", 8), ("amount", 9)}
    assert "null_rate" in got["user_id", 4] and "pattern" in got["user_id", 5] and "mean" in got["amount", 6]
    assert "spread" in got["amount", 7] and "distinct" in got["user_id", 8] and "spread" in got["amount", 9]


def test_one_absurd_value_hides_no_other_load(spark):
    df = loads(spark, change=lambda r, x: (x[0], x[1], x[2] / 20 + (3 if x[0] == 6 else 0), x[3])).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    ids = df.withColumn("user_id", F.when(F.col("load_id") == 8, (F.col("user_id").cast("int") + 4000).cast("string")).otherwise(F.col("user_id")))
    absurd = ids.unionByName(spark.sql("select 3 load_id, '1e300' user_id, cast(1e12 as decimal(18,2)) amount, 'a' flag"))
    assert {("amount", 6), ("amount", 3), ("user_id", 8), ("user_id", 3)} == set(found(absurd))
    m = {(x.column_name, x.load_id): x for x in prof.moments(prof.profile(absurd, "load_id")).collect()}
    want = {x.load_id: (x.m, x.s) for x in absurd.groupBy("load_id").agg(F.avg(F.col("amount").cast("double")).alias("m"), F.stddev_pop(F.col("amount").cast("double")).alias("s")).collect()}
    for i, (mean, sd) in want.items():
        assert abs(m["amount", i]["mean"] / mean - 1) < 1e-9 and abs(m["amount", i].sd / sd - 1) < 1e-9


def test_small_domains_and_rare_nulls_depart(spark):
    r = random.Random(6)
    shares = {1: ("1", "1", "1", "1", "1", "2", "2", "2", "3", "4"), 5: ("1", "1", "1", "1", "1", "1", "3", "3", "3", "4"), 7: ("1", "3")}
    data = [(load, r.choice(shares.get(load, shares[1])), None if load == 9 and r.random() < 0.07 else r.gauss(100, 10)) for load in range(1, 13) for _ in range(3000)]
    got = found(spark.createDataFrame(data, "load_id int, user_id string, amount double"))
    assert set(got) == {("user_id", 5), ("user_id", 7), ("amount", 9)}
    assert "mix" in got["user_id", 5] and "mix" in got["user_id", 7] and got["amount", 9] == {"null_rate"}


# -- references


def alive_at(key, t, parents, deletions):
    return any(k == key and (s is None or s <= t) and not any(dk == key and (s is None or d > s) and d <= t for dk, d in deletions) for k, s in parents)


@pytest.mark.parametrize("hot_share", [1000, 5])
def test_references_against_brute_force(spark, rows, monkeypatch, hot_share):
    monkeypatch.setattr(skew, "HOT_SHARE", hot_share)
    r = random.Random(3)
    day = lambda: T0 + timedelta(days=r.randrange(20))
    parents = [(f"k{r.randrange(8)}", r.choice([None, day(), day(), day()])) for _ in range(20)]
    deletions = [(f"k{r.randrange(10)}", day()) for _ in range(12)]
    refs = [(i, f"k{r.randrange(12)}", day()) for i in range(3000)] + [(5000 + i, "k0", day()) for i in range(1500)] + [(9000, None, T0), (9001, "k99", None)]
    p = spark.createDataFrame([*parents, (None, T0)], "key string, start timestamp")
    d = spark.createDataFrame([*deletions, (None, T0), ("k1", None)], "key string, deleted_at timestamp")
    f = spark.createDataFrame([(*x, 0) for x in refs], "record_id long, key string, t timestamp, n int")
    got = references.orphans(f, references.lifetimes(p, d))
    want = {i for i, k, t in refs if k and t and not alive_at(k, t, parents, deletions)} | {9001}
    assert {x.record_id for x in got.collect()} == want
    rep = references.report(got.withColumn("table_name", F.lit("t")))
    assert rep.agg(F.sum("orphan_rows")).first()[0] == len(want)
    assert references.orphans(f.limit(0), references.lifetimes(p, d)).count() == 0
    assert references.orphans(f, references.lifetimes(p.limit(0), d.limit(0))).count() == len(refs) - 1


# -- redelivery


def deliveries(r, n):
    return [(i, r.choice(["p", "q"]), 1, r.randrange(2), r.choice([None, *range(30)]), r.choice([None, T0 + timedelta(hours=r.randrange(200))]), "extra") for i in range(n)]


def test_store_keeps_one_of_each_message(spark, tmp_path):
    r = random.Random(5)
    data = deliveries(r, 400) + [(1000 + i, "hot", 1, 0, 7, T0 + timedelta(hours=1), "x") for i in range(300)]
    r.shuffle(data)
    schema = "delivery_id long, payload string, request_id long, data_type int, position long, received_at timestamp, part_day string"
    df = spark.createDataFrame(data, schema)
    store = MessageStore(spark, str(tmp_path / "s"), ["request_id", "data_type", "position"], "received_at", "delivery_id")
    thirds = [df.where(F.col("delivery_id") % 3 == i) for i in range(3)]
    surplus = {x.delivery_id for x in first_deliveries(store, [*thirds, df.limit(0)]).collect()}
    best = {}
    for i, _, q, t, p, at, _ in data:
        if p is not None:
            best.setdefault((q, t, p), []).append((at is None, at or T0, i))
    winners = {min(v)[2] for v in best.values()}
    assert surplus == {x[0] for x in data if x[4] is not None} - winners
    kept = {x.delivery_id for x in store.read().collect()}
    assert kept == winners | {x[0] for x in data if x[4] is None}
    again = MessageStore(spark, str(tmp_path / "s"), store.keys, "received_at", "delivery_id")
    again.vacuum()
    assert {x.delivery_id for x in again.read().collect()} == kept


def test_only_affected_partitions_are_replaced(spark, tmp_path):
    schema = "request_id long, position long, delivery_id long, received_at timestamp"
    store = MessageStore(spark, str(tmp_path / "s"), ["request_id", "position"], "received_at", "delivery_id")
    store.upsert(spark.createDataFrame([(1, 1, 1, T0), (1, 2, 2, T0 + timedelta(days=1)), (1, 3, 3, T0 + timedelta(days=2))], schema), 0)
    store.upsert(spark.createDataFrame([(1, 2, 9, T0 + timedelta(days=3))], schema), 1)
    assert {p: int(v.split("-")[0]) for p, v in store.manifest["parts"].items()} == {"2024-01-01": 1, "2024-01-02": 2, "2024-01-03": 1}
    assert [x.delivery_id for x in store.upsert(spark.createDataFrame([], schema), 1).collect()] == [9]  # a batch taken in before
    assert MessageStore(spark, str(tmp_path / "none"), ["request_id"], "received_at", "delivery_id").read() is None


# -- bands


MESSAGES = "request_id int, position int, delivery_id long, received_at timestamp, payload string"


def message_store(spark, path, **kw):
    return MessageStore(spark, str(path), ["request_id", "position"], "received_at", "delivery_id", **kw)


def kept(store):
    return sorted(((x.request_id, x.position, x.delivery_id) for x in store.read().collect()), key=str)


def test_a_batch_without_number_that_comes_again_changes_nothing(spark, tmp_path):
    store = message_store(spark, tmp_path / "s")
    batch = spark.createDataFrame([(1, 1, 1, T0, "a"), (1, 1, 2, T0, "b"), (2, 2, 3, T0 + timedelta(days=1), "c"), (1, None, 4, T0, "d"), (None, 2, 5, None, "e"), (3, 3, 6, None, "f"), (3, 3, None, None, "g"), (4, 4, None, T0, "h")], MESSAGES)
    want = sorted([(1, 1, 1), (2, 2, 3), (1, None, 4), (None, 2, 5), (3, 3, 6), (4, 4, None)], key=str)
    for b in (batch, batch, batch.unionByName(batch)):
        assert [x.delivery_id for x in store.upsert(b).collect()] == [2]
        assert kept(store) == want
    for n in (None, 5, 5):
        assert store.upsert(batch, n).count() == 1 and kept(store) == want


def test_of_two_writers_the_second_is_refused_and_can_try_again(spark, tmp_path):
    a, b = message_store(spark, tmp_path / "s"), message_store(spark, tmp_path / "s")
    one, two = (spark.createDataFrame([(1, i, i, T0, "x")], MESSAGES) for i in (7, 8))
    a.upsert(one)
    with pytest.raises(Conflict):
        b.upsert(two)
    assert kept(message_store(spark, tmp_path / "s")) == [(1, 7, 7)]
    b.refresh()
    b.upsert(two)
    b.vacuum()
    assert kept(message_store(spark, tmp_path / "s")) == [(1, 7, 7), (1, 8, 8)] and len(list((tmp_path / "s" / "commits").iterdir())) == 1


@pytest.mark.parametrize("at", ["data", "surplus", "index", "commit"])
def test_a_writer_lost_at_any_step_leaves_the_old_state(spark, tmp_path, at):
    store = message_store(spark, tmp_path / "s")
    store.upsert(spark.createDataFrame([(1, 1, 5, T0, "a"), (1, 2, 6, T0, "b")], MESSAGES), 0)
    batch = spark.createDataFrame([(1, 1, 3, T0 - timedelta(days=1), "a"), (1, 3, 7, T0, "c")], MESSAGES)

    def lost(step):
        if step == at:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        message_store(spark, tmp_path / "s", step=lost).upsert(batch, 1)
    again = message_store(spark, tmp_path / "s")
    assert kept(again) == [(1, 1, 5), (1, 2, 6)]
    assert [x.delivery_id for x in again.upsert(batch, 1).collect()] == [5]
    again.vacuum()
    assert kept(again) == [(1, 1, 3), (1, 2, 6), (1, 3, 7)]
    assert sorted(tuple(r) for r in again.index().collect()) == [(1, 1, "2023-12-31"), (1, 2, "2024-01-01"), (1, 3, "2024-01-01")]


def test_an_upsert_reads_the_buckets_of_its_identifiers_only(spark, tmp_path):
    store = message_store(spark, tmp_path / "s", buckets=8)
    store.upsert(spark.createDataFrame([(1, i, i, T0, "x") for i in range(200)], MESSAGES))
    before = dict(store.manifest["index"])
    store.upsert(spark.createDataFrame([(1, 5, 1000, T0, "x")], MESSAGES))
    after = store.manifest["index"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert len(store.index([0]).inputFiles()) < len(store.index().inputFiles()) and store.index().count() == 200


# -- records


def strict_reason(line):
    """Python's strict CSV reader, as a second opinion on quoting."""
    try:
        list(csv.reader(io.StringIO(line, newline=""), strict=True))
    except csv.Error:
        return "quoting"
    return None


def test_judge():
    j = lambda line, t="users", c=4: records.judge(t, c, line)[0]
    assert j("1,f,1990-01-01,2024-01-01 00:00:00\r") is None
    assert j('"1","f, ""x""\n",1990-01-01,2024-01-01 00:00:00') is None
    assert j(" 1.0 ,,1990-01-01,2024-01-01 00:00:00") is None
    for bad in ('"1,f,1990-01-01,2024-01-01 00:00:00', '"1"x,f,1990-01-01,2024-01-01 00:00:00', '1,f"x",1990-01-01,2024-01-01 00:00:00', '1,f,1990-01-01,2024-01-01 00:00:00"', '"1" ,f', 'x""'):
        assert j(bad) == "quoting", bad
    for bad in ("1,f,1990-01-01", "1,f,1990-01-01,2024-01-01 00:00:00,", "1;f;1990-01-01;2024", ",,,,"):
        assert j(bad) == "column_count", bad
    for bad in ("01x,f,1990-01-01,2024-01-01 00:00:00", "1,f,1990-02-30,2024-01-01 00:00:00", "1,f,1990-01-01,2024-01-01 24:00:00", ",f,1990-01-01,2024-01-01 00:00:00", "1.5,f,1990-01-01,2024-01-01 00:00:00"):
        assert j(bad) == "invalid_value", bad
    assert [j(x) for x in (" \r", "", None, "\n")] == ["blank"] * 4
    assert j("a,b", "other", 2) is None and j("a,b", None, None) == "column_count"


@settings(max_examples=400, deadline=None)
@given(st.text('a",\n 1', max_size=14), st.integers(1, 4))
def test_parse_costs_agree_with_the_strict_grammar(line, columns):
    cost, edits, n = records.cheapest_parse(line, columns)
    values = records.strict_fields(line)
    assert (cost < records.QUOTE_COST) == (values is not None)
    if values is not None:
        assert n == len(values) and cost == abs(len(values) - columns)
    else:
        assert any("quote" in e or "separate" in e for e in edits)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text('ab",\n', max_size=5), min_size=1, max_size=4))
def test_what_a_writer_quotes_is_read_back(values):
    line = ",".join('"' + v.replace('"', '""') + '"' for v in values)
    assert records.strict_fields(line) == values


def test_very_many_surplus_commas_are_no_quoting_fault():
    reason, detail, _ = records.judge("users", 4, "a," * 5000 + "b")
    assert reason == "column_count" and len(detail.split(";")) == 4997
    assert records.judge("users", 4, 'a,"b' + "," * 5000)[0] == "quoting"


def test_parse_costs_of_single_faults():
    assert records.cheapest_parse('a,"b,c', 3)[:2] == (1000.0, ["delete_quote@2"])
    assert records.cheapest_parse('a,"b,c', 2)[:2] == (1000.0, ["insert_quote@6"])
    assert records.cheapest_parse("a,b", 3)[:2] == (1.0, ["insert_delimiter"])
    long = '"' + "x," * 40_000
    assert records.cheapest_parse(long, 2)[0] >= 1000


def test_records_load_and_fault(spark, rows):
    df = spark.createDataFrame(
        [(1, "users", 4, "1, f,1990-01-01,2024-01-01 00:00:00"), (2, "users", 4, '1,"f,1990-01-01'), (3, "users", None, "1,f"), (4, "users", 4, None), (5, None, None, "x"), (6, "stores", 8, '1,"A, ""b""",s,,c,d,1.5,181')],
        "raw_id long, data_type string, columns_have int, raw_line string",
    ).withColumn("reason", F.lit("mine"))
    p = records.parse_records(df)
    assert rows(records.faulty(p).select("raw_id", "reason")) == [(2, "quoting"), (3, "column_count"), (6, "invalid_value")]
    assert [tuple(r) for r in records.loaded(p, "users").collect()] == [(1, "1", "f", "1990-01-01", "2024-01-01 00:00:00")]
    assert records.parse_records(df.limit(0)).count() == 0


# -- joins with hot keys


def test_rows_with_keys_hot_and_cold(spark):
    from kassaflow.operators.skew import rows_with_keys
    from kassaflow.session import written

    rows = spark.range(3000).selectExpr("case when id < 1000 then 'hot' when id % 7 = 0 then null else concat('k', id % 100) end as key", "id as n")
    keys = written(spark.createDataFrame([("hot", 1000), ("k3", 20), ("none", 5)], "key string, n long"), "keys")
    want = rows.where("key in ('hot', 'k3')").count()
    assert rows_with_keys(rows, keys, "key", "n", 1025).count() == want
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows_with_keys(rows, keys, "key", "n", 1025_000).count() == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(f"p{i}_found" in e.queries() for i in (1, 2, 3, 5))
