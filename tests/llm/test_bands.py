import random

from pyspark.sql import functions as F

from kassaflow.llm import bands
from kassaflow.llm.bands import top_n_by_bands


def test_bands_against_brute_force(spark, rows):
    r = random.Random(7)
    data = [(r.choice(["a", "b", None]), r.randrange(30), i, r.choice([None, *range(12)]), r.choice([None, "x", "y"])) for i in range(2000)]
    data += [("hot", 1, 5000 + i, 11, "x") for i in range(1500)]
    data += r.sample(data, 300)
    df = spark.createDataFrame(data, "g string, h int, id long, score int, `__rank` string")
    ties = [F.asc_nulls_last("__rank"), F.asc("id")]
    got = {tuple(x) for x in top_n_by_bands(df, ["g", "h"], "score", ties, 3).select("g", "h", "id").collect()}
    groups = {}
    for x in set(data):
        if x[0] is not None and x[3] is not None:
            groups.setdefault(x[:2], []).append(x)
    want = {(*g, x[2]) for g, v in groups.items() for x in sorted(v, key=lambda x: (-x[3], x[4] is None, x[4] or "", x[2]))[:3]}
    assert got == want
    assert {tuple(x) for x in top_n_by_bands(df, ["g", "h"], "score", ties, 3, shares=()).select("g", "h", "id").collect()} == want
    assert top_n_by_bands(df.limit(0), ["g", "h"], "score", ties, 3).count() == 0


def test_bands_with_a_large_table_of_filled_groups(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id % 50 as g", "id as v", "id")
    want = {tuple(x) for x in top_n_by_bands(df, ["g"], "v", [F.asc("id")], 2).collect()}
    monkeypatch.setattr(bands, "BROADCAST_BYTES", -1)
    assert {tuple(x) for x in top_n_by_bands(df, ["g"], "v", [F.asc("id")], 2).collect()} == want and len(want) == 100


def test_a_group_of_copies_and_a_third_of_all_rows(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, -1, id % 500) as g", "if(id % 6 = 0, 7, id % 11) as v", "if(id % 6 = 0, 1, id) as id")
    got = {tuple(x) for x in top_n_by_bands(df, ["g"], "v", [F.asc("id")], 3).collect()}
    groups = {}
    for x in {tuple(x) for x in df.collect()}:
        groups.setdefault(x[0], []).append(x)
    assert got == {x for v in groups.values() for x in sorted(v, key=lambda x: (-x[1], x[2]))[:3]}
