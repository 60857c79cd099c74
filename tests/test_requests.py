import threading
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from kassaflow import session
from kassaflow.operators.setops import top_n_check
from kassaflow.plans import sales
from kassaflow.plans.requests import Requests
from kassaflow.schemas import COLUMNS
from kassaflow.sources import readers

TABLES = {
    "transactions": [("t1", "1", "1", "", "7.0", "80.0", "0", "80.0", "2024-02-01 10:00:00"), ("t1", "1", "1", "", "7", "80.0", "0", "80.0", "2024-02-01 10:00:00"), ("t2", "2", "1", "", "", "10", "0", "10", "2025-08-01 10:00:00")],
    "transaction_items": [("t1", "1", "2", "5", "10", "2024-02-01 10:00:00"), ("t2", "9", "1", "10", "10", "2025-08-01 10:00:00")],
    "users": [("7", "", "1990-01-01", "2020-01-01 00:00:00")],
    "stores": [("1", 'A, "B"', "", "", "", "", "1", "1")],
    "menu_items": [("1", "Tea", "", "5", "true", "", "")],
}
NAMES = {"transactions": "Transactions2024.CSV", "transaction_items": "sub/transaction_items-1_sample.csv", "users": "USERS.csv", "stores": "stores 2024.csv", "menu_items": "menu_items.csv"}


@pytest.fixture
def files(tmp_path):
    for table, rows in TABLES.items():
        path = tmp_path / "in" / NAMES[table]
        path.parent.mkdir(parents=True, exist_ok=True)
        quoted = ",".join(COLUMNS[table]) + "\n" + "".join(",".join('"' + v.replace('"', '""') + '"' if v else "" for v in r) + "\n" for r in rows)
        path.write_text(quoted)
    (tmp_path / "in" / "other.csv").write_text("a\n1\n")
    (tmp_path / "in" / "users.txt").write_text("a\n1\n")
    return str(tmp_path / "in")


def test_files_belong_to_the_table_their_name_begins_with(spark, files, tmp_path):
    got = readers.table_files(spark, files)
    assert {t: [p.rsplit("/in/", 1)[1] for p in ps] for t, ps in got.items()} == {t: [n] for t, n in NAMES.items()}
    assert [t for t, _ in readers.scan_directory(spark, files)] == ["menu_items", "stores", "users", "transactions", "transaction_items"]
    assert readers.csv_text(spark, str(tmp_path / "nowhere"), "users").count() == 0


def test_a_large_file_is_several_tasks(spark, tmp_path):
    (tmp_path / "users_all.csv").write_text("user_id,gender,birthdate,registered_at\n" + "".join(f"{i},f,1990-01-01,2020-01-01 00:00:00\n" for i in range(60_000)))
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200_000)
    try:
        df = readers.csv_text(spark, str(tmp_path), "users")
        assert df.rdd.getNumPartitions() > 3 and df.select(F.count_distinct("user_id")).first()[0] == df.count() == 60_000
        assert readers.csv_text(spark, str(tmp_path), "users", multi_line=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)


def test_requests_have_results_of_their_own_and_leave_no_tables(spark, files, tmp_path):
    r = Requests(spark, str(tmp_path / "out"))
    t = sales.from_csv(spark, files)
    a, b = r.accept(), r.accept()
    assert (a, b) == (1, 2)
    before = set((tmp_path / "out").iterdir())
    paths = r.run(b, t)
    read = {n: sorted(map(tuple, spark.read.option("header", True).option("escape", '"').csv(p).collect())) for n, p in paths.items()}
    assert read == {"q1": [("t1", "80.00")], "q2_a": [("2024-02", "Tea", "2"), ("2025-08", "9", "1")], "q2_b": [("2024-02", "Tea", "10.00"), ("2025-08", "9", "10.00")], "q3": [("2024-H1", 'A, "B"', "160.00"), ("2025-H2", "2", "10.00")], "q4": [('A, "B"', "1990-01-01")]}
    assert all(p.startswith(r.folder(b)) for p in paths.values()) and before == set((tmp_path / "out").iterdir())
    assert r.abandoned() == [a] and r.clean_up() == [a] and r.abandoned() == [] and r.accept() == 3


def test_helper_tables_go_with_their_scope(spark, tmp_path):
    with session.scratch_scope(spark):
        path = session.written(spark.range(3).toDF("a"), "gone").inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
        assert session.stored_bytes(spark, path) > 0
    fs, p = session._fs(spark, path)
    assert not fs.exists(p)
    kept = session.written(spark.range(3).toDF("a"), "kept")
    assert kept.count() == 3


def test_a_cancelled_request_stops_and_leaves_nothing(spark, tmp_path):
    r = Requests(spark, str(tmp_path / "out"))
    n = r.accept()
    slow = F.udf(lambda i: (time.sleep(0.5), i)[1], "long")
    failed = []

    def run():
        try:
            r.run(n, lambda name: spark.range(1), lambda t: {"slow": spark.range(0, 4000, 1, 4).select(slow("id").alias("id"))})
        except Exception as e:
            failed.append(e)

    thread = threading.Thread(target=run)
    thread.start()
    time.sleep(6)
    began = time.time()
    r.cancel(n)
    thread.join(60)
    assert failed and time.time() - began < 60 and r.abandoned() == []


@pytest.mark.parametrize("master, fails", [("spark://host:7077", True), ("yarn", True), ("local-cluster[2,1,1024]", True), ("local[4]", False), ("local", False)])
def test_a_cluster_needs_a_shared_folder(monkeypatch, master, fails):
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master=master, applicationId=master, setCheckpointDir=lambda p: None))
    if fails:
        with pytest.raises(ValueError):
            session.shared_dir(fake)
    else:
        assert session.shared_dir(fake)


def test_top_n_check_accepts_any_tied_choice_and_nothing_else(spark):
    c = spark.createDataFrame([("a", "x", 9), ("a", "y", 5), ("a", "z", 5), ("a", "y", 5), ("a", "low", 1), ("b", "p", 2), (None, None, 4), ("c", "q", None)], "g string, l string, m int")

    def valid(*rows):
        r = spark.createDataFrame(list(rows), "g string, l string")
        return {x.g: x.valid for x in top_n_check(r, c, "g", "l", "m", 3).collect()}

    rest = [("b", "p"), (None, None)]
    assert valid(("a", "x"), ("a", "y"), ("a", "z"), *rest) == {"a": True, "b": True, None: True}
    assert valid(("a", "x"), ("a", "y"), ("a", "y"), *rest)["a"]
    assert not valid(("a", "x"), ("a", "z"), ("a", "z"), *rest)["a"]  # z stands there once
    assert not valid(("a", "y"), ("a", "y"), ("a", "z"), *rest)["a"]  # x is certain
    assert not valid(("a", "x"), ("a", "y"), *rest)["a"]  # too few
    assert not valid(("a", "x"), ("a", "y"), ("a", "z"), ("a", "low"), *rest)["a"]
    assert valid(("a", "x"), ("a", "y"), ("a", "z"), ("d", "new")) == {"a": True, "b": False, None: False, "d": False}
