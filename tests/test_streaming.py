import pytest
from pyspark.sql import functions as F

from kassaflow.operators.redelivery import MessageStore
from kassaflow.session import local_session
from kassaflow.streaming import incremental


def items(spark, path, ids):
    df = spark.createDataFrame([(f"i{i % 2}", i, i) for i in ids], "item_id string, quantity long, n int")
    df = df.select("item_id", "quantity", F.lit(1.5).cast("decimal(18,2)").alias("subtotal"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"))
    df.coalesce(1).write.mode("append").parquet(path)


def test_totals_go_on_from_the_checkpoint(spark, tmp_path):
    path, out, check = (str(tmp_path / x) for x in ("t/transaction_items.parquet", "out", "check"))
    items(spark, path, [1, 2, 3])
    incremental.monthly_items(incremental.stream_table(spark, str(tmp_path / "t"), "transaction_items"), check, out)
    assert {r.item_id: r.sellings_qty for r in incremental.newest(spark, out).collect()} == {"i0": 2, "i1": 4}
    # the same again changes nothing; new files are added
    incremental.monthly_items(incremental.stream_table(spark, str(tmp_path / "t"), "transaction_items"), check, out)
    items(spark, path, [4])
    incremental.monthly_items(incremental.stream_table(spark, str(tmp_path / "t"), "transaction_items"), check, out)
    assert {r.item_id: r.sellings_qty for r in incremental.newest(spark, out).collect()} == {"i0": 6, "i1": 4}


def test_readers_of_a_state_see_no_other(spark, tmp_path):
    path, out, check = (str(tmp_path / x) for x in ("t/transaction_items.parquet", "out", "check"))
    assert incremental.newest(spark, out) is None
    items(spark, path, [1, 2, 3])
    incremental.monthly_items(incremental.stream_table(spark, str(tmp_path / "t"), "transaction_items"), check, out)
    before = incremental.newest(spark, out)
    items(spark, path, [4])
    incremental.monthly_items(incremental.stream_table(spark, str(tmp_path / "t"), "transaction_items"), check, out)
    (tmp_path / "out" / "state-9").mkdir()  # one that isn't complete
    assert {r.item_id: r.sellings_qty for r in before.collect()} == {"i0": 2, "i1": 4}
    assert {r.item_id: r.sellings_qty for r in incremental.newest(spark, out).collect()} == {"i0": 6, "i1": 4}


def test_a_batch_lost_in_the_sink_is_counted_once(spark, tmp_path):
    path, out, check = (str(tmp_path / x) for x in ("t/transaction_items.parquet", "out", "check"))
    for ids in ([1, 2, 3], [4], [5]):
        items(spark, path, ids)
    seen = []

    def partial(batch):
        seen.append(1)
        if len(seen) == 2:
            raise RuntimeError("lost")
        return batch.groupBy("item_id").agg(F.sum("quantity").alias("n"))

    run = lambda: incremental.partials(incremental.stream_table(spark, str(tmp_path / "t"), "transaction_items", 1), check, out, partial)
    with pytest.raises(Exception):
        run()
    assert {r.item_id: r.n for r in run().groupBy("item_id").agg(F.sum("n").alias("n")).collect()} == {"i0": 6, "i1": 9} and len(seen) == 4


def test_crash_between_store_and_sink_replays_to_the_same(spark, tmp_path):
    schema = "request_id long, data_type int, position long, delivery_id long, received_at timestamp"
    path = str(tmp_path / "m" / "receiver_messages.parquet")
    spark.sql("select * from values (1L,1,1L,10L,timestamp'2024-01-02 00:00:00'),(1L,1,1L,11L,timestamp'2024-01-01 00:00:00'),(1L,1,2L,12L,null) t(request_id,data_type,position,delivery_id,received_at)").write.parquet(path)
    store = MessageStore(spark, str(tmp_path / "store"), ["request_id", "data_type", "position"], "received_at", "delivery_id")
    stream = lambda: incremental.stream_table(spark, str(tmp_path / "m"), "receiver_messages")

    def crash(batch, n):
        store.upsert(batch, n)
        raise RuntimeError("lost before the sink")

    with pytest.raises(Exception):
        incremental.run_to_end(stream(), str(tmp_path / "c"), crash)
    again = MessageStore(spark, str(tmp_path / "store"), store.keys, "received_at", "delivery_id")
    incremental.first_deliveries(stream(), str(tmp_path / "c"), again, str(tmp_path / "out"))
    assert [r.delivery_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [10]
    assert sorted(r.delivery_id for r in again.read().collect()) == [11, 12]
    assert schema and local_session
