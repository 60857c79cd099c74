"""When a stream of messages is complete, when a request is, and what comes late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATA, END = 1, 2


def stream_completeness(messages: DataFrame) -> DataFrame:
    """(request_id, data_type, end_position, n_positions, n_missing, complete, completed_at) of each stream.

    A stream has data at positions 1 to n-1 and an END at n. It is complete
    once all of them have come, in whatever order and however often;
    ``completed_at`` is when the last of them first came. Messages with null
    positions count for nothing; without END the end is unknown and the stream
    isn't complete. Of several END positions the smallest holds. Counts are
    made per position first, so repeats and large streams reach no single task: a stream that is a third of all messages
    is cut to a count by each.
    """
    seen = messages.where(F.col("position").isNotNull() & F.col("msg_type").isin(DATA, END))
    firsts = seen.groupBy("request_id", "data_type", "msg_type", "position").agg(F.min("received_at").alias("came"))
    ends = firsts.where(F.col("msg_type") == END).groupBy("request_id", "data_type").agg(F.min_by("came", "position").alias("end_came"), F.min("position").alias("end_position"))
    # a stream's end meets its positions before they are counted, so the counts combine on the map side
    bounds = ends.select(F.col("request_id").alias("r"), F.col("data_type").alias("d"), F.col("end_position").alias("end"))
    data = firsts.where((F.col("msg_type") == DATA) & (F.col("position") >= 1)).join(bounds, (F.col("request_id") == F.col("r")) & (F.col("data_type") == F.col("d")), "left")
    inside = data.where(F.col("end").isNull() | (F.col("position") < F.col("end")))
    counts = inside.groupBy(F.col("request_id").alias("cr"), F.col("data_type").alias("cd")).agg(F.count(F.lit(1)).alias("n_positions"), F.max("came").alias("data_came"))
    streams = seen.select("request_id", "data_type").distinct().join(ends, ["request_id", "data_type"], "left")
    counted = streams.join(counts, F.col("request_id").eqNullSafe(F.col("cr")) & F.col("data_type").eqNullSafe(F.col("cd")), "left").withColumn("n_positions", F.coalesce("n_positions", F.lit(0)))
    missing = F.col("end_position") - 1 - F.col("n_positions")
    complete = F.coalesce(missing == 0, F.lit(False))
    return counted.select("request_id", "data_type", "end_position", "n_positions", missing.alias("n_missing"), complete.alias("complete"), F.when(complete, F.greatest("data_came", "end_came")).alias("completed_at"))


def request_completeness(streams: DataFrame, inputs: int = 5) -> DataFrame:
    """(request_id, n_complete, complete): a request is complete when all its ``inputs`` streams are."""
    done = streams.groupBy("request_id").agg(F.sum(F.col("complete").cast("long")).alias("n_complete"))
    return done.withColumn("complete", F.col("n_complete") >= inputs)


def late_messages(messages: DataFrame, streams: DataFrame) -> DataFrame:
    """(delivery_id, request_id, data_type) of deliveries that came after their stream was complete."""
    done = streams.where("complete").select("request_id", "data_type", "completed_at")
    return messages.join(done, ["request_id", "data_type"]).where(F.col("received_at") > F.col("completed_at")).select("delivery_id", "request_id", "data_type")
