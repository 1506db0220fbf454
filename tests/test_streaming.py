"""Streams drain a batch of files and must give what the batch form gives."""

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import derive
from mnemospark.streaming import feed as W


@pytest.fixture()
def events(spark, sf, tmp_path):
    src = tmp_path / "events"
    spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id").coalesce(1).write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    return spark.read.parquet(str(src)), spark.readStream.schema(schema).parquet(str(src))


def _drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_subscription_stream_equals_batch(spark, events):
    batch, stream = events
    sub = W.Subscription(from_lsn=50, kinds=("click",), agents=(1, 2, 3))
    got = _drain(sub.apply(W.change_feed(stream)), "feed_sub").select("lsn")
    want = sub.apply(W.change_feed(batch)).select("lsn")
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in want.collect())


def test_followed_by_state_equals_window(spark, events):
    batch, stream = events
    got = _drain(W.followed_by(W.change_feed(stream)), "feed_follow").collect()
    tl = batch.select(F.col("event_id").alias("memory_id"), F.col("user_id").alias("agent"), F.col("ts").alias("created_at"))
    want = derive.predecessors(tl, ("agent",)).where("gap <= 1800").select("prev_id", "memory_id", "gap").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_sessions_stream(spark, events):
    _, stream = events
    feed = W.change_feed(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    got = _drain(W.session_counts(feed), "feed_sessions")
    assert got.count() > 0 and got.where("ended <= started").count() == 0


def test_upsert_sink_is_idempotent(spark, tmp_path):
    sink = W.upsert_sink(str(tmp_path / "t"), ["k"], "at")
    one = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, at int, v string")
    two = spark.createDataFrame([(1, 2, "c")], "k int, at int, v string")
    sink(one, 0)
    sink(two, 1)
    sink(two, 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t/v1")).collect())) == [(1, 2, "c"), (2, 1, "b")]


def test_requests_once(spark):
    r = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", "z")], "request_id string, hash string")
    assert {x.request_id: x.outcome for x in derive.idempotency(r).collect()} == {"a": "cached", "b": "conflict", "c": "fresh"}
