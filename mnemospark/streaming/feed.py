"""The change feed on Structured Streaming: subscriptions, derived edges from
keyed state, idempotent upserts. Every transformation also runs on a batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def change_feed(events: DataFrame) -> DataFrame:
    """lsn, ts, agent, kind, value from the event table (batch or stream)."""
    return events.select(F.col("event_id").alias("lsn"), "ts", F.col("user_id").alias("agent"), F.col("event_type").alias("kind"), "value")


@dataclass(frozen=True)
class Subscription:
    """Set membership on agents and kinds, from a log position; an empty set is no filter."""

    from_lsn: int = 0
    agents: tuple[int, ...] = ()
    kinds: tuple[str, ...] = ()
    where: Column | None = None

    def apply(self, feed: DataFrame) -> DataFrame:
        out = feed.where(F.col("lsn") >= self.from_lsn)
        if self.agents:
            out = out.where(F.col("agent").isin(*self.agents))
        if self.kinds:
            out = out.where(F.col("kind").isin(*self.kinds))
        return out if self.where is None else out.where(self.where)


def project_records(events: DataFrame) -> DataFrame:
    """lsn, type, id: one log record gives an encode event and a link event for its edge."""
    edge = F.get_json_object("props", "$.k").cast("bigint")
    both = F.array(F.struct(F.lit("encode").alias("type"), F.col("event_id").alias("id")), F.struct(F.lit("link").alias("type"), edge.alias("id")))
    return events.select(F.col("event_id").alias("lsn"), F.explode(both).alias("e")).select("lsn", "e.type", "e.id").where("id IS NOT NULL")


def fresh_requests(requests: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """Each request_id once within the time to live (needs ``ts``)."""
    return requests.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["request_id"])


def session_counts(feed: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """agent, started, ended, n of sessions; late events are taken for ``late``."""
    return feed.withWatermark("ts", late).groupBy("agent", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("agent", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def followed_by(feed: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """src, dst, gap for consecutive events of an agent, by keyed state: the last
    event of each agent is all that is kept between batches."""
    import pandas as pd

    def step(key, batches, state):
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "lsn"])
        out = []
        for row in rows.itertuples():
            if last is not None and 0 <= (row.ts - last[1]).total_seconds() <= gap_seconds:
                out.append((int(last[0]), int(row.lsn), int((row.ts - last[1]).total_seconds())))
            if last is None or row.ts >= last[1]:
                last = (int(row.lsn), row.ts.to_pydatetime())
        state.update(last)
        yield pd.DataFrame(out, columns=["src", "dst", "gap"])

    slim = feed.select("agent", "lsn", F.col("ts").cast("timestamp").alias("ts"))
    return slim.groupBy("agent").applyInPandasWithState(step, "src long, dst long, gap long", "lsn long, ts timestamp", "append", "NoTimeout")


def upsert_sink(path: str, key: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the latest row of each key; a batch that is
    written twice changes nothing. Versions are folders named by batch id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        from pyspark.sql import Window

        spark = batch.sparkSession
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = sorted(int(f.getPath().getName()[1:]) for f in fs.listStatus(jvm_path) if f.getPath().getName().startswith("v")) if fs.exists(jvm_path) else []
        before = [v for v in done if v < batch_id]
        rows = batch if not before else spark.read.parquet(f"{path}/v{before[-1]}").unionByName(batch)
        place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
        rows.select("*", place.alias("_n")).where("_n = 1").drop("_n").write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return write
