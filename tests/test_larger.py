"""Queries on tables with more rows of a key than the small ones have."""

import os
import random
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from oracle import duck_rows, spark_rows

from mnemospark import queries as q
from mnemospark.operators import lifecycle


@pytest.fixture(scope="module")
def hub(spark, sf, tmp_path_factory):
    """The small tables, with 450 customers that live in the nation of the first supplier."""
    out = str(tmp_path_factory.mktemp("hub"))
    for name in ("supplier", "nation", "region", "orders"):
        os.symlink(f"{sf}/{name}.parquet", f"{out}/{name}.parquet")
    nation = spark.read.parquet(f"{sf}/supplier.parquet").where("s_suppkey = 1").first()["s_nationkey"]
    c = spark.read.parquet(f"{sf}/customer.parquet").withColumn("c_nationkey", F.lit(nation))
    copies = c.crossJoin(spark.range(3).toDF("copy")).withColumn("c_custkey", F.col("c_custkey") + 150 * F.col("copy"))
    copies.drop("copy").coalesce(1).write.parquet(f"{out}/parts")
    os.rename(next(f"{out}/parts/{f}" for f in os.listdir(f"{out}/parts") if f.endswith(".parquet")), f"{out}/customer.parquet")
    return out


@pytest.mark.parametrize("name", ["graph_star", "statement_pivot"])
def test_hubs_keep_all_their_edges(spark, hub, name):
    assert spark_rows(q.queries()[name](spark, hub)) == duck_rows(q.oracle_sql()[name], hub)


def test_lag_forms_no_pairs(spark):
    rnd = random.Random(4)
    feed = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(400)])) for _ in range(3000)]
    consumers = [(i % 90, rnd.choice(["a", "b", "c", None]), rnd.choice([None, *range(-5, 405)])) for i in range(100)]
    out = lifecycle.lagging(spark.createDataFrame(consumers, "consumer long, topic string, lsn long"), spark.createDataFrame(feed, "topic string, lsn long"), 100)
    assert not re.search(r"Join [^\n]* [<>] ", out._jdf.queryExecution().optimizedPlan().toString())
    behind, head = {}, {}
    for t, x in feed:
        if t is not None and x is not None:
            head[t] = max(head.get(t, x), x)
    for c, t, at in consumers:
        behind[c] = behind.get(c, 0) + sum(1 for u, x in feed if None not in (t, at, x) and u == t and x > at)
    want = [(c, at if behind[c] > 100 else head.get(t, at), behind[c], "overloaded" if behind[c] > 100 else "live") for c, t, at in consumers]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_lag_of_users_without_topic(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    user = events.agg(F.min("user_id")).first()[0]
    events = events.withColumn("event_type", F.when(F.col("user_id") != user, F.col("event_type")))
    events.withColumn("user_id", F.when(F.col("event_id") % 50 != 0, F.col("user_id"))).coalesce(1).write.parquet(str(tmp_path / "parts"))
    os.rename(next(tmp_path.glob("parts/*.parquet")), tmp_path / "events.parquet")
    name = "lagging_consumers"
    assert spark_rows(q.queries()[name](spark, str(tmp_path))) == duck_rows(q.oracle_sql()[name], str(tmp_path))
