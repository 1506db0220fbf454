"""The engine's record types, mapped onto the star-schema and text tables.

Memory: a document (agent = source, context = lang, created a minute apart).
Statement: the priority of an order, about its customer. Evidence: its lines.
Entity: customers, suppliers, parts, nations, regions. Relation: supplies,
lives_in, part_of. Timeline: the event table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minutes_after(base: str, n) -> F.Column:
    return F.expr(f"TIMESTAMP_NTZ '{base}'") + F.make_dt_interval(F.lit(0), F.lit(0), n)


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.get(F.array(F.lit("Episodic"), F.lit("Semantic"), F.lit("Consolidated")), (F.col("doc_id") % 3).cast("int"))
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("memory_id"),
        F.col("source").alias("agent"),
        F.col("lang").alias("context"),
        kinds.alias("kind"),
        minutes_after(EPOCH, F.col("doc_id").cast("int")).alias("created_at"),
        F.least(F.lit(1.0), F.col("n_chars") / 10000.0).alias("salience"),
        "text",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """statement_id, subject, predicate, kind, object, extracted_at (not yet superseded)."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("statement_id"),
        F.col("o_custkey").alias("subject"),
        F.lit("order_priority").alias("predicate"),
        F.lit("Attribute").alias("kind"),
        F.col("o_orderpriority").alias("object"),
        F.col("o_orderdate").alias("extracted_at"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("statement_id"), F.col("o_custkey").alias("subject"), F.lit("order_status").alias("predicate"), F.col("o_orderstatus").alias("object"), F.col("o_orderdate").alias("extracted_at"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("statement_id"), F.col("l_partkey").alias("memory_id"), F.col("l_linenumber").alias("nth"), F.round(1 - F.col("l_discount") * 5, 3).alias("confidence"), F.col("l_shipdate").alias("ts")
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, kind, dst, weight: lives_in (customer to nation), based_in (supplier to nation), part_of (nation to region)."""
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    c = table(spark, sf_dir, "customer").select(node("c", "c_custkey").alias("src"), F.lit("lives_in").alias("kind"), node("n", "c_nationkey").alias("dst"), F.lit(0.9).alias("weight"))
    s = table(spark, sf_dir, "supplier").select(node("s", "s_suppkey").alias("src"), F.lit("based_in").alias("kind"), node("n", "s_nationkey").alias("dst"), F.lit(0.8).alias("weight"))
    n = table(spark, sf_dir, "nation").select(node("n", "n_nationkey").alias("src"), F.lit("part_of").alias("kind"), node("r", "n_regionkey").alias("dst"), F.lit(0.5).alias("weight"))
    return c.unionByName(s).unionByName(n)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("customer", "c", "c_custkey", "c_name"), ("supplier", "s", "s_suppkey", "s_name"), ("part", "p", "p_partkey", "p_name"), ("nation", "n", "n_nationkey", "n_name"), ("region", "r", "r_regionkey", "r_name")]
    out = None
    for name, letter, key, label in parts:
        one = table(spark, sf_dir, name).select(F.concat(F.lit(f"{letter}:"), F.col(key).cast("string")).alias("entity_id"), F.lit(name).alias("entity_type"), F.col(label).alias("name"))
        out = one if out is None else out.unionByName(one)
    return out


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("memory_id"), F.col("user_id").alias("agent"), F.col("event_type").alias("context"), F.col("ts").alias("created_at"), "value")
