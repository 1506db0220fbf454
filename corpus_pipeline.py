"""A training corpus from a table of documents: five stages, each over all that
its predecessor kept. Every stage takes (spark, docs, sf_dir) and returns the
columns of documents; the last one adds the number of the copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import decontam, langid, linededup, mixing, simhash
from mnemospark.scratch import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: no letter, or a best label with
    hardly more than chance (``langid.least_score``). A missing lang is filled in.

    Null and empty texts go; a null id, a shared id and repeated rows do not
    matter, each row is judged by its text; with no lang to learn from all rows go.
    """
    labelled = langid.label_rows(docs)
    kept = labelled.where((F.col("_lang_pred") != langid.UNKNOWN) & (F.col("_lang_lead") >= 0))
    return kept.select(*[F.coalesce("lang", "_lang_pred").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in labelled.columns[:-3]])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and with them documents of which no word is left.

    The earliest of equal or nearly equal lines stays (least id, a null id first,
    then the row key, then the line number). Null and empty texts stay as they
    are; rows that share an id are documents of their own; rows equal in id and
    text lose the same lines.
    """
    done = linededup.dedup(docs)
    changed = F.col("_exact") + F.col("_near") > 0
    kept = done.where(~changed | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return kept.select(*[F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in done.columns[:-3]])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays: the least id, a null
    id last, then the row key.

    Rows that share an id but no text stay apart; rows equal in id and text count
    once; all texts without a word are one group.
    """
    return simhash.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, whatever their id.

    A row is judged by its own text, so of rows that share an id only those that
    hold a passage go; null and empty texts stay; with an empty benchmark all stay.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row for each copy taken, numbered by ``copy``.

    Null and empty texts have no words and are not taken; rows that share an id
    are documents of their own; a null source is a source, the last one.
    """
    return mixing.mix_texts(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]
#: Trained models and fingerprints cannot be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
