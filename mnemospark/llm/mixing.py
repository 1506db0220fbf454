"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources in code-point order (null last) weigh 3, 1, 2, 3, ... and share
``budget`` times all words; a source's target stops at ``most`` times its own
size and the excess is shared again by weight. Whole epochs of a source come
first; the rest of its target goes to documents in ascending order of
-ln(u)/w, where u is a hash of the document's id in (0, 1) and w its quality
weight, until the words run out; the last document is cut.

The order within a source is never built in one task: keys are counted in
2**12 ranges of their own distribution, the range where the target falls is
counted in 2**12 finer ones, and only the documents of one such range are
sorted. Source totals are broadcast below ``broadcast_sources`` sources
(checked by a count), else joined by shuffle.

Defined cases: null or empty text has size 0 and takes 0; a source without
words has target 0; a null id is drawn by its text; repeated rows are separate documents (rows equal in id and
text share the cut in either order); an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm import nativetext as nt
from mnemospark.scratch import materialize

BUCKETS = 4096
#: Weights of the sources, repeating.
WEIGHTS = (3, 1, 2)


def quality_weight(text: Column) -> Column:
    """1 for prose, less the more symbols a text has per character; at least 0.1."""
    share = F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")) / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))
    return F.greatest(F.lit(0.1), 1.0 - 4.0 * share)


def _uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """In (0, 1), from 52 bits of the MD5 of the id; of the text where there is no id."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.md5(text), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target of every source (``sizes``: source, source_size).

    The shares are filled like vessels of width weight and height most*size/weight:
    below the common level a source is full, above it the level decides.
    """
    weigh = F.get(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS))
    w = sizes.withColumn("weight", weigh).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("full", F.coalesce(F.sum("cap").over(upto), F.lit(0.0))).withColumn("wide", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    w = w.withColumn("all", F.lit(budget) * F.sum("source_size").over(everything)).withColumn("level", (F.col("all") - F.col("full")) / F.col("wide"))
    # the level of the first source that it does not fill holds for all from there on
    w = w.withColumn("first", F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("full"), F.col("wide"), F.col("level")))).over(everything))
    filled = F.least(F.col("cap").cast("double"), F.coalesce(F.col("first.level") * F.col("weight"), F.col("cap").cast("double")))
    return w.select("source", "source_size", filled.alias("target"))


def _keyed(docs: DataFrame, seed: str, weight: Column | None, *more: Column) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(nt.WORD)), F.lit(0)).cast("long")
    weight = quality_weight(F.col("text")) if weight is None else F.greatest(F.lit(0.001), F.coalesce(weight.cast("double"), F.lit(0.0)))
    key = -F.log(_uniform(F.col("doc_id"), F.col("text"), seed)) / weight
    keyed = docs.select("doc_id", "source", size.alias("size"), key.alias("mix_key"), *more)
    return keyed.withColumn("place", F.col("mix_key") / (1.0 + F.col("mix_key")))  # ascends with the key, in [0, 1), and keeps large keys apart


def _by_source(rows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    table = table.withColumnRenamed("source", "_src")
    return rows.join(F.broadcast(table) if small else table, F.col("source").eqNullSafe(F.col("_src"))).drop("_src")


def _within() -> Column:
    """place in [low, low + width), the last range closed."""
    top = F.col("low") + F.col("width")
    return (F.col("place") >= F.col("low")) & ((F.col("place") < top) | ((top >= 1.0) & (F.col("low") < 1.0)))


def _cuts(slim: DataFrame, budget: float, most: float, levels: int, broadcast_sources: int) -> tuple[DataFrame, bool]:
    """For each source: its target, whole epochs, and the range of places where
    the rest of the target ends, with the words still open at its lower end."""
    sources = materialize(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), budget, most), "sources")
    small = sources.limit(broadcast_sources + 1).count() <= broadcast_sources
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    each = sources.select("source", "source_size", "target", epochs.alias("epochs"))
    each = each.select("*", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long").alias("open"), F.lit(0.0).alias("low"), F.lit(1.0).alias("width"))
    # widths are powers of two, so ranges meet without rounding
    bucket = F.least(F.floor((F.col("place") - F.col("low")) / F.col("width") * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    for _ in range(levels):
        inside = _by_source(slim, each.select("source", "low", "width"), small).where(_within())
        counted = inside.groupBy("source", "low", "width", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cut = _by_source(counted.withColumn("before", before), each.select("source", "open"), small).where((F.col("before") <= F.col("open")) & (F.col("open") < F.col("before") + F.col("words")))
        cut = cut.select(F.col("source").alias("_src"), (F.col("low") + F.col("bucket") * F.col("width") / BUCKETS).alias("low2"), (F.col("width") / BUCKETS).alias("width2"), "before")
        # a source without words has no such range; its documents take nothing wherever they stand
        each = each.join(cut, F.col("source").eqNullSafe(F.col("_src")), "left").select("source", "source_size", "target", "epochs", (F.col("open") - F.coalesce("before", F.lit(0))).alias("open"), F.coalesce("low2", F.lit(2.0)).alias("low"), F.coalesce("width2", F.lit(1.0)).alias("width"))
        each = materialize(each, "cuts")
    return each, small


def _taken(rows: DataFrame, each: DataFrame, small: bool) -> DataFrame:
    joined = _by_source(rows, each, small)
    inner = Window.partitionBy("source").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    whole = joined.where(~_within()).withColumn("taken", F.col("size") * (F.col("epochs") + F.when(F.col("place") < F.col("low"), 1).otherwise(0)))
    left = F.greatest(F.lit(0), F.least(F.col("size"), F.col("open") - F.coalesce(F.sum("size").over(inner), F.lit(0))))
    part = joined.where(_within()).withColumn("taken", F.col("size") * F.col("epochs") + left)
    return whole.unionByName(part)


def mix(docs: DataFrame, budget: float = 1.5, most: float = 2.0, seed: str = "mix", levels: int = 2, broadcast_sources: int = 100_000, weight: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted) of every row.

    ``weight``: each document's quality weight, such as a classifier's score
    (0.001 at least); the share of symbols decides where none is given.
    """
    slim = materialize(_keyed(docs, seed, weight), "mix")
    each, small = _cuts(slim, budget, most, levels, broadcast_sources)
    return _taken(slim, each, small).select("doc_id", "source", "size", "source_size", "target", "taken")


def mix_texts(docs: DataFrame, budget: float = 1.5, most: float = 2.0, seed: str = "mix", levels: int = 2, broadcast_sources: int = 100_000, weight: Column | None = None) -> DataFrame:
    """The mix itself: the columns of ``docs`` and ``copy`` (1, 2), a row for every
    copy taken; the text of a copy that is cut ends after its last word taken.
    A column of ``docs`` named copy gives way. ``weight`` as of ``mix``."""
    docs = docs.drop("copy")
    slim = materialize(_keyed(docs, seed, weight), "mix")
    each, small = _cuts(slim, budget, most, levels, broadcast_sources)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    took = _taken(_keyed(docs, seed, weight, F.struct(*columns).alias("_doc")), each, small).where("taken > 0")
    copies = took.select("_doc", "size", "taken", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))).alias("copy"))
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    lead = F.when(F.col("_doc.text").rlike("^[\\x20\\x09-\\x0D]"), 1).otherwise(0)
    rest = F.get(F.split("_doc.text", "[\\x20\\x09-\\x0D]+", words + lead + 1), words + lead)
    text = F.when(words >= F.col("size"), F.col("_doc.text")).otherwise(F.substring(F.col("_doc.text"), F.lit(1), F.length("_doc.text") - F.length(rest)))
    return copies.select(*[(text if c == "text" else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns], "copy")
