"""Line dedup by a deletion-neighbourhood join (edit bound 1).

A line (lower-cased, trimmed, with a letter or digit, at least ``min_chars``
characters: 1 unless asked otherwise) goes if an earlier line, in the order of
(doc_id, row key, line number), equals it or lies within one edit: one
character inserted, deleted or substituted.

Equal lines are one class, named by its earliest line. A class emits, as
hashed keys, the variants that one deletion makes of it: with the place of the
deletion (two lines of one length that share such a key differ by one
substitution) and without it (a line's variant equal to another whole line
differs by one insertion). Equal keys are joined to the earliest class that has
the key - one partner for each key, never all pairs - and the edit distance of
each candidate pair is then verified on the texts.

Only classes that can have a partner emit variants: an edit leaves the first
or the last half of a line as it was, so a class whose halves no other class
of a fitting length shares is settled. Halves and classes travel as hashes;
texts are read again for the rest. Every join of a long side to one row a key
is between two written tables, so the engine splits a key that holds much of
the long side at run time.

Defined cases: a row is known by a hash of its id and text (the row key), so
rows that share an id are documents of their own, and rows equal in both are
one document; a null id sorts first; null and empty texts stay as they are;
shorter lines and lines without a letter or digit always stay; a document whose
lines all go keeps an empty text; a very long line costs time in proportion to
its length; other columns ride along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm import bytewords as bw
from mnemospark.llm import nativetext as nt
from mnemospark.scratch import materialize

SAME_PLACE, WHOLE, DELETED = 0, 1, 2
_BATCH = 200_000


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, row, no (line number from 0), line (normalised) of the lines that count."""
    cut = docs.select("doc_id", nt.row_key().alias("row"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return cut.select("doc_id", "row", "no", F.lower(F.btrim("line", F.lit(" \t\x0b\x0c\r"))).alias("line")).where((F.length("line") >= min_chars) & F.col("line").rlike("[\\p{L}\\p{N}]"))


def _half_keys(line: Column, n: Column) -> list[Column]:
    """Keys of both halves, tagged by the shorter length of the pair they can join: n (the first two) and n - 1."""
    keys = []
    for short in (0, 1):
        m = n - short
        half = F.floor(m / 2).cast("int")
        keys.append(F.xxhash64(F.lit("first"), m, F.substring(line, F.lit(1), half)))
        keys.append(F.xxhash64(F.lit("last"), m, F.substring(line, n - (m - half) + 1, m - half)))
    return keys


def deletion_keys(line: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys with place, keys without place, key of the whole line), 64-bit."""
    code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(code)
    sums = bw.prefix_hash(bw.mix((code + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)))
    back = bw.powers(2)[1][1]
    left = sums[:n] + (sums[n] - sums[1:]) * back
    bare = bw.mix(left + np.uint64((n - 1) % (1 << 64)))
    placed = bw.mix(bare ^ bw.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return placed.view(np.int64), bare.view(np.int64), int(bw.mix(sums[n : n + 1] + np.uint64(n)).view(np.int64)[0])


def _variants(id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("row", pa.int64()), ("no", pa.int32()), ("kind", pa.int8()), ("key", pa.int64())])

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("line", "same", "whole", "del")]
            ids, kinds, keys, held = [], [], [], 0

            def flush():
                at = np.repeat(np.array([i for i, _ in ids]), [n for _, n in ids])
                rows = pa.array(at)
                return pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in ("doc_id", "row", "no")], pa.array(np.concatenate(kinds)), pa.array(np.concatenate(keys))], schema=schema)

            for i, (line, same, whole, deleted) in enumerate(zip(*columns)):
                placed, bare, key = deletion_keys(line)
                for kind, wanted, part in ((SAME_PLACE, same, placed), (WHOLE, whole, np.array([key])), (DELETED, deleted, np.unique(bare))):
                    if wanted:
                        ids.append((i, len(part)))
                        kinds.append(np.full(len(part), kind, np.int8))
                        keys.append(part)
                        held += len(part)
                if held > _BATCH:
                    yield flush()
                    ids, kinds, keys, held = [], [], [], 0
            if held:
                yield flush()

    return run


def within_one(a: str, b: str) -> bool:
    """Whether at most one edit lies between two lines, in time linear in their length."""
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1:
        return False
    low, high = 0, len(a)  # the common start, by halving
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


def _verified(batches):
    schema = pa.schema([("row", pa.int64()), ("no", pa.int32())])
    for batch in batches:
        near = [within_one(a, b) for a, b in zip(batch.column("line").to_pylist(), batch.column("p_line").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("row").filter(pa.array(near, pa.bool_())), batch.column("no").filter(pa.array(near, pa.bool_()))], schema=schema)


def repeated_lines(docs: DataFrame, min_chars: int = 1, max_edits: int = 1, broadcast_rows: int = 200_000) -> DataFrame:
    """(row, no, near): the lines that go, and whether only a near copy is earlier.

    Up to ``broadcast_rows`` open classes (counted; some 30 bytes each) fetch
    their texts by a broadcast, more by a shuffle.
    """
    if max_edits != 1:
        raise ValueError("the keys are made for one edit")
    from pyspark.sql.pandas.types import to_arrow_type

    bw.bounded_batches(docs.sparkSession)
    lines = _lines(docs.select("doc_id", "text"), min_chars)
    n, place = F.length("line"), F.struct("doc_id", "row", "no")
    slim = lines.select("doc_id", "row", "no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), F.array(*_half_keys(F.col("line"), n)).alias("halves"))
    slim = materialize(slim, "lines")
    classes = slim.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("times"), F.any_value("halves").alias("halves"))
    classes = materialize(classes, "classes")

    # half of the class's hash is enough here: a collision opens a class for nothing, no more
    halves = classes.select("h1", F.posexplode("halves").alias("i", "key")).select("h1", "key", (F.col("i") < 2).alias("is_short"))
    shared = halves.groupBy("key").agg(F.count_if("is_short").alias("short"), F.count_if(~F.col("is_short")).alias("long")).where("short >= 2 OR (short >= 1 AND long >= 1)")
    shared = materialize(shared.select("key", (F.col("short") >= 2).alias("twins"), ((F.col("short") >= 1) & (F.col("long") >= 1)).alias("both")), "shared")
    is_short = F.col("is_short")
    open_ = halves.join(shared, "key").groupBy("h1").agg(F.max(is_short & F.col("twins")).alias("same"), F.max(is_short & F.col("both")).alias("whole"), F.max(~is_short & F.col("both")).alias("del"))
    open_ = open_.where("same OR whole OR del").join(classes.select("h1", "first"), "h1").select("first.row", "first.no", "same", "whole", "del")
    open_ = materialize(open_, "halves")
    if open_.count() <= broadcast_rows:
        open_ = F.broadcast(open_)
    texts = materialize(lines.join(open_, ["row", "no"]).dropDuplicates(["row", "no"]), "open")

    kind = docs.schema["doc_id"].dataType
    keys = texts.mapInArrow(bw.tidy(_variants(to_arrow_type(kind))), f"doc_id {kind.simpleString()}, row long, no int, kind tinyint, key long")
    earliest = keys.groupBy("key").agg(*[F.min(F.when(F.col("kind") == k, place)).alias(f"f{k}") for k in (SAME_PLACE, WHOLE, DELETED)], F.count("*").alias("members")).where("members > 1").drop("members")
    earliest = materialize(earliest, "earliest")
    partner = F.when(F.col("kind") == SAME_PLACE, F.col("f0")).when(F.col("kind") == WHOLE, F.col("f2")).otherwise(F.col("f1"))
    candidates = keys.join(earliest, "key").select("doc_id", "row", "no", partner.alias("partner")).where(F.col("partner") < place).select("row", "no", "partner.row", "partner.no").toDF("row", "no", "p_row", "p_no").distinct()
    own = texts.select("row", "no", "line")
    pairs = candidates.join(own, ["row", "no"]).join(own.toDF("p_row", "p_no", "p_line"), ["p_row", "p_no"])
    near = pairs.select("row", "no", "line", "p_line").mapInArrow(bw.tidy(_verified), "row long, no int").distinct().withColumn("near", F.lit(True))

    named = classes.select("h1", "h2", "times", "first.row", "first.no").join(near, ["row", "no"], "left").where("times > 1 OR near")
    named = materialize(named.select("h1", "h2", F.col("row").alias("f_row"), F.col("no").alias("f_no"), F.coalesce("near", F.lit(False)).alias("near")), "named")
    first = (F.col("row") == F.col("f_row")) & (F.col("no") == F.col("f_no"))
    return slim.select("row", "no", "h1", "h2").join(named, ["h1", "h2"]).where(~first | F.col("near")).select("row", "no", first.alias("near"))


def dedup(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """The columns of ``docs`` with the repeated lines taken out of text, then
    ``_lines``, ``_exact``, ``_near``: lines before, and lines that went (columns
    of these names in ``docs`` give way)."""
    docs = docs.drop("_lines", "_exact", "_near")
    gone = repeated_lines(docs, min_chars).distinct().groupBy("row").agg(F.collect_list("no").alias("gone"), F.count_if(~F.col("near")).alias("exact"), F.count_if(F.col("near")).alias("near"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), nt.row_key().alias("row"))  # no name of docs meets one of ours
    joined = whole.join(gone, "row", "left").withColumn("cut", F.split("doc.text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("cut") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("cut"), i)), "\n"))
    kept = [(text if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns]
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return joined.select(*kept, count(F.size("cut")).alias("_lines"), count(F.col("exact")).alias("_exact"), count(F.col("near")).alias("_near"))
