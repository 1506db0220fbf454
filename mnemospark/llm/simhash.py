"""SimHash near-duplicates with pivot distance tables.

Fingerprint: 64 majority bits over the XXH64 (seed 42) of all word shingles.
Equal fingerprints are one row from then on. A table holds each distinct
fingerprint's Hamming distances to ``PIVOTS`` reference fingerprints; a pair
whose distances to any reference differ by more than the bound cannot be
within the bound (triangle inequality) and is discarded before the exact
distance is taken. Every candidate pair, however it was found, passes the
table first and is then verified.

Distances to references do not form a join key (a random pair passes one
coordinate with probability 0.57), so pairs are brought together by the
pigeonhole rule: of ``blocks`` bit blocks at most ``bound`` can differ, hence
some choice of blocks - bound blocks agrees. That is exact for any number of
blocks. Inside one group of agreeing blocks pairs are not all formed: members
are first tied to two references of the group itself, and only pairs still in
different components are compared. Groups above ``group_most`` members do not
form pairs at all: each member emits every fingerprint within half the bound,
and equal ones meet, each with the least that has it (also exact, and linear in
the group; two that meet there are at most the bound apart).

Defined cases: null, empty or blank text has fingerprint zero and links like
any other; repeated rows are returned each; null ids never name a component
unless all ids in it are null; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm import nativetext as nt
from mnemospark.llm.bytewords import _splitmix, bounded_batches, tidy
from mnemospark.operators.components import connected_components
from mnemospark.scratch import by_shuffle, materialize

PIVOTS = 16
_BLOCK_BYTES = 4 << 20


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def pivots() -> list[int]:
    return [_signed(int(x)) for x in _splitmix(PIVOTS, 64)]


def _word_blocks(text: bytes):
    """The words of a text, some MB at a time."""
    at = 0
    while len(text) - at > _BLOCK_BYTES:
        end = at + _BLOCK_BYTES
        while end < len(text) and not text[end : end + 1].isspace():
            end += 1
        yield text[at:end].split()
        at = end
    yield text[at:].split()


def fingerprint(text: str | None, size: int = 4) -> int:
    """Unsigned 64-bit SimHash over ``size``-word shingles, repeats included."""
    digest = xxhash.xxh64_intdigest
    ones, total, carry = np.zeros(64, np.int64), 0, []
    for block in _word_blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        words = carry + block
        if len(words) >= size:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = (ends - [len(w) + 1 for w in words])[: len(words) - size + 1].tolist()
            stops = (ends[size - 1 :] - 1).tolist()
            hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts, stops)], dtype="<u8")
            for lo in range(0, len(hashes), 1 << 16):
                part = hashes[lo : lo + (1 << 16)]
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(hashes)
        carry = words[-(size - 1) :] if size > 1 else []
    if not total and carry:
        return digest(b" ".join(carry), 42)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0]) if total else 0


def _fingerprints(id_type: pa.DataType, size: int):
    schema = pa.schema([("doc_id", id_type), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            out = [_signed(fingerprint(text[i].as_py(), size)) for i in range(len(text))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.int64())], schema=schema)

    return run


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, fp (signed 64-bit) of every row."""
    from pyspark.sql.pandas.types import to_arrow_type

    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    return docs.select("doc_id", "text").mapInArrow(tidy(_fingerprints(to_arrow_type(kind), size)), f"doc_id {kind.simpleString()}, fp long")


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _coordinates(fp: Column) -> Column:
    """The distances to all references, a byte each, eight to a number."""
    words = []
    for lo in range(0, PIVOTS, 8):
        word = F.lit(0).cast("long")
        for i, p in enumerate(pivots()[lo : lo + 8]):
            word = word.bitwiseOR(F.shiftleft(_distance(fp, F.lit(p)).cast("long"), 8 * i))
        words.append(word)
    return F.struct(*[w.alias(f"p{i}") for i, w in enumerate(words)])


def _allowed(a: Column, b: Column, bound: int) -> Column:
    """Whether no coordinate of two rows of the table differs by more than the bound."""
    byte = lambda c, i: F.shiftrightunsigned(c[f"p{i // 8}"], 8 * (i % 8)).bitwiseAND(255)
    keep = F.lit(True)
    for i in range(PIVOTS):
        keep &= F.abs(byte(a, i) - byte(b, i)) <= bound
    return keep


def _verified(pairs: DataFrame, bound: int) -> DataFrame:
    """(a, b, near_a, near_b) that pass the table and then the exact distance: a, b."""
    return pairs.where(_allowed(F.col("near_a"), F.col("near_b"), bound)).where(_distance(F.col("a"), F.col("b")) <= bound).select("a", "b")


def _block_masks(blocks: int, bound: int) -> list[int]:
    edge = [64 * i // blocks for i in range(blocks + 1)]
    return [_signed(sum((1 << edge[i + 1]) - (1 << edge[i]) for i in chosen)) for chosen in combinations(range(blocks), blocks - bound)]


def _half_variants(bound: int):
    flips = [0] + [sum(1 << b for b in chosen) for n in range(1, bound // 2 + 1) for chosen in combinations(range(64), n)]
    flips = np.array(flips, dtype=np.uint64)
    schema = pa.schema([("fp", pa.int64()), ("key", pa.int64())])

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for lo in range(0, len(fp), 64):
                part = fp[lo : lo + 64]
                keys = part.view(np.uint64)[:, None] ^ flips[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, len(flips))), pa.array(keys.ravel().view(np.int64))], schema=schema)

    return run


def link_fingerprints(fps: DataFrame, bound: int = 4, blocks: int = 7, group_most: int = 256) -> DataFrame:
    """(node, component) of all distinct fingerprints that have a partner within ``bound`` bits."""
    if bound % 2 or blocks <= bound:
        raise ValueError("bound must be even and below the number of blocks")
    masks = _block_masks(blocks, bound)
    spread = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but each becomes many rows
    table = fps.repartition(spread, F.xxhash64("fp")).select("fp", _coordinates(F.col("fp")).alias("near"))
    which = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "bits")
    keyed = table.select("fp", "near", which)
    row = F.struct("fp", "near")
    groups = keyed.groupBy("choice", "bits").agg(F.count("*").alias("members"), F.min(row).alias("low"), F.max(row).alias("high")).where("members > 1")
    shared = materialize(keyed.join(by_shuffle(groups), ["choice", "bits"]), "shared")  # Spark guesses the keys as small as the fingerprints
    stars = shared.select(F.col("fp").alias("a"), F.col("near").alias("near_a"), F.explode(F.array("low", "high")).alias("to")).select("a", "near_a", F.col("to.fp").alias("b"), F.col("to.near").alias("near_b"))
    first = connected_components(_verified(stars.where("a <> b"), bound))
    labelled = shared.drop("low", "high").join(by_shuffle(first.withColumnRenamed("node", "fp")), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    several = labelled.groupBy("choice", "bits").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("choice", "bits")
    open_ = materialize(labelled.join(by_shuffle(several), ["choice", "bits"], "left_semi").select("choice", "bits", "fp", "near", "component", "members"), "open")
    small, large = open_.where(F.col("members") <= group_most), open_.where(F.col("members") > group_most)
    left = small.select("choice", "bits", F.col("fp").alias("a"), F.col("near").alias("near_a"), F.col("component").alias("of_a"))
    right = small.select("choice", "bits", F.col("fp").alias("b"), F.col("near").alias("near_b"), F.col("component").alias("of_b"))
    pairs = _verified(left.join(by_shuffle(right), ["choice", "bits"]).where("of_a < of_b"), bound)
    edges = first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(pairs)
    if large.take(1):
        variants = large.select("fp").distinct().mapInArrow(tidy(_half_variants(bound)), "fp long, key long")
        least = variants.groupBy("key").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b <> top").drop("top")
        met = variants.join(by_shuffle(least), "key").select(F.col("fp").alias("a"), "b").where("a <> b")
        edges = edges.unionByName(_verified(met.select("a", "b", _coordinates(F.col("a")).alias("near_a"), _coordinates(F.col("b")).alias("near_b")), bound))
    return connected_components(edges)


def near_duplicates(docs: DataFrame, size: int = 4, bound: int = 4, blocks: int = 7) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row."""
    marked = materialize(fingerprints(docs, size), "simhash")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = link_fingerprints(distinct.select("fp"), bound, blocks)
    named = distinct.join(by_shuffle(linked.withColumnRenamed("node", "fp")), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(by_shuffle(ids), "root").select("fp", "component_id")
    return marked.join(by_shuffle(of), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, size: int = 4, bound: int = 4, blocks: int = 7) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each group of near-duplicates
    is left: the one with the least (id, row key); a null id comes last, and rows
    equal in id and text count once."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), nt.row_key().alias("row"))
    place = F.struct(F.col("doc.doc_id").isNull().alias("no_id"), F.col("doc.doc_id").alias("doc_id"), F.col("row"))
    marked = materialize(fingerprints(docs.select(nt.row_key().alias("doc_id"), "text"), size).withColumnRenamed("doc_id", "row"), "simhash")
    linked = link_fingerprints(marked.select("fp").distinct(), bound, blocks).toDF("fp", "component")
    named = marked.join(by_shuffle(linked), "fp", "left").select("row", F.coalesce("component", "fp").alias("root"))
    first = whole.select("row", place.alias("place")).join(by_shuffle(named.distinct()), "row").groupBy("root").agg(F.min("place").alias("first"))
    kept = whole.join(by_shuffle(first.select(F.col("first.row").alias("row"))), "row", "left_semi").dropDuplicates(["row"])
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
