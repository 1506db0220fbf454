"""Lexical search: tokens, BM25, phrases and pseudo-relevance feedback.

For the terms of one cue each document is reduced to its length and term
counts in the scan itself; nothing is exploded. A batch of cues goes through
postings of the asked terms only.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import scalars as S
from mnemospark.operators.ranking import ranked, top_k
from mnemospark.scratch import materialize, spread

K1, B = 1.2, 0.75
#: Content terms of a cue that is still expanded.
MOST_TERMS = 3
#: Words that a lexical query drops.
STOP = frozenset(
    (
        "when what where who whom whose why how which "
        "did does do is are was were be been being am has have had will would shall should can could may might must "
        "the a an this that these those some any no "
        "of to in on at for and or with about from as by into over after before between out up down off than then so but if because "
        "it its i you he she they we his her hers their theirs your yours my mine our ours me him them us"
    ).split()
)


def content_terms(text: str) -> list[str]:
    """Query terms without function words and outer punctuation; the raw words if nothing else is left."""
    bare = (w.strip(string.punctuation).lower() for w in text.split())
    return list(dict.fromkeys(w for w in bare if w and w not in STOP)) or text.split()


def escaped(text):
    """A cue as the query parser may read it: an apostrophe parts a possessive from its owner."""
    return F.regexp_replace(text, "['\u2019]", " ")


def _idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def _equals(word: str):
    return lambda token: token == F.lit(word)


def term_counts(docs: DataFrame, terms: list[str], id_: str = "memory_id", text: str = "text") -> DataFrame:
    """id, length, tf (count of each term, in order)."""
    toks = spread(docs.select(id_, text)).select(id_, S.tokens(F.coalesce(text, F.lit(""))).alias("toks"))
    return toks.select(id_, F.size("toks").alias("length"), F.array(*[F.size(F.filter("toks", _equals(w))) for w in terms]).alias("tf"))


def bm25(docs: DataFrame, terms: list[str], id_: str = "memory_id", text: str = "text") -> DataFrame:
    """id, score of every document that holds a term."""
    if not terms:
        return docs.select(id_, F.lit(0.0).alias("score")).limit(0)
    counts = materialize(term_counts(docs, terms, id_, text), "terms")  # read twice: statistics, then scores
    stats = counts.agg(F.count("*"), F.avg("length"), *[F.count_if(F.get("tf", F.lit(i)) > 0) for i in range(len(terms))]).first()
    n, mean, dfs = stats[0], stats[1] or 1.0, stats[2:]
    score = F.lit(0.0)
    for i, df in enumerate(dfs):
        tf = F.get("tf", F.lit(i)).cast("double")
        score = score + _idf(n, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / mean))
    return counts.where(F.exists("tf", lambda x: x > 0)).select(id_, S.rounded(score).alias("score"))


def bm25_topk(docs: DataFrame, terms: list[str], k: int, id_: str = "memory_id", text: str = "text") -> DataFrame:
    return ranked(bm25(docs, terms, id_, text), "score", id_, k=k)


def phrase(docs: DataFrame, words: list[str], id_: str = "memory_id", text: str = "text") -> DataFrame:
    """Documents where the words stand side by side, and how often."""
    joined = F.concat(F.lit(" "), F.array_join(S.tokens(F.coalesce(text, F.lit(""))), "  "), F.lit(" "))
    wanted = F.lit(" " + "  ".join(words) + " ")
    times = ((F.length(joined) - F.length(F.replace(joined, wanted, F.lit("")))) / F.length(wanted)).cast("bigint")
    return docs.select(id_, times.alias("times")).where("times > 0")


def bm25_batch(docs: DataFrame, cues: DataFrame, k: int, id_: str = "memory_id") -> DataFrame:
    """cue_id, id, score, rank for many cues (cue_id, text) at once, by their content terms."""
    terms = cues.select("cue_id", F.explode(F.array_distinct(S.tokens("text"))).alias("term")).where(~F.col("term").isin(*STOP))
    toks = spread(docs.select(id_, "text")).select(id_, S.tokens(F.coalesce("text", F.lit(""))).alias("toks"))
    wanted = terms.select("term").distinct()
    tokens = toks.select(id_, F.size("toks").alias("length"), F.explode("toks").alias("term")).join(wanted, "term", "left_semi")
    postings = materialize(tokens.groupBy("term", id_, "length").agg(F.count("*").alias("tf")), "postings")
    total = spread(docs.select("text")).agg(F.count("*"), F.sum(F.regexp_count("text", F.lit(S.TOKEN)))).first()
    n, mean = total[0], (total[1] or 0) / max(total[0], 1) or 1.0
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    part = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    scored = postings.join(df, "term").select("term", id_, part.alias("part")).join(terms, "term").groupBy("cue_id", id_).agg(S.rounded(F.sum("part")).alias("score"))
    return ranked(scored, "score", id_, ("cue_id",), k)


def feedback_terms(docs: DataFrame, hits: DataFrame, known: list[str], n: int = 5, id_: str = "memory_id") -> DataFrame:
    """term, df, tf: words of at least three letters, function words apart, that two hits share, commonest first."""
    words = docs.join(hits.select(id_), id_, "left_semi").select(id_, F.explode(S.tokens("text")).alias("term")).where((F.length("term") >= 3) & ~F.col("term").isin(*known, *STOP))
    counts = words.groupBy("term").agg(F.count_distinct(id_).alias("df"), F.count("*").alias("tf")).where("df >= 2")
    return top_k(counts, n, F.desc("df"), F.desc("tf"), F.asc("term"))


def expanded(docs: DataFrame, terms: list[str], k: int, feedback: int = 5, id_: str = "memory_id", semantic: DataFrame | None = None) -> DataFrame:
    """BM25, the best hits' words added, both result lists united by greatest score.

    Only cues of at most ``MOST_TERMS`` content terms are expanded. Feedback
    comes from the hits of the semantic lane (id, rank) if given, else from BM25's.
    """
    first = bm25_topk(docs, terms, k, id_)
    if len([t for t in terms if t not in STOP]) > MOST_TERMS:
        return first
    hits = (first if semantic is None else semantic).where(F.col("rank") <= feedback)
    more = [r[0] for r in feedback_terms(docs, hits, terms, id_=id_).collect()]  # five terms at most
    second = bm25_topk(docs, terms + more, k, id_)
    return merged(first, second, k, id_)


def merged(a: DataFrame, b: DataFrame, k: int, id_: str = "memory_id") -> DataFrame:
    both = a.select(id_, "score").unionByName(b.select(id_, "score")).groupBy(id_).agg(F.max("score").alias("score"))
    return ranked(both, "score", id_, k=k)


def postings_stats(docs: DataFrame, id_: str = "memory_id") -> DataFrame:
    """term, df, cf over all documents."""
    words = spread(docs.select(id_, "text")).select(id_, F.explode(S.tokens(F.coalesce("text", F.lit("")))).alias("term"))
    return words.groupBy("term", id_).agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


