"""Quality rules: a threshold table compiled into one projection.

Metrics are built-in expressions over whole texts; ``THRESHOLDS`` lists the
rules (metric, lowest and highest value allowed) and ``verdict`` compiles the
table into one boolean expression. No user functions run.

Defined cases: null, empty or blank text has no words, so every metric is 0
and the row fails the base rule; lines equal up to the last character are
equal; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm import nativetext as nt

SYMBOLS = "[#*$%&|<>]"
#: Common function words of the corpus languages.
STOP_WORDS = (
    "the of and to in is that for it was on are as with be by this from at or an a "
    "der die das und ist nicht ein eine von mit den zu im dem des auf für als auch sich "
    "le la les de des et un une du en que qui est pour dans par sur au plus pas ce il "
    "el los las y del se por con una para su al lo como más o pero que es"
).split()
#: metric, lowest value allowed, highest value allowed (None: no bound)
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("n_words", 50, None),
    ("mean_word_chars", 2.0, 14.0),
    ("symbols_per_word", None, 0.3),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
    ("repeat_word_ratio", None, 0.5),
]


def with_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words."""
    base = docs.select("doc_id", "text", nt.spaced(F.col("text")).alias("_sp")).select("*", nt.words(F.col("_sp")).alias("_w"), F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: line.rlike(nt.WORD)).alias("_lines"))
    w, n = F.col("_w"), F.size("_w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(nt.at(w, i), nt.at(w, i + 1), nt.at(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    base = base.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.replace(F.col("_sp"), F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        windows.alias("_t"),
    )
    # only a text with a repeated window is sorted: window hashes with their places, equal ones side by side
    t = F.col("_t")
    repeats = F.size(F.array_distinct(t)) < F.size(t)
    base = base.select("*", F.when(repeats, F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    s = F.col("_s")
    same = lambda i: (nt.at(s, i)["h"] == nt.at(s, i - 1)["h"]) | (nt.at(s, i)["h"] == nt.at(s, i + 1)["h"])
    found = F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(same(i), F.lit(False))), lambda i: nt.at(s, i)["i"])
    base = base.select("*", F.when(s.isNotNull(), F.sort_array(found)).alias("_p"))
    p, k = F.col("_p"), F.size("_p")
    covered = F.aggregate(F.zip_with(F.slice(p, 1, k - 1), F.slice(p, 2, k - 1), lambda a, b: F.least(F.lit(3), b - a)), F.lit(3), lambda total, x: total + x)
    return base.select("*", F.when(p.isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words")).drop("_t", "_s", "_p")


def metrics() -> dict[str, Column]:
    words = F.greatest("n_words", F.lit(1))
    return {
        "n_words": F.col("n_words"),
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "stop_word_ratio": F.col("n_stop_words") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_word_ratio": F.col("n_repeat_words") / words,
    }


def verdict(table: list[tuple[str, float | None, float | None]] = THRESHOLDS) -> Column:
    """True where every rule of the table holds."""
    of, good = metrics(), F.lit(True)
    for metric, low, high in table:
        if low is not None:
            good &= of[metric] >= low
        if high is not None:
            good &= of[metric] <= high
    return good


def judge(docs: DataFrame, table: list[tuple[str, float | None, float | None]] = THRESHOLDS) -> DataFrame:
    """doc_id, counts, base_failed and kept of every row."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return with_counts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(table)).alias("kept"))
