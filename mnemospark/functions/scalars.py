"""Column functions of the engine: pure expressions, evaluated inside codegen.

Fixed values (half-lives, thresholds, word lists, patterns) stand together at
the top of the section that uses them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
DAY = 86_400.0
FACT_TIME, PREFERENCE_TIME = 365 * DAY, 60 * DAY  # characteristic times of evidence, seconds
SALIENCE_HALF_LIFE = {"Episodic": 30 * DAY, "Semantic": 365 * DAY, "Consolidated": 90 * DAY}
RECENCY_HALF_LIFE = 90 * DAY
EXACT_ID = r"\b[A-Z][A-Z0-9]+-\d+\b"
TITLE_CASE = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
LIST_INTENT = r"\b(list|every|enumerate|how many|how much|all of|name (all|every|the)|which of|what are|what were|what kinds? of|what types? of)\b"  # on lower-case text
TEMPORAL = r"\b(yesterday|today|tomorrow|last\s+(week|month|year|\d+\s+days?|\d+\s+weeks?|\d+\s+months?)|next\s+(week|month|year)|\d{4}-\d{2}-\d{2})\b"  # on lower-case text
ALL_CAPS = r"^(?=.*[A-Z0-9])[A-Z0-9_-]+(\s+[A-Z0-9_-]*[A-Z0-9][A-Z0-9_-]*)*$"
TOKEN = r"[\p{L}\p{N}]+"
LEADING_ARTICLE = r"^(the|a|an|this|that) "
NON_REFERENTIAL = (
    "i you we they he she it me us him her them "
    "myself yourself himself herself itself ourselves yourselves themselves "
    "my your our their his its this that these those the a an "
    "who whom whose someone something anyone everyone nobody"
).split()


# --- numbers ----------------------------------------------------------------
def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded after a nudge that keeps ties from falling either way."""
    return F.round(c + F.lit(1e-9), digits)


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def confidence_bucket(c: Column) -> Column:
    """0 to 10."""
    return F.floor(clamp01(c) * 10).cast("int")


def proximity(hop: Column) -> Column:
    return F.lit(1.0) / (hop + 1)


def geometric_mean(values: Column) -> Column:
    """Of an array; 0 if it is empty or holds a number that is not positive."""
    logs = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.log(x))
    return F.when((F.size(values) > 0) & F.forall(values, lambda x: x > 0), F.exp(logs / F.size(values))).otherwise(0.0)


def evidence_decay(kind: Column, age_seconds: Column) -> Column:
    """exp(-age/h); events keep their confidence, a future time counts as now."""
    age = F.greatest(age_seconds, F.lit(0)).cast("double")
    return F.when(kind == "Event", 1.0).when(kind == "Preference", F.exp(-age / PREFERENCE_TIME)).otherwise(F.exp(-age / FACT_TIME))


def noisy_or(x: Column) -> Column:
    """Aggregate: 1 - product of (1 - x), x clamped; 1 as soon as one x is 1; 0 for none."""
    x = F.when(x.isNotNull(), clamp01(x))
    return F.coalesce(F.when(F.max(x) >= 1, 1.0).otherwise(1 - F.exp(F.sum(F.when(x < 1, F.log(1 - x))))), F.lit(0.0))


def salience_decay(initial: Column, age_seconds: Column, kind: Column) -> Column:
    life = F.lit(SALIENCE_HALF_LIFE["Episodic"])
    for name, seconds in SALIENCE_HALF_LIFE.items():
        life = F.when(kind == name, seconds).otherwise(life)
    return initial * F.pow(F.lit(2.0), -F.greatest(age_seconds, F.lit(0)) / life)


def boosted(salience: Column, hits: Column, factor: float = 1.1) -> Column:
    return F.least(F.lit(1.0), salience * F.pow(F.lit(factor), hits))


# --- vectors ----------------------------------------------------------------
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


# --- text -------------------------------------------------------------------
def tokens(text: Column) -> Column:
    """Lower-case letter and digit runs, unstemmed."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def normalize_name(name: Column) -> Column:
    """Lower-case, single spaces, one leading article dropped unless nothing is left."""
    flat = F.trim(F.regexp_replace(F.lower(name), "\\s+", " "))
    bare = F.regexp_replace(flat, LEADING_ARTICLE, "")
    return F.when(bare == "", flat).otherwise(bare)


def trigrams(normalized: Column) -> Column:
    """Distinct three-character windows of each word, padded with two spaces before and one after."""
    padded = F.transform(F.filter(F.split(normalized, "\\s+"), lambda w: w != ""), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def capitalized_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TITLE_CASE), F.lit(0))


def router_features(text: Column) -> Column:
    lower = F.lower(text)
    return F.struct(
        text.rlike(EXACT_ID).alias("exact_id"),
        text.rlike(ALL_CAPS).alias("all_caps"),
        text.rlike(TITLE_CASE).alias("title_case"),
        lower.rlike(LIST_INTENT).alias("list_intent"),
        lower.rlike(TEMPORAL).alias("temporal"),
    )


def mention_acceptable(text: Column) -> Column:
    """Not empty, at most six words and 50 characters, not a quantity (a number and one or two words)."""
    t = F.trim(text)
    words = F.split(t, "\\s+")
    quantity = F.get(words, F.lit(0)).rlike("^[0-9,.]+$") & (F.size(words) <= 3)
    return (t != "") & (F.size(words) <= 6) & (F.length(t) <= 50) & ~quantity


def non_referential(text: Column) -> Column:
    """Pronouns, determiners and the like, or nothing at all."""
    t = F.lower(F.trim(text))
    return (t == "") | t.isin(*NON_REFERENTIAL)


def edge_weight_valid(kind: Column, weight: Column) -> Column:
    return F.when(kind == "Contradicts", weight.between(-1, 1)).otherwise(weight.between(0, 1))


# --- time -------------------------------------------------------------------
def open_overlap(valid_from: Column, valid_to: Column, low: Column, high: Column) -> Column:
    """Closed overlap of a validity window with [low, high]; null ends are open."""
    return (valid_from.isNull() | (valid_from <= high)) & (valid_to.isNull() | (valid_to >= low))


def is_current(valid_from: Column, valid_to: Column, superseded_by: Column, tombstoned: Column, now: Column) -> Column:
    """Half-open: valid_from <= now < valid_to."""
    return ~tombstoned & superseded_by.isNull() & (valid_from.isNull() | (valid_from <= now)) & (valid_to.isNull() | (now < valid_to))


def as_of(extracted_at: Column, invalidated_at: Column, when: Column) -> Column:
    """Known at ``when`` on the record axis."""
    return (extracted_at <= when) & (invalidated_at.isNull() | (invalidated_at > when))
