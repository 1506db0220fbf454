"""The queries of this subpackage: each applies one operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import decontam, fm, langid, licenses, linededup, mixing, ppm, rules, simhash, warc
from mnemospark.scratch import spread

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name in ("documents", "pages") else table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "text", F.col("_lines").alias("n_lines"), F.col("_exact").alias("n_exact"), F.col("_near").alias("n_near"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = warc.resolve(warc.page_records(_table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return done.withColumn("headers", F.array_join(lines, "\n"))


def op6_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_table(spark, sf_dir, "documents"))


def op10_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP5_SQL = """
WITH p AS (SELECT page_id, url, md5(coalesce(html, '')) AS d, TIMESTAMP '2023-11-14 22:13:20' + to_seconds(page_id * 60) AS t FROM pages),
b AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare, substr(d, 1, 1) AS lead_ FROM p),
q AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)'))) AS kept FROM b),
c AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www[.]', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
        || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url FROM q),
v AS (SELECT *, CASE WHEN lead_ = '2' THEN t - INTERVAL 30 SECOND ELSE t + INTERVAL 90 SECOND END AS again,
        CASE WHEN lead_ IN ('0', '1') THEN '"changed"' WHEN lead_ NOT BETWEEN '3' AND '6' THEN 'W/"' || d || '"' END AS tag2, CASE WHEN lead_ IN ('3', '4', '5') THEN t WHEN lead_ = '6' THEN t - INTERVAL 1 DAY END AS since FROM c),
r AS (SELECT page_id * 2 AS record_id, canonical_url, t AS ts, 'response' AS kind, '"' || d || '"' AS tag, t AS since, strftime(t, '%a, %d %b %Y %H:%M:%S GMT') AS said FROM v
      UNION ALL
      SELECT page_id * 2 + 1, canonical_url, again, 'revisit', tag2, since,
             CASE lead_ WHEN '4' THEN strftime(since, '%A, %d-%b-%y %H:%M:%S GMT') WHEN '5' THEN strftime(since, '%a %b ') || lpad(day(since)::VARCHAR, 2, ' ') || strftime(since, ' %H:%M:%S %Y') ELSE strftime(since, '%a, %d %b %Y %H:%M:%S GMT') END FROM v),
f AS (SELECT *, last_value(CASE WHEN kind = 'response' THEN {'id': record_id, 'tag': tag, 'since': since, 'said': said} END IGNORE NULLS) OVER (PARTITION BY canonical_url ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS found FROM r),
s AS (SELECT *, CASE WHEN found IS NULL THEN 'no_response' WHEN CASE WHEN tag IS NOT NULL THEN found.tag = replace(tag, 'W/', '') ELSE found.since <= since END THEN 'resolved' ELSE 'validator_mismatch' END AS status FROM f WHERE kind = 'revisit')
SELECT record_id, canonical_url, CASE WHEN status = 'resolved' THEN found.id END AS response_id, status,
       CASE WHEN status = 'resolved' THEN 'content-type: text/html' || chr(10) || 'date: ' || strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') || chr(10) || 'etag: ' || coalesce(tag, found.tag) || chr(10) || 'last-modified: ' || coalesce(said, found.said) END AS headers FROM s"""

OP8_SQL = """
WITH d AS (SELECT row_number() OVER () AS n, doc_id, source, coalesce(text, '') AS text FROM documents),
s AS (SELECT n, doc_id, source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
        -ln((('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, md5(text))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
        / greatest(0.1::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * coalesce(len(regexp_extract_all(text, '[#*$%&|<>]'))::DOUBLE / nullif(length(text), 0), 0)) AS k FROM d),
t AS (SELECT source, sum(size)::DOUBLE AS ss, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s GROUP BY source),
v AS (SELECT *, 2 * ss AS cap, coalesce(sum(2 * ss) OVER o, 0) AS full_, (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS wide, 1.5::DOUBLE * sum(ss) OVER () AS total
      FROM t WINDOW o AS (ORDER BY 2 * ss / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((total - full_) / wide, cap / w) AS level FROM v WHERE (total - full_) / wide * w < cap),
g AS (SELECT source, ss::BIGINT AS source_size, least(cap, coalesce(level * w, cap)) AS target FROM v LEFT JOIN l ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g),
x AS (SELECT s.*, source_size, target, epochs, floor(target - epochs * source_size)::BIGINT AS open_, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM s JOIN e ON s.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * epochs + greatest(0, least(size, open_ - before)))::BIGINT AS taken FROM x"""

OP9_SQL = """
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT n, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
p AS (SELECT n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT n, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY n ORDER BY i)),
r AS (SELECT n, i, count(*) OVER (PARTITION BY n, word, b, c) AS times FROM g WHERE c IS NOT NULL),
u AS (SELECT n, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS v(k) WHERE times > 1 GROUP BY n),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: list_contains([STOP_WORDS], lower(x))))::BIGINT AS n_stop FROM w LEFT JOIN u USING (n)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1)::DOUBLE AS nw FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words >= 50 AND word_chars / nw BETWEEN 2 AND 14 AND n_symbols / nw <= 0.3::DOUBLE AND n_stop / nw >= 0.02::DOUBLE
       AND n_dup_lines / greatest(n_lines, 1)::DOUBLE <= 0.5 AND n_repeat_words / nw <= 0.5 AS kept FROM j"""


def oracle_sql() -> dict[str, str]:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(rules.STOP_WORDS))
    return {"op5_warc_revisits": OP5_SQL, "op7_license_scan": licenses.oracle(), "op8_source_mix": OP8_SQL, "op9_quality_rules": OP9_SQL.replace("STOP_WORDS", stop)}
