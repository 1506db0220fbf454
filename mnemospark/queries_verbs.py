"""More named queries: lists, verbs, sweeps and text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.functions import analyzer, scalars as S
from mnemospark.operators import derive, graph, lexical, ranking, statements, vectors
from mnemospark.plans import dsl
from mnemospark.plans.engine import Engine
from mnemospark.queries import ANN, BM25, CUE_TERMS, EV, LANES, MEM, REL, ST, VEC, _cue, _lanes, _query, _sup
from mnemospark.sources import records as R

_ENTS = "e AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS seg FROM customer), m AS (SELECT o_custkey AS id, count(*) AS mentions FROM orders GROUP BY 1)"


@_query(f"WITH {_ENTS} SELECT id, name, coalesce(mentions, 0) AS mentions FROM e LEFT JOIN m USING (id) WHERE starts_with(name, 'Customer#00000') AND coalesce(mentions, 0) >= 5 ORDER BY id LIMIT 1000")
def entity_list(spark, sf_dir):
    mentions = R.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("mentions"))
    e = R.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).join(mentions, "id", "left")
    e = e.select("id", "name", F.coalesce("mentions", F.lit(0)).alias("mentions")).where(F.col("name").startswith("Customer#00000") & (F.col("mentions") >= 5))
    return ranking.top_k(e, 1000, F.asc("id"))


@_query("SELECT r_name AS namespace, n_name AS name, n_nationkey AS id FROM nation JOIN region ON n_regionkey = r_regionkey")
def registry_lookup(spark, sf_dir):
    """Qualified name to interned id."""
    n, r = R.table(spark, sf_dir, "nation"), R.table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("namespace"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))


@_query("""WITH h AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 5000), o AS (SELECT o_custkey AS id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders), d AS (SELECT o_custkey AS id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders),
a AS (SELECT id, string_agg(o_orderkey::VARCHAR, ',' ORDER BY n) AS dearest FROM o WHERE n <= 5 GROUP BY id), b AS (SELECT id, string_agg(o_orderkey::VARCHAR, ',' ORDER BY n) AS newest FROM d WHERE n <= 5 GROUP BY id)
SELECT id, dearest, newest FROM h LEFT JOIN a USING (id) LEFT JOIN b USING (id)""")
def graph_enrichment(spark, sf_dir):
    """Each hit with its five leading statements by weight and by time."""
    hits = R.table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("id"))
    o = R.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "id")
    out = statements.enrich(hits, "id", {"dearest": (o, "o_orderkey", 5, F.desc("o_totalprice")), "newest": (o, "o_orderkey", 5, F.desc("o_orderdate"))})
    joined = lambda c: F.when(F.col(c).isNotNull(), F.array_join(F.transform(c, lambda x: x.cast("string")), ",")).alias(c)
    return out.select("id", joined("dearest"), joined("newest"))


@_query(f"WITH {ANN}, d AS (SELECT memory_id, score FROM ann ORDER BY score DESC, memory_id LIMIT 20), b AS (SELECT memory_id, round(0.5::DOUBLE + score / 4 + 1e-9::DOUBLE, 6) AS score FROM ann JOIN vec USING (memory_id) WHERE label = 3), u AS (SELECT memory_id, max(score) AS score FROM (SELECT * FROM d UNION ALL SELECT * FROM b WHERE score >= 0.5) GROUP BY memory_id) SELECT memory_id AS statement_id, score, row_number() OVER (ORDER BY score DESC, memory_id) AS rank FROM u QUALIFY rank <= 40")
def statement_bridge(spark, sf_dir):
    v = R.vectors(spark, sf_dir)
    cue = vectors.literal(_cue(spark, sf_dir))
    direct = vectors.knn(v, _cue(spark, sf_dir), 20).withColumnRenamed("memory_id", "statement_id")
    bridge = v.where("label = 3").select(F.col("memory_id").alias("statement_id"), S.rounded(0.5 + S.rounded(S.cosine(F.col("v"), cue)) / 4).alias("score"))
    return statements.merge_bridge(direct, bridge, 0.5, 40)


@_query("""WITH d AS (SELECT p_partkey AS id, regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+') AS a, regexp_extract_all(lower(p_type), '[\\p{L}\\p{N}]+') AS b FROM part), q AS (SELECT unnest(['steel', 'brass', 'large']) AS term),
f AS (SELECT id, 'a' AS f, a AS toks FROM d UNION ALL SELECT id, 'b', b FROM d), t AS (SELECT id, f, len(toks) AS length, term, len(list_filter(toks, lambda x: x = term))::DOUBLE AS tf FROM f, q), n AS (SELECT f, count(*)::DOUBLE AS n, avg(len(toks)) AS mean FROM f GROUP BY f), df AS (SELECT f, term, (count(*) FILTER (WHERE tf > 0))::DOUBLE AS df FROM t GROUP BY ALL),
s AS (SELECT id, f, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) + 1e-9::DOUBLE, 6) AS score FROM t JOIN df USING (f, term) JOIN n USING (f) WHERE tf > 0 GROUP BY ALL)
SELECT id, round(sum(score) + 1e-9::DOUBLE, 5) AS score FROM s GROUP BY id""")
def statement_bm25(spark, sf_dir):
    """Two text fields, scored each and summed."""
    p = R.table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    terms = ["steel", "brass", "large"]
    both = lexical.bm25(p, terms, "id", "p_name").unionByName(lexical.bm25(p, terms, "id", "p_type"))
    return both.groupBy("id").agg(S.rounded(F.sum("score"), 5).alias("score"))


@_query(f"WITH {LANES} SELECT item_id FROM lists WHERE lane = 'semantic' INTERSECT SELECT item_id FROM lists WHERE lane = 'lexical'")
def both_lanes(spark, sf_dir):
    lists = _lanes(spark, sf_dir)
    return lists.where("lane = 'semantic'").select("item_id").intersect(lists.where("lane = 'lexical'").select("item_id"))


@_query("""WITH t AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_custkey FROM orders)
SELECT DISTINCT o_orderkey, unnest([d, make_date(year(d) + 1, 1, 1), DATE '2024-01-31', (DATE '2024-02-01' - (1 + o_custkey % 9)::INT)::DATE, (DATE '2024-02-01' - INTERVAL (o_custkey % 7 + 1) MONTH)::DATE]) AS event_date FROM t""")
def temporal_expr(spark, sf_dir):
    """Dates that generated sentences speak of: ISO, bare year, a word, days and months ago."""
    o = R.table(spark, sf_dir, "orders")
    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd")
    year = (F.year(F.col("o_orderdate").cast("timestamp")) + 1).cast("string")
    text = F.concat(F.lit("Seen on "), day, F.lit(", due in "), year, F.lit(", paid yesterday, sent "), (1 + F.col("o_custkey") % 9).cast("string"), F.lit(" days ago or "), (F.col("o_custkey") % 7 + 1).cast("string"), F.lit(" month ago"))
    return o.select("o_orderkey", F.explode(analyzer.event_dates(text, F.lit("2024-02-01").cast("date"))).alias("event_date"))


@_query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_discount * 12 AS confidence, CASE l_returnflag WHEN 'R' THEN 'Event' ELSE 'Fact' END AS kind, CASE WHEN l_linestatus = 'O' THEN l_shipdate END AS event_at, l_shipdate AS valid_from, o_orderdate + INTERVAL 60 DAY AS valid_to FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, CASE WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence' WHEN kind = 'Event' AND event_at IS NULL THEN 'event_without_time' WHEN kind <> 'Event' AND event_at IS NOT NULL THEN 'time_without_event' WHEN valid_from > valid_to THEN 'window' END AS error FROM s""")
def statement_shape(spark, sf_dir):
    l, o = R.table(spark, sf_dir, "lineitem"), R.table(spark, sf_dir, "orders")
    s = l.join(o, l.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", (F.col("l_discount") * 12).alias("confidence"), F.when(F.col("l_returnflag") == "R", "Event").otherwise("Fact").alias("kind"), F.when(F.col("l_linestatus") == "O", F.col("l_shipdate")).alias("event_at"), F.col("l_shipdate").alias("valid_from"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAY")).alias("valid_to"))
    return statements.shape_errors(s).select("l_orderkey", "l_linenumber", "error")


@_query("SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem")
def symmetric_pairs(spark, sf_dir):
    l = R.table(spark, sf_dir, "lineitem")
    return l.select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).distinct()


@_query("SELECT o_orderstatus AS version, count(*) FILTER (WHERE o_shippriority_ < 3) AS stale, count(*) AS n FROM (SELECT *, (o_custkey % 5) AS o_shippriority_ FROM orders) GROUP BY o_orderstatus")
def stale_extractions(spark, sf_dir):
    o = R.table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("version")).agg(F.count_if(F.col("o_custkey") % 5 < 3).alias("stale"), F.count("*").alias("n"))


@_query("WITH s AS (SELECT user_id, event_id, value, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spent FROM events) SELECT user_id, event_id, round(spent + 1e-9::DOUBLE, 4) AS spent FROM s WHERE spent <= 500")
def cost_budget(spark, sf_dir):
    e = R.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return statements.within_budget(e, "user_id", ("ts", "event_id"), "value", 500).select("user_id", "event_id", S.rounded(F.col("spent"), 4).alias("spent"))


@_query(f"WITH {ST} SELECT statement_id FROM sup WHERE superseded_by IS NOT NULL AND datesub('second', valid_to, TIMESTAMP '1998-01-01') >= 30 * 86400")
def retention_sweep(spark, sf_dir):
    now = F.lit("1998-01-01").cast("timestamp_ntz")
    return statements.expired(_sup(spark, sf_dir), "valid_to", now, 30 * 86_400, F.col("superseded_by").isNotNull()).select("statement_id")


@_query("WITH g AS (SELECT p_partkey AS m FROM part WHERE p_size <= 30) SELECT l_orderkey AS relation_id, count(*) AS lost FROM lineitem LEFT JOIN g ON l_partkey = m GROUP BY l_orderkey HAVING count(*) FILTER (WHERE m IS NULL) = 0")
def forget_relations(spark, sf_dir):
    gone = R.table(spark, sf_dir, "part").where("p_size <= 30").select(F.col("p_partkey").alias("memory_id"))
    return statements.forget_relations(R.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("relation_id"), F.col("l_partkey").alias("memory_id")), gone)


@_query("WITH g AS (SELECT c_custkey, x FROM customer, (VALUES ('pattern'), ('temporal')) v(x)), done AS (SELECT DISTINCT o_custkey, 'pattern' AS x FROM orders) SELECT g.c_custkey AS memory_id, g.x AS extractor FROM g ANTI JOIN done ON o_custkey = c_custkey AND done.x = g.x")
def backfill_grid(spark, sf_dir):
    """(memory, extractor) items that no checkpoint has."""
    grid = R.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("memory_id"), F.explode(F.array(F.lit("pattern"), F.lit("temporal"))).alias("extractor"))
    done = R.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("memory_id"), F.lit("pattern").alias("extractor"))
    return grid.join(done, ["memory_id", "extractor"], "left_anti")


@_query("SELECT event_id AS statement_id, event_type AS predicate FROM events WHERE event_type NOT IN ('click', 'purchase')")
def vocabulary_sweep(spark, sf_dir):
    schema = dsl.parse("namespace shop predicate click { kind: Event } predicate purchase { kind: Event }")
    e = R.table(spark, sf_dir, "events").select(F.col("event_id").alias("statement_id"), F.col("event_type").alias("predicate"))
    return dsl.outside_vocabulary(e, schema.dictionary(spark, "predicate")).select("statement_id", "predicate")


@_query(f"WITH {MEM} SELECT memory_id, 'mail' AS extractor, unnest(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9.]+')) AS surface FROM mem WHERE salience >= 0.01")
def pattern_extract(spark, sf_dir):
    schema = dsl.parse('namespace pii extractor mail { pattern: /[a-z0-9.]+@[a-z0-9.]+/, when: salience >= 0.01 }')
    return dsl.extract(R.memories(spark, sf_dir), schema).select("memory_id", "extractor", "surface")


@_query(f"""WITH {ST} SELECT statement_id, unnest(['What is the order priority of ' || subject || '?', subject || ' order priority?', 'Who has order priority ' || object || '?']) AS question FROM sup""")
def question_templates(spark, sf_dir):
    return statements.questions(R.statements(spark, sf_dir).withColumn("subject", F.col("subject").cast("string")))


@_query(f"""WITH {ANN}, f AS (SELECT * FROM orders WHERE o_custkey = 1), p AS (SELECT label, max(score) AS cos FROM ann JOIN vec USING (memory_id) GROUP BY label)
SELECT o_orderpriority AS object, count(*) AS times, max(o_orderdate) AS newest, 0.5::DOUBLE AS confidence FROM f GROUP BY o_orderpriority""")
def grounded_answer(spark, sf_dir):
    """The values of the predicate nearest to the cue, for one subject."""
    cue = _cue(spark, sf_dir)
    facts = R.statements(spark, sf_dir).withColumn("confidence", F.lit(0.5))
    predicates = R.vectors(spark, sf_dir).where("memory_id = 0").select(F.lit("order_priority").alias("predicate"), "v")
    return Engine(None, None).grounded(facts, predicates, 1, cue)


@_query(f"""WITH {REL}, k AS (SELECT * FROM (VALUES ('lives_in', 0.9::DOUBLE), ('part_of', 0.7::DOUBLE), ('based_in', 0.6::DOUBLE)) v(kind, cos)), e AS (SELECT src, dst, cos FROM rel JOIN k USING (kind)),
h1 AS (SELECT dst AS node, max(cos) AS cos FROM e WHERE src = 'c:1' GROUP BY dst ORDER BY cos DESC, node LIMIT 4), h2 AS (SELECT dst AS node, max(e.cos) AS cos FROM e JOIN h1 ON src = node GROUP BY dst ORDER BY cos DESC, node LIMIT 4)
SELECT node, 1::BIGINT AS hop, round(cos * 0.9::DOUBLE + 1e-9::DOUBLE, 6) AS score FROM h1 UNION ALL SELECT node, 2, round(cos * 0.81::DOUBLE + 1e-9::DOUBLE, 6) FROM h2""")
def grounded_walk(spark, sf_dir):
    kinds = spark.createDataFrame([("lives_in", 0.9), ("part_of", 0.7), ("based_in", 0.6)], "kind string, cos double")
    return graph.grounded_walk(F.lit("c:1"), R.relations(spark, sf_dir), kinds, hops=2)


@_query(f"WITH {BM25}, cnt AS (SELECT count(*) AS hits FROM lex WHERE rank <= 1) SELECT CASE WHEN hits = 0 THEN 'None' WHEN hits = 1 THEN 'Single' ELSE 'Many' END AS shape FROM cnt")
def answer_shape(spark, sf_dir):
    n = F.count("*")
    return lexical.bm25_topk(R.memories(spark, sf_dir), CUE_TERMS, 1).agg(F.when(n == 0, "None").when(n == 1, "Single").otherwise("Many").alias("shape"))


@_query(f"WITH {EV} SELECT memory_id, count(*) AS n FROM ev SEMI JOIN (SELECT p_partkey FROM part WHERE p_size > 25) p ON p_partkey = memory_id GROUP BY memory_id")
def referential_semi_join(spark, sf_dir):
    p = R.table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("memory_id"))
    return R.evidence(spark, sf_dir).join(p, "memory_id", "left_semi").groupBy("memory_id").agg(F.count("*").alias("n"))


@_query("SELECT o_custkey AS id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS name, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS aliases FROM orders GROUP BY o_custkey")
def entity_rename(spark, sf_dir):
    """The latest name of an entity; all names it had become aliases."""
    o = R.table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("name"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("aliases"))


@_query(f"WITH {MEM}, a AS (SELECT agent, kind, created_at, memory_id, row_number() OVER (PARTITION BY agent ORDER BY created_at DESC, memory_id) AS n FROM mem) SELECT agent, memory_id, kind FROM a WHERE n <= 10")
def audit_recent(spark, sf_dir):
    """The ten newest rows of each agent."""
    place = F.row_number().over(Window.partitionBy("agent").orderBy(F.desc("created_at"), "memory_id"))
    return R.memories(spark, sf_dir).select("agent", "memory_id", "kind", place.alias("n")).where("n <= 10").drop("n")


@_query(f"""WITH {VEC}, {MEM}, p AS (SELECT lag(memory_id) OVER o AS src, memory_id AS dst, datesub('second', lag(created_at) OVER o, created_at) AS gap FROM mem WINDOW o AS (PARTITION BY agent ORDER BY created_at, memory_id)),
e AS (SELECT src, dst, round((1 - gap / 7200.0::DOUBLE) * 0.9::DOUBLE + 0.1::DOUBLE + 1e-9::DOUBLE, 6) AS weight FROM p WHERE gap <= 7200)
SELECT src, dst, weight FROM e JOIN vec a ON a.memory_id = src JOIN vec b ON b.memory_id = dst WHERE round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) + 1e-9::DOUBLE, 6) >= 0.1""")
def followed_by_topical(spark, sf_dir):
    """Predecessors within two hours that are also alike."""
    edges = derive.followed_by(R.memories(spark, sf_dir), ("agent",), 7200)
    return derive.topical(edges, R.vectors(spark, sf_dir), 0.1)


@_query("SELECT n_nationkey AS id, r_name AS filler FROM nation JOIN region ON n_regionkey = r_regionkey")
def hrr_analogy(spark, sf_dir):
    """Each nation's region, read back from one bundled vector."""
    n, r = R.table(spark, sf_dir, "nation"), R.table(spark, sf_dir, "region")
    names = sorted(x.r_name for x in r.collect())  # the codebook: a handful of regions
    triples = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("subject"), F.col("r_name").alias("object"))
    return vectors.role_query(triples, names).select("id", "filler")


@_query()
def analyzed_terms(spark, sf_dir):
    """Stemmed document frequencies (the analyzer is tested against golden stems)."""
    docs = R.memories(spark, sf_dir).select("memory_id", F.explode(F.array_distinct(analyzer.analyzed(F.col("text")))).alias("term"))
    return docs.groupBy("term").agg(F.count("*").alias("df"))


@_query()
def embedded_search(spark, sf_dir):
    """Embeds all texts with the stand-in model and finds the neighbours of the first benchmark text."""
    docs = R.memories(spark, sf_dir).select("memory_id", analyzer.embedded(F.col("text"), 64).alias("v"))
    cue = R.table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1).select(analyzer.embedded(F.col("text"), 64).alias("v")).first()["v"]
    return vectors.knn(docs, list(cue), 20)


