"""Named queries: changes of records, and steps of the read path that stand alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions import scalars as S
from mnemospark.operators import graph, lexical, lifecycle, ranking, resolution, vectors
from mnemospark.queries import ANN, REL, _cue, _query, _starts, _walk_sql
from mnemospark.sources import records as R

_NOW = "1996-01-01 00:00:00"


@_query(f"""SELECT o_orderkey AS statement_id, CASE WHEN o_orderstatus = 'P' THEN o_orderdate WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '{_NOW}' END AS tombstoned_at,
CASE WHEN o_orderstatus = 'P' THEN 'Expired' WHEN o_orderkey % 6 = 0 THEN 'Retracted' WHEN o_orderkey % 3 = 0 THEN 'UserRequest' END AS reason, o_orderstatus <> 'P' AND o_orderkey % 6 = 0 AS reclaim FROM orders""")
def statement_tombstone(spark, sf_dir):
    o = R.table(spark, sf_dir, "orders")
    gone = F.col("o_orderstatus") == "P"
    rows = o.select(F.col("o_orderkey").alias("statement_id"), F.when(gone, F.col("o_orderdate")).alias("tombstoned_at"), F.when(gone, "Expired").alias("reason"))
    asked = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("statement_id"), F.when(F.col("o_orderkey") % 6 == 0, "Retracted").otherwise("UserRequest").alias("reason"))
    return lifecycle.tombstone(rows, asked, "statement_id", F.lit(_NOW).cast("timestamp_ntz"))


@_query("""WITH e AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN p_partkey - 1 END AS into_, TIMESTAMP '2024-01-01 00:00:00' + to_days((p_partkey % 15)::INT) AS merged_at FROM part)
SELECT id AS entity_id, outcome, CASE WHEN outcome <> 'reversed' THEN into_ END AS merged_into FROM (SELECT *, CASE WHEN id % 2 <> 0 THEN 'kept' WHEN into_ IS NULL THEN 'not_merged' WHEN merged_at + INTERVAL 7 DAY >= TIMESTAMP '2024-01-13 00:00:00' THEN 'reversed' ELSE 'expired' END AS outcome FROM e)""")
def entity_unmerge(spark, sf_dir):
    p = R.table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "entity_id")
    entities = p.select("entity_id", F.when(F.col("entity_id") % 5 == 0, F.col("entity_id") - 1).alias("merged_into"))
    merges = p.where("entity_id % 5 = 0").select("entity_id", R.minutes_after("2024-01-01 00:00:00", (F.col("entity_id") % 15 * 1440).cast("int")).alias("merged_at"))
    return lifecycle.unmerge(entities, merges, p.where("entity_id % 2 = 0"), F.lit("2024-01-13 00:00:00").cast("timestamp_ntz"))


@_query("""WITH s AS (SELECT p_partkey AS entity_id, p_brand AS alias FROM part), c AS (SELECT p_partkey AS entity_id, p_type AS alias, 1 AS nth, true AS added FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, p_brand, 2, false FROM part WHERE p_size % 4 = 0 UNION ALL SELECT p_partkey, p_brand, 3, true FROM part WHERE p_size % 8 = 0),
l AS (SELECT entity_id, alias, arg_max(added, nth) AS added FROM c GROUP BY entity_id, alias) SELECT coalesce(s.entity_id, l.entity_id) AS entity_id, coalesce(s.alias, l.alias) AS alias FROM s FULL JOIN l ON s.entity_id = l.entity_id AND s.alias = l.alias WHERE coalesce(added, true)""")
def entity_aliases(spark, sf_dir):
    p = R.table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "entity_id")
    change = lambda where, alias, at, added: p.where(where).select("entity_id", F.col(alias).alias("alias"), F.lit(at).alias("at"), F.lit(added).alias("added"))
    changes = change("p_size > 25", "p_type", 1, True).unionByName(change("p_size % 4 = 0", "p_brand", 2, False)).unionByName(change("p_size % 8 = 0", "p_brand", 3, True))
    return lifecycle.aliases(p.select("entity_id", F.col("p_brand").alias("alias")), changes)


@_query("SELECT o_orderkey AS relation_id, lead(o_orderdate) OVER w AS valid_to, lead(o_orderkey) OVER w AS superseded_by FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey)")
def relation_supersede(spark, sf_dir):
    o = R.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("relation_id"), F.col("o_custkey").alias("src"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("valid_from"))
    return lifecycle.relation_versions(o, ("src", "kind"), "valid_from", "relation_id").select("relation_id", "valid_to", "superseded_by")


@_query("SELECT doc_id AS memory_id, source AS agent, CASE WHEN source IN ('src1', 'src2') AND lang = 'en' THEN 'archive' ELSE lang END AS context FROM documents")
def context_move(spark, sf_dir):
    moves = spark.createDataFrame([("src1", "en", "archive"), ("src2", "en", "archive")], "agent string, from_context string, to_context string")
    return lifecycle.move_context(R.memories(spark, sf_dir).select("memory_id", "agent", "context"), moves)


@_query("""WITH r AS (SELECT doc_id AS id, md5(coalesce(text, '')) AS v FROM documents WHERE doc_id % 9 <> 0), i AS (SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE md5(coalesce(text, '')) END AS v FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(r.id, i.id) AS memory_id, CASE WHEN i.id IS NULL THEN 'add' WHEN r.id IS NULL THEN 'drop' ELSE 'replace' END AS action FROM r FULL JOIN i ON r.id = i.id WHERE i.id IS NULL OR r.id IS NULL OR r.v <> i.v""")
def index_rebuild(spark, sf_dir):
    """What a text index built from other rows and older texts has to change."""
    m = R.memories(spark, sf_dir).select("memory_id", F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    index = m.where("memory_id % 7 <> 0").withColumn("hash", F.when(F.col("memory_id") % 11 == 0, "old").otherwise(F.col("hash")))
    return lifecycle.index_drift(m.where("memory_id % 9 <> 0"), index, "memory_id", "hash")


@_query("""WITH c AS (SELECT user_id AS consumer, event_type AS topic, min(event_id) AS lsn FROM events GROUP BY user_id, event_type QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type) = 1), h AS (SELECT event_type AS topic, max(event_id) AS head FROM events GROUP BY 1),
b AS (SELECT consumer, count(*) AS behind FROM c JOIN events ON event_type = topic AND event_id > lsn GROUP BY 1)
SELECT consumer, CASE WHEN coalesce(behind, 0) > 100 THEN lsn ELSE coalesce(head, lsn) END AS final_lsn, coalesce(behind, 0) AS behind, CASE WHEN coalesce(behind, 0) > 100 THEN 'overloaded' ELSE 'live' END AS state FROM c LEFT JOIN h USING (topic) LEFT JOIN b USING (consumer)""")
def lagging_consumers(spark, sf_dir):
    e = R.table(spark, sf_dir, "events")
    at = e.groupBy(F.col("user_id").alias("consumer"), F.col("event_type").alias("topic")).agg(F.min("event_id").alias("lsn"))
    first = at.groupBy("consumer").agg(F.min_by(F.struct("topic", "lsn"), F.struct(F.col("topic").isNull(), "topic")).alias("first"))
    consumers = first.select("consumer", "first.topic", "first.lsn")
    return lifecycle.lagging(consumers, e.select(F.col("event_type").alias("topic"), F.col("event_id").alias("lsn")), 100)


@_query("SELECT p_partkey AS model, substr(sha256(concat_ws('|', sha256(p_name), sha256(p_brand), sha256(p_type), p_size::VARCHAR, (p_size > 20)::VARCHAR)), 1, 32) AS fingerprint FROM part")
def model_fingerprint(spark, sf_dir):
    fp = lifecycle.model_fingerprint(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size"), F.col("p_size") > 20)
    return R.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model"), fp.alias("fingerprint"))


@_query(f"""WITH {ANN}, s AS (SELECT memory_id, CASE WHEN memory_id % 2 = 0 THEN score END AS a FROM ann WHERE memory_id % 17 = 0), v AS (SELECT memory_id, score AS b FROM sem WHERE rank <= 30),
u AS (SELECT coalesce(s.memory_id, v.memory_id) AS memory_id, CASE WHEN s.memory_id IS NOT NULL AND v.memory_id IS NOT NULL THEN 0 WHEN s.memory_id IS NOT NULL THEN 1 ELSE 2 END AS p, coalesce(b, a) AS cosine FROM s FULL JOIN v ON s.memory_id = v.memory_id)
SELECT memory_id, ['both', 'structured', 'semantic'][p + 1] AS origin, cosine, row_number() OVER (ORDER BY p, cosine DESC NULLS LAST, memory_id) AS rank FROM u""")
def membership_order(spark, sf_dir):
    v = R.vectors(spark, sf_dir)
    cosine = S.rounded(S.cosine(F.col("v"), vectors.literal(_cue(spark, sf_dir))))
    structured = v.where("memory_id % 17 = 0").select("memory_id", F.when(F.col("memory_id") % 2 == 0, cosine).alias("cosine"))
    return lifecycle.membership_order(structured, vectors.knn(v, _cue(spark, sf_dir), 30).select("memory_id", F.col("score").alias("cosine")), "memory_id")


@_query("""WITH e AS (SELECT 'n:' || n_nationkey AS id, lower(n_name) AS norm FROM nation UNION ALL SELECT 'r:' || r_regionkey, lower(r_name) FROM region), c AS (SELECT s_suppkey AS cue_id, unnest([lower(n_name), lower(s_name), CASE WHEN s_suppkey % 3 = 0 THEN lower(r_name) END]) AS norm FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT cue_id, min(id) AS entity_id FROM c JOIN e USING (norm) GROUP BY cue_id HAVING count(DISTINCT id) = 1""")
def cue_anchor(spark, sf_dir):
    """Cues that name a nation, and some a region too: only an unambiguous one is anchored."""
    e = resolution.with_names(R.entities(spark, sf_dir)).where("entity_type IN ('nation', 'region')")
    s, n, r = (R.table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    named = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    spans = [S.normalize_name(F.col("n_name")), S.normalize_name(F.col("s_name")), F.when(F.col("s_suppkey") % 3 == 0, S.normalize_name(F.col("r_name")))]
    return lifecycle.cue_anchors(named.select(F.col("s_suppkey").alias("cue_id"), F.array(*spans).alias("spans")), e)


@_query(f"""WITH RECURSIVE {REL}, {_walk_sql(2)}, st AS (SELECT o_orderkey AS statement_id, 'c:' || o_custkey AS subject, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'F'),
sc AS (SELECT node, hop, round(1.0::DOUBLE / (hop + 1) * CASE WHEN hop = 0 THEN 1.0::DOUBLE ELSE (SELECT max(weight) FROM both_ b JOIN m p ON p.node = b.src WHERE b.dst = m.node AND p.hop = m.hop - 1) END + 1e-9::DOUBLE, 6) AS score FROM m)
SELECT statement_id, hop, score FROM sc JOIN st ON subject = node WHERE n <= 5""")
def statement_pivot(spark, sf_dir):
    """Open orders, five a customer, of the customers around a supplier."""
    nodes = graph.star(_starts(spark, "s:1"), R.relations(spark, sf_dir), 2, branching=None).select("node", F.col("hop").cast("int").alias("hop"), "score")
    o = R.table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("statement_id"), F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("subject"), "o_orderdate")
    return lifecycle.pivot_statements(nodes, o, 5, F.desc("o_orderdate"), F.asc("statement_id"))


@_query(f"""WITH {ANN}, cen AS (SELECT label, i, sum(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec) GROUP BY label, i), nrm AS (SELECT label, sqrt(sum(x * x)) AS n FROM cen GROUP BY label), g AS (SELECT list(x / n ORDER BY i) AS g FROM cen JOIN nrm USING (label) WHERE label = 3),
c AS (SELECT label AS src, memory_id AS dst, round(list_dot_product(v, g) + 1e-9::DOUBLE, 6) AS cosine FROM vec, g WHERE label <> 3)
SELECT src, dst, cosine, row_number() OVER (PARTITION BY src ORDER BY cosine DESC, dst) AS place FROM c QUALIFY place <= 8""")
def goal_proximity(spark, sf_dir):
    """The eight neighbours of each group that lie nearest to the goal's centroid."""
    v = R.vectors(spark, sf_dir)
    goal = F.broadcast(vectors.centroids(v.where("label = 3"), "label").select("centroid"))  # one row
    near = v.where("label <> 3").join(goal).select(F.col("label").alias("src"), F.col("memory_id").alias("dst"), S.rounded(S.dot(F.col("v"), F.col("centroid"))).alias("cosine"))
    return lifecycle.towards_goal(near, "src", "cosine", 8, "dst")


@_query("""SELECT 'c:' || c_custkey AS start, round(sqrt(0.9::DOUBLE * 0.5::DOUBLE) * CASE WHEN c_acctbal <= 0 THEN 0.0::DOUBLE ELSE sqrt(c_acctbal / 10000.0::DOUBLE * 0.5::DOUBLE) END / 3 + 1e-9::DOUBLE, 6) AS score FROM customer""")
def path_scores(spark, sf_dir):
    """Paths from a customer over its nation to the region: geometric means of weights and saliences, less the longer."""
    weights = F.array(F.lit(0.9), F.lit(-0.5))
    saliences = F.array(F.greatest(F.lit(0.0), F.col("c_acctbal") / 10000.0), F.lit(0.5))
    return R.table(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("start"), S.rounded(graph.path_score(F.lit(2), weights, saliences)).alias("score"))


@_query("SELECT p_partkey AS id, replace(replace(p_name || chr(39) || 's ' || p_brand, chr(39), ' '), chr(8217), ' ') AS cue FROM part")
def escaped_cues(spark, sf_dir):
    return R.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), lexical.escaped(F.concat("p_name", F.lit("'s "), "p_brand")).alias("cue"))


@_query(f"""WITH RECURSIVE {REL}, {_walk_sql(2)}, e AS (SELECT 'n:' || n_nationkey AS node, n_name AS name FROM nation UNION ALL SELECT 'r:' || r_regionkey, r_name FROM region UNION ALL SELECT 's:' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'c:' || c_custkey, c_name FROM customer),
x AS (SELECT node, name, hop FROM m JOIN e USING (node) WHERE hop > 0 ORDER BY hop, node LIMIT 24), t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}]+')) AS term FROM x) SELECT term FROM t""")
def graph_expansion_terms(spark, sf_dir):
    """Names of at most 24 neighbours within two hops, as further lexical terms."""
    nodes = graph.bfs(_starts(spark, "s:1"), graph.directed(R.relations(spark, sf_dir), "both"), 2).where("hop > 0").select("node", "hop")
    names = nodes.join(R.entities(spark, sf_dir).select(F.col("entity_id").alias("node"), "name"), "node")
    few = ranking.top_k(names, 24, F.asc("hop"), F.asc("node"))
    return few.select(F.explode(S.tokens("name")).alias("term")).distinct()
