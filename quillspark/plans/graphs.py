"""Graph queries over customers, suppliers, nations and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import graph
from quillspark.plans.registry import query
from quillspark.shared import cut, table, written

_E = """er AS (SELECT c_name AS name, c_mktsegment AS type, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'customer of ' || c_nationkey END AS description, c_custkey AS seq FROM customer
UNION ALL SELECT ' ' || upper(c_name) || ' ', 'renamed', '', c_custkey + 1000000 FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT s_name, 'supplier', 'supplies', s_suppkey FROM supplier UNION ALL SELECT n_name, 'nation', '', n_nationkey FROM nation UNION ALL SELECT r_name, 'region', 'region', r_regionkey FROM region),
ek AS (SELECT lower(trim(name)) AS key, * FROM er),
en AS (SELECT key, arg_max(name, seq) AS name, arg_max(type, seq) AS type, coalesce(arg_max(description, seq) FILTER (WHERE description <> ''), '') AS description FROM ek WHERE key <> '' GROUP BY key)"""


def _rows(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    pick = lambda d, n, k, e, s: d.select(n.alias("name"), k.alias("type"), e.alias("description"), s.cast("long").alias("seq"))
    c = t("customer")
    told = F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.concat(F.lit("customer of "), F.col("c_nationkey").cast("string")))
    out = pick(c, F.col("c_name"), F.col("c_mktsegment"), told, F.col("c_custkey"))
    again = c.where("c_custkey % 3 = 0")
    out = out.unionByName(pick(again, F.concat(F.lit(" "), F.upper("c_name"), F.lit(" ")), F.lit("renamed"), F.lit(""), F.col("c_custkey") + 1000000))
    out = out.unionByName(pick(t("supplier"), F.col("s_name"), F.lit("supplier"), F.lit("supplies"), F.col("s_suppkey")))
    out = out.unionByName(pick(t("nation"), F.col("n_name"), F.lit("nation"), F.lit(""), F.col("n_nationkey")))
    return out.unionByName(pick(t("region"), F.col("r_name"), F.lit("region"), F.lit("region"), F.col("r_regionkey")))


def _entities(spark, sf_dir):
    return graph.upsert_entities(_rows(spark, sf_dir))


@query(f"WITH {_E} SELECT key, name, type, description FROM en")
def graph_entities_upsert(spark, sf_dir):
    return _entities(spark, sf_dir)


_R = """rr AS (SELECT c_name AS head, 'lives_in' AS predicate, n_name AS tail, 'c' || c_custkey AS chunk_id, (c_custkey % 10) / 10.0::DOUBLE AS confidence FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT s_name, 'based_in', n_name, 's' || s_suppkey, 0.5 FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT n_name, 'part_of', r_name, 'n' || n_nationkey, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT n_name, 'part_of', 'nowhere', 'x' || n_nationkey, 0.9 FROM nation),
rl AS (SELECT lower(trim(head)) AS head_key, predicate, lower(trim(tail)) AS tail_key, chunk_id, max(confidence) AS confidence FROM rr
 WHERE lower(trim(head)) IN (SELECT key FROM en) AND lower(trim(tail)) IN (SELECT key FROM en) GROUP BY ALL)"""


def _relations(spark, sf_dir, entities):
    t = lambda n: table(spark, sf_dir, n)
    n = t("nation")
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("chunk_id")
    rows = t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("head"), F.lit("lives_in").alias("predicate"), F.col("n_name").alias("tail"), tag("c", "c_custkey"), ((F.col("c_custkey") % 10) / 10.0).alias("confidence"))
    rows = rows.unionByName(t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("head"), F.lit("based_in").alias("predicate"), F.col("n_name").alias("tail"), tag("s", "s_suppkey"), F.lit(0.5).alias("confidence")))
    rows = rows.unionByName(n.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("head"), F.lit("part_of").alias("predicate"), F.col("r_name").alias("tail"), tag("n", "n_nationkey"), F.lit(None).cast("double").alias("confidence")))
    rows = rows.unionByName(n.select(F.col("n_name").alias("head"), F.lit("part_of").alias("predicate"), F.lit("nowhere").alias("tail"), tag("x", "n_nationkey"), F.lit(0.9).alias("confidence")))
    return graph.relations(rows, entities)


@query(f"WITH {_E}, {_R} SELECT head_key, predicate, tail_key, chunk_id, confidence FROM rl")
def graph_relations(spark, sf_dir):
    return _relations(spark, sf_dir, _entities(spark, sf_dir))


_M = "mn AS (SELECT lower(c_name) AS key, 'o' || o_orderkey AS chunk_id FROM orders JOIN customer ON o_custkey = c_custkey UNION SELECT lower(s_name), 'o' || l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber = 1 UNION SELECT lower(n_name), 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def _mentions(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.lower("c_name").alias("key"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("chunk_id"))
    li = t("lineitem").where("l_linenumber = 1").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.lower("s_name").alias("key"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("chunk_id"))
    n = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.lower("n_name").alias("key"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("chunk_id"))
    return o.unionByName(li).unionByName(n).distinct()


@query(
    f"""WITH {_E}, {_R}, {_M}, gone AS (SELECT chunk_id FROM mn WHERE right(chunk_id, 1) IN ('1', '3', '5', '7', '9') UNION SELECT chunk_id FROM rl WHERE chunk_id LIKE 'c%'),
m2 AS (SELECT * FROM mn WHERE chunk_id NOT IN (SELECT chunk_id FROM gone)), r2 AS (SELECT * FROM rl WHERE chunk_id NOT IN (SELECT chunk_id FROM gone))
SELECT key, type FROM en WHERE key IN (SELECT key FROM m2 UNION SELECT head_key FROM r2 UNION SELECT tail_key FROM r2)"""
)
def graph_delete_orphans(spark, sf_dir):
    e = _entities(spark, sf_dir)
    m, r = _mentions(spark, sf_dir), _relations(spark, sf_dir, e)
    gone = m.where(F.right("chunk_id", F.lit(1)).isin("1", "3", "5", "7", "9")).select("chunk_id").union(r.where("chunk_id like 'c%'").select("chunk_id")).distinct()
    return graph.delete_chunks(gone, e, m, r)[0].select("key", "type")


#: Questions: the names of all suppliers; the question's id is the supplier's key.
_S = "st AS (SELECT s_suppkey AS question_id, lower(s_name) AS key FROM supplier)"
_UND = "ud AS (SELECT head_key AS key, tail_key AS other, predicate, confidence FROM rl UNION ALL SELECT tail_key, head_key, predicate, confidence FROM rl)"


def _level_sql(depth: int, limit: int) -> str:
    """One level of the search: chunks of the frontier f{depth}, within what is left of the limit."""
    have = f"(SELECT question_id, count(*) AS n FROM d{depth - 1} GROUP BY 1)" if depth else "(SELECT NULL::BIGINT AS question_id, 0 AS n)"
    union = f"SELECT * FROM d{depth - 1} UNION ALL " if depth else ""
    fresh = f"WHERE (question_id, chunk_id) NOT IN (SELECT (question_id, chunk_id) FROM d{depth - 1})" if depth else ""
    return f"""l{depth} AS (SELECT question_id, chunk_id, {depth}::BIGINT AS hops, list_sort(list_distinct(list(key))) AS entities, count(DISTINCT key) AS matched FROM f{depth} JOIN mn USING (key) GROUP BY 1, 2),
k{depth} AS (SELECT l.* FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY matched DESC, chunk_id) AS r FROM l{depth}) l LEFT JOIN {have} h USING (question_id) WHERE r <= {limit} - coalesce(n, 0)),
d{depth} AS ({union}SELECT question_id, chunk_id, hops, entities, matched FROM k{depth} {fresh})"""


def _step_sql(depth: int, cap: int) -> str:
    seen = " UNION ".join(f"SELECT question_id, key FROM f{i}" for i in range(depth))
    return f"""f{depth} AS (SELECT question_id, key FROM (SELECT question_id, other AS key, row_number() OVER (PARTITION BY question_id ORDER BY max(coalesce(confidence, 0)) DESC, other) AS r
  FROM f{depth - 1} JOIN ud USING (key) WHERE (question_id, other) NOT IN ({seen}) GROUP BY question_id, other) WHERE r <= {cap})"""


def _bfs_sql(hops: int, limit: int) -> str:
    parts = ["f0 AS (SELECT * FROM st)", _level_sql(0, limit)]
    for d in range(1, hops + 1):
        parts += [_step_sql(d, max(20 * limit, 200)), _level_sql(d, limit)]
    return ", ".join([_E, _R, _M, _S, _UND, *parts])


def _start(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("question_id"), F.lower("s_name").alias("key"))


def _bfs(spark, sf_dir, hops, limit):
    r = written(_relations(spark, sf_dir, _entities(spark, sf_dir)))
    return graph.bounded_bfs(_start(spark, sf_dir), r, written(_mentions(spark, sf_dir)), hops, limit)


@query(f"WITH {_bfs_sql(1, 200)} SELECT question_id, chunk_id, hops, array_to_string(entities, ',') AS entities, matched FROM d1")
def graph_bfs_1hop(spark, sf_dir):
    return _bfs(spark, sf_dir, 1, 200).select("question_id", "chunk_id", "hops", F.array_join("entities", ",").alias("entities"), "matched")


@query(f"WITH {_bfs_sql(2, 300)} SELECT question_id, chunk_id, hops, array_to_string(entities, ',') AS entities, matched FROM d2")
def graph_bfs_2hop(spark, sf_dir):
    return _bfs(spark, sf_dir, 2, 300).select("question_id", "chunk_id", "hops", F.array_join("entities", ",").alias("entities"), "matched")


@query(f"WITH {_bfs_sql(3, 400)} SELECT question_id, chunk_id, hops, array_to_string(entities, ',') AS entities, matched FROM d3")
def graph_bfs_3hop(spark, sf_dir):
    return _bfs(spark, sf_dir, 3, 400).select("question_id", "chunk_id", "hops", F.array_join("entities", ",").alias("entities"), "matched")


@query(
    f"""WITH {_E}, {_R}, {_S}, {_UND}, n AS (SELECT question_id, other AS key, max(coalesce(confidence, 0)) AS confidence, list_sort(list_distinct(list(predicate))) AS predicates
FROM st JOIN ud USING (key) WHERE (question_id, other) NOT IN (SELECT (question_id, key) FROM st) GROUP BY 1, 2) SELECT question_id, key, confidence, array_to_string(predicates, ',') AS predicates FROM n"""
)
def graph_neighbors(spark, sf_dir):
    s = _start(spark, sf_dir)
    n = graph.neighbours(s, _relations(spark, sf_dir, _entities(spark, sf_dir)), s, 200)
    return n.withColumn("predicates", F.array_join("predicates", ","))


@query(
    rf"""WITH {_bfs_sql(1, 50)}, q AS (SELECT *, 'which orders mention ' || entities[1] || ' or ' || chunk_id || ' of it' AS query, 'order ' || chunk_id AS content FROM d1),
t AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(query), '[\w-]+'), lambda x: length(x) > 2)) AS asked, list_distinct(regexp_extract_all(lower(content || ' ' || array_to_string(entities, ' ')), '[\w-]+')) AS hay FROM q),
r AS (SELECT question_id, chunk_id, hops, matched, CASE WHEN len(asked) > 0 THEN len(list_intersect(asked, hay)) / len(asked)::DOUBLE ELSE 0 END AS share FROM t)
SELECT question_id, chunk_id, round(share, 6) AS relevance, round(least(1::DOUBLE, greatest(0::DOUBLE, least(1::DOUBLE, 0.5::DOUBLE + greatest(matched, 1) * 0.1::DOUBLE - hops * 0.1::DOUBLE)) * 0.7::DOUBLE + share * 0.3::DOUBLE), 6) AS score FROM r"""
)
def graph_scored(spark, sf_dir):
    b = _bfs(spark, sf_dir, 1, 50)
    b = b.withColumn("query", F.concat(F.lit("which orders mention "), F.element_at("entities", 1), F.lit(" or "), "chunk_id", F.lit(" of it"))).withColumn("content", F.concat(F.lit("order "), "chunk_id"))
    return graph.graph_score(b, "query", "content").select("question_id", "chunk_id", "relevance", "score")


@query(f"WITH {_E} SELECT key, name, type, description FROM en WHERE contains(lower(name), 'supplier') OR contains(lower(description), 'supplier') ORDER BY key LIMIT 30")
def entity_keyword_search(spark, sf_dir):
    return graph.keyword_entities(_entities(spark, sf_dir), "Supplier", 30)


@query(f"WITH {_E}, {_R}, {_M} SELECT (SELECT count(*) FROM en) AS entities, (SELECT count(*) FROM rl) AS relations, (SELECT count(*) FROM mn) AS mentions, (SELECT count(DISTINCT chunk_id) FROM mn) AS chunks")
def graph_statistics(spark, sf_dir):
    e = cut(_entities(spark, sf_dir))
    one = lambda d, *a: d.agg(*a)
    m = _mentions(spark, sf_dir)
    out = one(e, F.count("*").alias("entities")).crossJoin(one(_relations(spark, sf_dir, e), F.count("*").alias("relations")))
    return out.crossJoin(one(m, F.count("*").alias("mentions"), F.count_distinct("chunk_id").alias("chunks")))  # one row each
