"""Evaluation, planning and evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import evidence as ev
from quillspark.functions import metrics as M
from quillspark.operators import evaluation
from quillspark.plans.registry import query
from quillspark.shared import table


@query(
    """WITH p AS (SELECT source, quality = 1 AS a, n_chars > 600 AS p FROM documents JOIN labels USING (doc_id)),
g AS (SELECT source, count(*) FILTER (WHERE p AND a) AS tp, count(*) FILTER (WHERE p AND NOT a) AS fp, count(*) FILTER (WHERE NOT p AND a) AS fn FROM p GROUP BY source)
SELECT source, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 1 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM g"""
)
def binary_f1_by_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") > 600).alias("p"))
    return evaluation.binary_f1(d.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("a")), "doc_id"), ["source"], "p", "a")


_SETS = "s AS (SELECT doc_id, list_filter([doc_id % 7, doc_id % 5, doc_id % 3, doc_id % 2], lambda x: x > 1) AS got, list_filter([doc_id % 4, doc_id % 6], lambda x: x > 2) AS want FROM documents)"


def _sets(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    m = lambda *n: F.array(*[F.col("doc_id") % x for x in n])
    return d.select("doc_id", F.filter(m(7, 5, 3, 2), lambda x: x > 1).alias("got"), F.filter(m(4, 6), lambda x: x > 2).alias("want"))


@query(f"WITH {_SETS} SELECT doc_id, round(CASE WHEN len(want) = 0 THEN 1 ELSE len(list_intersect(list_distinct(want), got)) / len(list_distinct(want))::DOUBLE END, 6) AS recall, CASE WHEN len(want) = 0 OR len(list_intersect(list_distinct(want), got)) = len(list_distinct(want)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS all_hit FROM s")
def evidence_metrics(spark, sf_dir):
    recall, hit = M.evidence(F.col("got"), F.col("want"))
    return _sets(spark, sf_dir).select("doc_id", F.round(recall, 6).alias("recall"), hit.alias("all_hit"))


@query(
    f"""WITH {_SETS}, n AS (SELECT doc_id, len(list_intersect(list_distinct(want), list_distinct(got))) AS h, len(list_distinct(got)) AS g, len(list_distinct(want)) AS w FROM s),
p AS (SELECT doc_id, CASE WHEN w > 0 THEN CASE WHEN g > 0 THEN h / g::DOUBLE ELSE 0 END END AS p, CASE WHEN w > 0 THEN h / w::DOUBLE END AS r FROM n)
SELECT doc_id, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN r IS NULL THEN NULL WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM p"""
)
def citation_prf(spark, sf_dir):
    p, r, f = M.citations(F.col("got"), F.col("want"))
    return _sets(spark, sf_dir).select("doc_id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


_TOK = "regexp_extract_all(lower({}), '[a-z0-9]+(?:[.%-][a-z0-9]+)*')"


@query(
    f"""WITH b AS (SELECT a.item_id, {_TOK.format('a.text')} AS x, {_TOK.format('b.text')} AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
u AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, unnest(x) AS t FROM b) GROUP BY ALL), v AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, unnest(y) AS t FROM b) GROUP BY ALL),
s AS (SELECT item_id, sum(least(u.n, v.n)) AS s FROM u JOIN v USING (item_id, t) GROUP BY item_id)
SELECT item_id, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1 WHEN coalesce(s, 0) = 0 THEN 0 ELSE 2 * (s / len(x)::DOUBLE) * (s / len(y)::DOUBLE) / (s / len(x)::DOUBLE + s / len(y)::DOUBLE) END, 6) AS f1 FROM b LEFT JOIN s USING (item_id)"""
)
def token_f1(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    n = b.select((F.col("item_id") - 1).alias("item_id"), M.metric_tokens(F.col("text")).alias("y"))
    return evaluation.token_f1(b.select("item_id", M.metric_tokens(F.col("text")).alias("x")).join(n, "item_id"), "item_id", "x", "y")


@query()
def cer(spark, sf_dir):
    """Whole answers, normalised. DuckDB's distance counts bytes, so this is tested against plain Python."""
    b = table(spark, sf_dir, "benchmark").select("item_id", M.nfkc_answer("text").alias("a"))
    j = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b")), "item_id")
    return j.select("item_id", F.round(M.error_rate(F.col("a"), F.col("b")), 6).alias("cer"))


@query(
    """WITH n AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS a, round(round(l_extendedprice, 2) * (1 + (l_orderkey % 3) * 0.00008::DOUBLE), 2) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN abs(a - b) <= greatest(0.005::DOUBLE, 0.0001::DOUBLE * greatest(abs(a), abs(b))) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS equal FROM n"""
)
def numeric_equal(spark, sf_dir):
    a = F.round("l_extendedprice", 2)
    b = F.round(a * (1 + (F.col("l_orderkey") % 3) * 0.00008), 2)
    said = lambda c: F.concat(F.lit("about "), F.format_number(c, 2))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", M.numeric_equal(said(a), said(b)).alias("equal"))


@query("WITH a AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM benchmark) SELECT a.item_id, CASE WHEN len(list_intersect(a.w, b.w)) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS accuracy FROM a JOIN a b ON b.item_id = a.item_id + 1")
def overlap_accuracy(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    j = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("b")), "item_id")
    return j.select("item_id", M.overlap_accuracy(F.col("text"), F.col("b")).alias("accuracy"))


@query(
    """WITH c AS (SELECT p_partkey, list_distinct(list_transform(string_split(lower(p_name || ' | ' || p_brand || ' | ' || p_type), ' | '), lambda x: trim(x))) AS x, list_distinct(list_transform(string_split(lower(p_name || ' | ' || p_type || ' | other'), ' | '), lambda x: trim(x))) AS y FROM part)
SELECT p_partkey, round(2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)), 6) AS f1 FROM c"""
)
def table_cell_f1(spark, sf_dir):
    cells = lambda *c: F.array_distinct(F.transform(F.split(F.lower(F.concat_ws(" | ", *c)), r" \| "), lambda x: F.trim(x)))
    p = table(spark, sf_dir, "part").select("p_partkey", cells("p_name", "p_brand", "p_type").alias("x"), cells("p_name", "p_type", F.lit("other")).alias("y"))
    return p.select("p_partkey", F.round(2.0 * F.size(F.array_intersect("x", "y")) / (F.size("x") + F.size("y")), 6).alias("f1"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(coalesce(avg(value), 0), 6) AS mean FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.round(evaluation.mean(F.col("value")), 6).alias("mean"))


@query(
    """WITH r AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'vector' ELSE 'hybrid' END AS mode, event_type AS category, (event_id % 3 = 0)::INT::DOUBLE AS em, (event_id % 7) / 7.0::DOUBLE AS f1, value FROM events)
SELECT category, mode, count(*) AS cases, round(coalesce(avg(em), 0), 6) AS mean_em, round(coalesce(avg(f1), 0), 6) AS mean_f1, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM r GROUP BY GROUPING SETS ((mode), (category, mode))"""
)
def summary_grouping_sets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    r = e.select(F.when(F.col("user_id") % 2 == 0, "vector").otherwise("hybrid").alias("mode"), F.col("event_type").alias("category"), (F.col("event_id") % 3 == 0).cast("double").alias("em"), ((F.col("event_id") % 7) / 7.0).alias("f1"), "value")
    return evaluation.summary(r, "mode", "category", ["em", "f1"], "value")


def _records(spark, sf_dir):
    d = table(spark, sf_dir, "labels")
    mode = F.explode(F.array(F.lit("vector"), F.lit("hybrid"))).alias("mode")
    d = d.select(F.col("doc_id").alias("sample_id"), "quality", "toxic", mode)
    return d.select("sample_id", "mode", F.when(F.col("mode") == "vector", F.col("quality")).otherwise(F.col("toxic")).cast("double").alias("em"))


@query("SELECT count(*) FILTER (WHERE toxic > quality) AS improved, count(*) FILTER (WHERE toxic = quality) AS tied, count(*) FILTER (WHERE toxic < quality) AS worse, round(avg(toxic - quality), 6) AS mean_gain FROM labels")
def paired_gain(spark, sf_dir):
    return evaluation.changes(evaluation.paired(_records(spark, sf_dir), "sample_id", "mode", "em", "vector", "hybrid"))


@query()
def bootstrap_ci(spark, sf_dir):
    return evaluation.bootstrap(evaluation.paired(_records(spark, sf_dir), "sample_id", "mode", "em", "vector", "hybrid"))


@query("WITH m AS (SELECT 'quality' AS name, avg(quality) AS value FROM labels UNION ALL SELECT 'toxic', avg(toxic) FROM labels), g AS (SELECT * FROM (VALUES ('quality', 'min', 0.5::DOUBLE), ('toxic', 'max', 0.05::DOUBLE), ('coverage', 'min', 0.8::DOUBLE)) t(name, direction, lim)) SELECT name, round(value, 6) AS value, lim AS \"limit\", CASE WHEN direction = 'min' THEN value >= lim ELSE value <= lim END AS passed FROM g LEFT JOIN m USING (name)")
def gates(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    m = lab.agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t")).select(F.explode(F.array(F.struct(F.lit("quality").alias("name"), F.col("q").alias("value")), F.struct(F.lit("toxic").alias("name"), F.col("t").alias("value")))).alias("m")).select("m.*")
    g = spark.createDataFrame([("quality", "min", 0.5), ("toxic", "max", 0.05), ("coverage", "min", 0.8)], "name string, direction string, limit double")
    return evaluation.gates(m, g).withColumn("value", F.round("value", 6))


@query("SELECT doc_id, source, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('42' || doc_id), doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 300")
def stratified_round_robin(spark, sf_dir):
    order = [F.sha2(F.concat(F.lit("42"), F.col("doc_id").cast("string")), 256), F.col("doc_id")]
    return evaluation.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", order, 300).select("doc_id", "source", "turn")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 100")
def evidence_doc_topn(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "l_partkey").limit(100)


@query("SELECT l_orderkey, count(*) AS evidence FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_suppkey % 3 <> 0)")
def containment_filter(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("evidence"), F.bool_and(F.col("l_suppkey") % 3 != 0).alias("inside"))
    return g.where("inside").select("l_orderkey", "evidence")


@query("SELECT item_id, mode FROM benchmark, (SELECT unnest(['vector', 'hybrid']) AS mode) WHERE NOT (item_id % 4 = 0 AND mode = 'vector') AND NOT (item_id % 6 = 0 AND mode = 'hybrid')")
def pending_work(spark, sf_dir):
    grid = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(F.lit("vector"), F.lit("hybrid"))).alias("mode"))
    return evaluation.pending(grid, grid.where("(item_id % 4 = 0 and mode = 'vector') or (item_id % 6 = 0 and mode = 'hybrid')"), ["item_id", "mode"])


_ASK = "(CASE turn % 7 WHEN 0 THEN 'Is it consistent? ' WHEN 1 THEN 'Was this before ' WHEN 2 THEN 'not consistent ' WHEN 3 THEN 'What happened at the same time after ' WHEN 4 THEN 'not inconsistent ' WHEN 5 THEN 'Did ' ELSE 'Who ' END || text)"


def _has(*m: str) -> str:
    return "(" + " OR ".join(f"contains(q, '{x}')" for x in m) + ")"


@query(
    f"""WITH a AS (SELECT conv_id, turn, lower({_ASK}) AS q FROM conversations), t AS (SELECT *, {_has(*ev.TEMPORAL)} AS temporal FROM a)
SELECT conv_id, turn, CASE WHEN temporal THEN 'temporal' ELSE 'factoid' END AS intent,
 CASE WHEN temporal OR {" OR ".join(f"starts_with(q, '{b}')" for b in ev.BOOLEAN)} OR contains(q, '是否') THEN 'boolean' ELSE 'text' END AS answer_type,
 CASE WHEN NOT temporal THEN 'none' {" ".join(f"WHEN {_has(*m)} THEN '{r}'" for r, m in ev.RELATIONS)} ELSE 'changed_claim' END AS target_relation,
 CASE WHEN temporal THEN 2 ELSE 1 END::BIGINT AS n_queries FROM t"""
)
def fallback_plan(spark, sf_dir):
    k = F.col("turn") % 7
    heads = ["Is it consistent? ", "Was this before ", "not consistent ", "What happened at the same time after ", "not inconsistent ", "Did "]
    head = F.when(k == 0, heads[0])
    for i, h in enumerate(heads[1:], 1):
        head = head.when(k == i, h)
    c = table(spark, sf_dir, "conversations").withColumn("p", ev.fallback_plan(F.concat(head.otherwise("Who "), "text")))
    return c.select("conv_id", "turn", "p.intent", "p.answer_type", "p.target_relation", F.size("p.queries").cast("long").alias("n_queries"))


@query(
    """WITH p AS (SELECT item_id, list_filter(list_transform([' ' || left(text, 20), '', 'b ', '  ', 'c', 'd'], lambda x: trim(x)), lambda x: x <> '')[1:3] AS q, list_filter(list_transform(['x', ' x ', '', 'y' || (item_id % 3)], lambda x: trim(x)), lambda x: x <> '') AS e FROM benchmark)
SELECT item_id, array_to_string(q, '~') AS queries, 'x~y' || (item_id % 3) AS entities, array_to_string(list_transform(range(1, len(q) + 1), lambda i: 'evidence_' || i), '~') AS slots FROM p"""
)
def plan_normalise(spark, sf_dir):
    q = F.array(F.concat(F.lit(" "), F.left("text", F.lit(20))), *[F.lit(x) for x in ("", "b ", "  ", "c", "d")])
    e = F.array(F.lit("x"), F.lit(" x "), F.lit(""), F.concat(F.lit("y"), (F.col("item_id") % 3).cast("string")))
    a, b, c = ev.normal_plan(q, e)
    return table(spark, sf_dir, "benchmark").select("item_id", *[F.array_join(x, "~").alias(n) for x, n in ((a, "queries"), (b, "entities"), (c, "slots"))])


_INTENT = "CASE doc_id % 5 WHEN 0 THEN 'comparative' WHEN 1 THEN 'temporal' WHEN 2 THEN 'exploratory' WHEN 3 THEN 'factoid' ELSE 'strange' END"


def _intents(spark, sf_dir):
    k = F.col("doc_id") % 5
    return table(spark, sf_dir, "documents").select("doc_id", F.when(k == 0, "comparative").when(k == 1, "temporal").when(k == 2, "exploratory").when(k == 3, "factoid").otherwise("strange").alias("intent"))


@query(
    f"""WITH i AS (SELECT doc_id, {_INTENT} AS intent, CASE WHEN doc_id % 5 < 3 THEN 'boolean' ELSE 'text' END AS answer_type, CASE doc_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'before' ELSE 'same_claim' END AS relation, doc_id % 7 % 3 AS slots FROM documents)
SELECT doc_id, intent, CASE intent WHEN 'analytical' THEN 2 WHEN 'comparative' THEN 2 WHEN 'temporal' THEN 2 WHEN 'exploratory' THEN 3 ELSE 1 END AS hops,
 CASE WHEN doc_id % 4 = 0 THEN 'abstain' WHEN answer_type = 'boolean' AND slots >= 2 AND relation NOT IN ('before', 'after', 'same_time') THEN 'comparison' WHEN relation <> 'none' THEN 'temporal' WHEN doc_id % 2 = 0 THEN 'calculator' ELSE 'answer' END AS route,
 CASE WHEN doc_id % 4 = 0 OR doc_id % 3 = 0 THEN 0.35::DOUBLE WHEN intent IN ('comparative', 'temporal', 'analytical') AND doc_id % 3 >= 2 THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END AS weight FROM i"""
)
def route(spark, sf_dir):
    i = _intents(spark, sf_dir)
    k = F.col("doc_id")
    found, entities = k % 4, k % 3
    answer, relation = F.when(k % 5 < 3, "boolean").otherwise("text"), F.when(entities == 0, "none").when(entities == 1, "before").otherwise("same_claim")
    return i.select("doc_id", "intent", ev.hops(F.col("intent")).alias("hops"), ev.route(found, answer, k % 7 % 3, relation, k % 2 == 0).alias("route"), ev.graph_weight(found, F.col("intent"), entities).alias("weight"))


@query(
    """WITH d AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 3 THEN '2024-13-99' ELSE 'soon' END AS l, strftime(o_orderdate, '%Y-%m-01') AS r, o_orderdate FROM orders),
p AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN date_trunc('year', o_orderdate)::DATE WHEN 1 THEN date_trunc('month', o_orderdate)::DATE WHEN 2 THEN o_orderdate::DATE END AS a, date_trunc('month', o_orderdate)::DATE AS b FROM d),
q AS (SELECT *, CASE WHEN a IS NULL THEN 'unknown' WHEN a < b THEN 'before' WHEN a > b THEN 'after' ELSE 'same_time' END AS relation FROM p)
SELECT o_orderkey, a AS left_date, relation, CASE WHEN relation = 'unknown' THEN NULL WHEN relation = 'before' THEN 'Yes' ELSE 'No' END AS answer FROM q"""
)
def date_relation(spark, sf_dir):
    k, at = F.col("o_orderkey") % 5, F.col("o_orderdate")
    told = F.when(k == 0, F.date_format(at, "yyyy")).when(k == 1, F.date_format(at, "yyyy-MM")).when(k == 2, F.date_format(at, "yyyy/MM/dd")).when(k == 3, "2024-13-99").otherwise("soon")
    o = table(spark, sf_dir, "orders").select("o_orderkey", ev.evidence_date(told).alias("left_date"), ev.evidence_date(F.date_format(at, "yyyy-MM")).alias("b"))
    o = o.withColumn("relation", ev.date_relation(F.col("left_date"), F.col("b")))
    return o.select("o_orderkey", "left_date", "relation", ev.yes_no(F.col("relation"), F.lit("before")).alias("answer"))


@query(
    """WITH s AS (SELECT doc_id, [CASE doc_id % 3 WHEN 0 THEN NULL ELSE quality = 1 END, toxic = 0] AS v, CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'no' END AS claimed FROM labels)
SELECT doc_id, CASE WHEN v[1] IS NULL OR v[2] IS NULL THEN 'abstain' WHEN claimed = 'yes' THEN CASE WHEN v[1] AND v[2] THEN 'yes' ELSE 'abstain' END ELSE 'no' END AS verdict FROM s"""
)
def claim_verdict(spark, sf_dir):
    v = F.array(F.when(F.col("doc_id") % 3 != 0, F.col("quality") == 1), F.col("toxic") == 0)
    return table(spark, sf_dir, "labels").select("doc_id", ev.verdict(v, F.when(F.col("doc_id") % 2 == 0, "yes").otherwise("no")).alias("verdict"))


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) = 3 AS covered, CASE WHEN count(DISTINCT l_shipdate::DATE) = 1 THEN max(l_shipdate::DATE) END AS consensus FROM lineitem GROUP BY l_orderkey")
def slot_coverage(spark, sf_dir):
    day = F.to_date("l_shipdate")
    need = F.array(F.lit("A"), F.lit("N"), F.lit("R"))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("have"), F.when(F.count_distinct(day) == 1, F.max(day)).alias("consensus"))
    return g.select("l_orderkey", (F.size(F.array_except(need, "have")) == 0).alias("covered"), "consensus")


@query(
    f"""WITH {_SETS}, c AS (SELECT doc_id, len(list_intersect(list_distinct(got), want)) AS n, list_sum(list_intersect(list_distinct(got), want)) AS t, doc_id % 3 <> 0 AS answerable FROM s)
SELECT doc_id, n AS cited, answerable AND n > 0 AS answerable, coalesce(round(least(1::DOUBLE, t / n::DOUBLE / 5), 4), 0) AS evidence_score FROM c"""
)
def citation_gate(spark, sf_dir):
    s = _sets(spark, sf_dir).withColumn("c", ev.valid_citations(F.col("got"), F.col("want")))
    mean = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x) / F.nullif(F.size("c"), F.lit(0)) / 5
    return s.select("doc_id", F.size("c").cast("long").alias("cited"), ev.gate(F.col("doc_id") % 3 != 0, F.col("c")).alias("answerable"), F.coalesce(F.round(F.least(F.lit(1.0), mean), 4), F.lit(0.0)).alias("evidence_score"))


@query("SELECT user_id, sum(event_id % 11)::BIGINT AS input_tokens, sum(event_id % 5)::BIGINT AS output_tokens, count(*) AS calls, ceil(sum(event_id % 11) / 10.0::DOUBLE)::BIGINT AS batches FROM events GROUP BY user_id")
def usage_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = lambda m: F.sum(F.coalesce(F.col("event_id") % m, F.lit(0))).cast("long")
    return e.groupBy("user_id").agg(n(11).alias("input_tokens"), n(5).alias("output_tokens"), F.count("*").alias("calls"), F.ceil(n(11) / 10.0).cast("long").alias("batches"))


@query("SELECT doc_id, nullif(regexp_extract(t, '(?s)\\{.*\\}'), '') AS object FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '```json' || chr(10) || '{\"a\": ' || doc_id || '}' || chr(10) || '```' WHEN doc_id % 3 = 1 THEN 'so {\"b\": {\"c\": 1}} it is' ELSE 'none' END AS t FROM documents)")
def json_recovery(spark, sf_dir):
    from quillspark.functions.text import json_object_in

    k = F.col("doc_id") % 3
    t = F.when(k == 0, F.concat(F.lit('```json\n{"a": '), F.col("doc_id").cast("string"), F.lit("}\n```"))).when(k == 1, 'so {"b": {"c": 1}} it is').otherwise("none")
    return table(spark, sf_dir, "documents").select("doc_id", json_object_in(t).alias("object"))
