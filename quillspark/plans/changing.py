"""Diff, upsert, consistency and change-event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import cdc, diff
from quillspark.plans.registry import query
from quillspark.shared import table

_OLD = "od AS (SELECT doc_id % 50 AS doc_id, sha256(text) AS chunk_id FROM documents WHERE doc_id % 3 <> 0)"
_NEW = "nw AS (SELECT doc_id % 50 AS doc_id, sha256(text) AS chunk_id FROM documents WHERE doc_id % 4 <> 0)"
_CHG = "ch AS (SELECT doc_id, chunk_id, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'deleted' ELSE 'unchanged' END AS change FROM (SELECT DISTINCT *, 1 AS o FROM od) FULL JOIN (SELECT DISTINCT *, 1 AS n FROM nw) USING (doc_id, chunk_id))"


def _versions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 50).alias("d"), F.sha2(F.col("text").cast("binary"), 256).alias("chunk_id"))
    side = lambda m: d.where(F.col("doc_id") % m != 0).select(F.col("d").alias("doc_id"), "chunk_id")
    return side(3), side(4)


@query(f"WITH {_OLD}, {_NEW}, {_CHG} SELECT * FROM ch")
def chunk_diff(spark, sf_dir):
    return diff.chunk_diff(*_versions(spark, sf_dir))


@query(f"WITH {_OLD}, {_NEW}, {_CHG} SELECT doc_id, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'deleted') AS deleted, count(*) FILTER (WHERE change = 'unchanged') AS unchanged FROM ch GROUP BY doc_id")
def cdc_apply_counts(spark, sf_dir):
    return diff.diff_counts(diff.chunk_diff(*_versions(spark, sf_dir)))


@query(f"WITH {_OLD}, {_NEW} SELECT 'new' AS side, chunk_id FROM (SELECT chunk_id FROM nw EXCEPT SELECT chunk_id FROM od) UNION ALL SELECT 'old', chunk_id FROM (SELECT chunk_id FROM od EXCEPT SELECT chunk_id FROM nw) UNION ALL SELECT 'both', chunk_id FROM (SELECT chunk_id FROM od INTERSECT SELECT chunk_id FROM nw)")
def set_operations(spark, sf_dir):
    old, new = (x.select("chunk_id") for x in _versions(spark, sf_dir))
    named = lambda n, d: d.select(F.lit(n).alias("side"), "chunk_id")
    return named("new", new.subtract(old)).unionByName(named("old", old.subtract(new))).unionByName(named("both", old.intersect(new)))


@query(
    """WITH c AS (SELECT doc_id FROM documents WHERE doc_id % 7 <> 1), v AS (SELECT doc_id FROM documents WHERE doc_id % 5 <> 2), g AS (SELECT doc_id FROM documents WHERE doc_id % 11 <> 3)
SELECT doc_id AS chunk_id, doc_id % 7 <> 1 AS in_catalog, doc_id % 5 <> 2 AS in_vectors, doc_id % 11 <> 3 AS in_graph FROM documents
WHERE NOT (doc_id % 7 <> 1 AND doc_id % 5 <> 2 AND doc_id % 11 <> 3) AND (doc_id % 7 <> 1 OR doc_id % 5 <> 2 OR doc_id % 11 <> 3)"""
)
def consistency_check(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"))
    return diff.inconsistent(d.where("chunk_id % 7 <> 1"), d.where("chunk_id % 5 <> 2"), d.where("chunk_id % 11 <> 3"))


@query(
    """SELECT d.doc_id, sha256(d.text || 'x') AS content_hash, coalesce(c.version, 0) + 1 AS version, 'PROCESSING' AS status, coalesce(c.created_at, 9.5::DOUBLE) AS created_at, 9.5::DOUBLE AS updated_at
FROM documents d LEFT JOIN (SELECT doc_id, (doc_id % 4)::BIGINT AS version, doc_id::DOUBLE AS created_at FROM documents WHERE doc_id % 2 = 0) c USING (doc_id) WHERE d.doc_id % 3 = 0"""
)
def versioned_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    catalog = d.where("doc_id % 2 = 0").select("doc_id", (F.col("doc_id") % 4).cast("long").alias("version"), F.col("doc_id").cast("double").alias("created_at"))
    batch = d.where("doc_id % 3 = 0").select("doc_id", F.sha2(F.concat("text", F.lit("x")).cast("binary"), 256).alias("content_hash"), F.lit(9.5).alias("at"))
    return diff.begin_documents(catalog, batch)


@query("SELECT doc_id, source, n_chars, 'old' AS origin FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 29 = 0) UNION ALL SELECT doc_id, source, n_chars, 'new' FROM documents WHERE doc_id % 29 = 0")
def replace_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return diff.replace(d.withColumn("origin", F.lit("old")), d.where("doc_id % 29 = 0").withColumn("origin", F.lit("new")), "source")


@query("SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def migration_missing(spark, sf_dir):
    done = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("chunk_id"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id")).join(done, "chunk_id", "left_anti")


@query("SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'CREATED' ELSE 'MODIFIED' END AS change FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def change_detection(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    old = d.where("doc_id % 3 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 5 == 0, "stale").otherwise(F.col("content_hash")))
    return diff.detect_changes(d.select("path", "content_hash"), old.select("path", "content_hash"))


@query("SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'INSERT' WHEN doc_id % 5 = 0 THEN 'DELETE' ELSE 'UPDATE' END AS operation FROM documents WHERE (doc_id % 3 = 0) <> (doc_id % 5 = 0) OR (doc_id % 15 <> 0 AND doc_id % 7 = 0)")
def snapshot_capture(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    before = d.where("doc_id % 3 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 7 == 0, "stale").otherwise(F.col("content_hash")))
    return diff.captured(before, d.where("doc_id % 5 <> 0")).select("path", "operation")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, n, event_id, t AS last, true AS go FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN e.t - w.last >= 86400000000 THEN e.t ELSE w.last END, e.t - w.last >= 86400000000 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, event_id FROM w WHERE go"""
)
def debounce_leading_edge(spark, sf_dir):
    """With a day instead of two seconds, the test stream being sparse."""
    return cdc.debounce(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 86400.0)


@query("SELECT event_id, event_type FROM events WHERE event_id % 3 <> 0")
def event_idempotency(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    ledger = e.select("event_id", F.when(F.col("event_id") % 3 == 0, "COMMITTED").otherwise("FAILED").alias("status"))
    return cdc.fresh(e.unionByName(e), ledger)


@query(
    """WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'COMMITTED' WHEN 1 THEN 'APPLYING' WHEN 2 THEN 'FAILED' ELSE 'PENDING' END AS status, event_id % 5 AS attempts FROM events),
c AS (SELECT *, status NOT IN ('COMMITTED', 'APPLYING') AND attempts < 3 AS claimed FROM s)
SELECT event_id, CASE WHEN claimed THEN 'APPLYING' ELSE status END AS status, attempts + claimed::BIGINT AS attempts, claimed FROM c"""
)
def ledger_claim(spark, sf_dir):
    n = F.col("event_id") % 4
    e = table(spark, sf_dir, "events").select("event_id", F.when(n == 0, "COMMITTED").when(n == 1, "APPLYING").when(n == 2, "FAILED").otherwise("PENDING").alias("status"), (F.col("event_id") % 5).alias("attempts"))
    return cdc.claim(e)


@query(
    """WITH a AS (SELECT user_id AS event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, event_type = 'purchase' AS ok FROM events),
g AS (SELECT event_id, min(attempt) FILTER (WHERE ok) AS f, count(*) AS n FROM a GROUP BY event_id)
SELECT event_id, CASE WHEN f <= 3 THEN 'COMMITTED' WHEN n >= 3 THEN 'FAILED' ELSE 'PENDING' END AS status, least(CASE WHEN f <= 3 THEN f ELSE n END, 3) AS attempts FROM g"""
)
def ledger_fold(spark, sf_dir):
    e = cdc.ordinal_of(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])
    return cdc.fold_ledger(e.select(F.col("user_id").alias("event_id"), F.col("ordinal").alias("attempt"), (F.col("event_type") == "purchase").alias("ok")))


@query("SELECT event_id, CASE WHEN event_type = 'view' AND value < 50 THEN 'FAILED' WHEN event_type = 'view' THEN 'APPLYING' ELSE 'PENDING' END AS status, CASE WHEN event_type = 'view' AND value < 50 THEN 'interrupted' ELSE '' END AS error FROM events")
def stale_recovery(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "APPLYING").otherwise("PENDING").alias("status"), F.lit("").alias("error"), F.col("value").alias("updated_at"))
    return cdc.recover(e, F.lit(50.0)).select("event_id", "status", "error")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_snapshot(spark, sf_dir):
    return cdc.last_snapshot(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("SELECT event_id, event_type, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS operation FROM events WHERE event_type IN ('signup', 'purchase', 'view', 'click', 'error')")
def change_operations(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", cdc.operation(F.col("event_type")).alias("operation")).where("operation is not null")


@query("SELECT sum(least(n_chars % 21, 20))::BIGINT AS retained, (count(*) * 20)::BIGINT AS expected, round(sum(least(n_chars % 21, 20)) / (count(*) * 20)::DOUBLE, 6) AS retention FROM documents")
def retention(spark, sf_dir):
    return cdc.retained(table(spark, sf_dir, "documents").select((F.col("n_chars") % 21).alias("unchanged"), F.lit(20).alias("expected")))


@query(
    """WITH v AS (SELECT d, n, unnest([1, 2, 3, 4]) AS v FROM (SELECT unnest(range(100)) AS d), (SELECT unnest(range(1, 21)) AS n)),
k AS (SELECT d AS doc_id, v AS version, n AS section, CASE WHEN n = 2 AND v >= 2 THEN 'changed' ELSE 'original' END AS state FROM v WHERE NOT (v = 4 AND n = 3)
 UNION ALL SELECT d, v, 21, 'original' FROM (SELECT unnest(range(100)) AS d), (SELECT unnest([3, 4]) AS v))
SELECT doc_id, version::BIGINT AS version, section::BIGINT AS section, state FROM k"""
)
def cdc_300_generator(spark, sf_dir):
    """100 documents of 20 sections: v2 changes section 2, v3 appends one, v4 drops section 3."""
    d = spark.range(100).select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("version"))
    d = d.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col("version") >= 3, 21).otherwise(20).cast("long"))).alias("section"))
    d = d.where("not (version = 4 and section = 3)")
    return d.withColumn("state", F.when((F.col("section") == 2) & (F.col("version") >= 2), "changed").otherwise("original"))


@query("SELECT path, status FROM (SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 4 = 0 THEN 'FAILED' ELSE 'READY' END AS status FROM documents) WHERE status = 'READY' OR path < 'f5'")
def catalog_listing(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("doc_id") % 4 == 0, "FAILED").otherwise("READY").alias("status"))
    return d.where((F.col("status") == "READY") | (F.col("path") < "f5"))


@query("SELECT doc_id, 'FAILED' AS status, left(text, 2000) AS error FROM documents")
def fail_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.lit("FAILED").alias("status"), F.left("text", F.lit(2000)).alias("error"))


@query("SELECT 'documents' AS store, count(*) AS n, count(DISTINCT source) AS groups FROM documents UNION ALL SELECT 'vectors', count(*), count(DISTINCT label % 3) FROM embeddings UNION ALL SELECT 'events', count(*), count(DISTINCT event_type) FROM events")
def store_statistics(spark, sf_dir):
    one = lambda n, t, g: table(spark, sf_dir, t).agg(F.lit(n).alias("store"), F.count("*").alias("n"), F.count_distinct(g).alias("groups"))
    return one("documents", "documents", F.col("source")).unionByName(one("vectors", "embeddings", F.col("label") % 3)).unionByName(one("events", "events", F.col("event_type")))
