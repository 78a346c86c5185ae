"""Diffs, versioned upserts and consistency of tables that describe the same chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_diff(old: DataFrame, new: DataFrame, doc: str = "doc_id", chunk: str = "chunk_id") -> DataFrame:
    """(doc, chunk, change): added, deleted or unchanged."""
    o = old.select(doc, chunk).distinct().withColumn("__o", F.lit(True))
    n = new.select(doc, chunk).distinct().withColumn("__n", F.lit(True))
    j = o.join(n, [doc, chunk], "full_outer")
    return j.select(doc, chunk, F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "deleted").otherwise("unchanged").alias("change"))


def diff_counts(changes: DataFrame, doc: str = "doc_id") -> DataFrame:
    count = lambda c: F.count_if(F.col("change") == c).cast("long").alias(c)
    return changes.groupBy(doc).agg(count("added"), count("deleted"), count("unchanged"))


def begin_documents(catalog: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch as PROCESSING rows: version one up, created_at kept."""
    b = batch.select("doc_id", F.col("content_hash").alias("__h"), F.col("at").alias("__at"))
    j = b.join(catalog.select("doc_id", "version", "created_at"), "doc_id", "left")
    return j.select(
        "doc_id",
        F.col("__h").alias("content_hash"),
        (F.coalesce("version", F.lit(0)) + 1).cast("long").alias("version"),
        F.lit("PROCESSING").alias("status"),
        F.coalesce("created_at", "__at").alias("created_at"),
        F.col("__at").alias("updated_at"),
    )


def replace(table: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """``table`` with all rows of the batch's keys replaced by the batch."""
    return table.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)


def inconsistent(catalog: DataFrame, vectors: DataFrame, graph: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks that not all three stores have: (key, in_catalog, in_vectors, in_graph)."""
    has = lambda d, n: d.select(key).distinct().withColumn(n, F.lit(True))
    j = has(catalog, "in_catalog").join(has(vectors, "in_vectors"), key, "full_outer").join(has(graph, "in_graph"), key, "full_outer")
    j = j.select(key, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_catalog", "in_vectors", "in_graph")])
    return j.where("not (in_catalog and in_vectors and in_graph)")


def detect_changes(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """(path, change): CREATED or MODIFIED files by their hashes."""
    j = files.join(catalog.select("path", F.col("content_hash").alias("__old")), "path", "left")
    return j.where("__old is null or __old <> content_hash").select("path", F.when(F.col("__old").isNull(), "CREATED").otherwise("MODIFIED").alias("change"))


def captured(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, operation) between two listings: INSERT, UPDATE, DELETE."""
    b = before.select("path", F.col("content_hash").alias("__b"))
    a = after.select("path", F.col("content_hash").alias("__a"))
    j = b.join(a, "path", "full_outer")
    op = F.when(F.col("__b").isNull(), "INSERT").when(F.col("__a").isNull(), "DELETE").when(F.col("__a") != F.col("__b"), "UPDATE")
    return j.select("path", op.alias("operation")).where("operation is not null")
