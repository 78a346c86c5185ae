"""Documents to overlapping word windows, parents, children and content-addressed ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import digest, squeeze, words
from quillspark.settings import DEFAULTS


def windows(units: DataFrame, keys: list[str], content: str, size: int, overlap: int) -> DataFrame:
    """(keys, token_start, token_end, content): windows of ``size`` words that share
    ``overlap``; the last is the first that reaches the end, so there is no tail-only one."""
    step = size - min(overlap, size - 1)
    w = units.select(*keys, words(F.col(content)).alias("__w")).withColumn("__n", F.size("__w")).where("__n > 0")
    last = F.ceil(F.greatest(F.col("__n") - size, F.lit(0)) / step).cast("int") * step
    w = w.select("*", F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("token_start"))
    return w.select(
        *keys,
        F.col("token_start").cast("long").alias("token_start"),
        F.least(F.col("token_start") + size, F.col("__n")).cast("long").alias("token_end"),
        F.array_join(F.slice("__w", F.col("token_start") + 1, F.lit(size)), " ").alias("content"),
    )


def identified(w: DataFrame, doc_id: str, unit_id: str, marker: str = "") -> DataFrame:
    """Adds content_hash, occurrence (of the hash in its unit) and a 32-digit id."""
    w = w.withColumn("content_hash", digest(squeeze(F.col("content"))))
    nth = F.row_number().over(Window.partitionBy(doc_id, unit_id, "content_hash").orderBy("token_start")) - 1
    w = w.withColumn("occurrence", nth.cast("long"))
    parts = [F.col(doc_id).cast("string"), *([F.lit(marker)] if marker else []), F.col(unit_id), F.col("content_hash"), F.col("occurrence").cast("string")]
    return w.withColumn("chunk_id", digest(F.concat_ws("|", *parts), 32))


def with_parents(children: DataFrame, parents: DataFrame, doc_id: str, unit_id: str) -> DataFrame:
    """Each child with the parent window of its unit that it overlaps most, the first among equals.

    Windows have fixed steps, so a child can only meet parents of its own unit; the join is on the unit."""
    p = parents.select(F.col(doc_id).alias("__d"), F.col(unit_id).alias("__u"), F.col("chunk_id").alias("parent_id"), F.col("token_start").alias("parent_token_start"), F.col("token_end").alias("parent_token_end"), F.col("content").alias("parent_content"))
    meets = (F.col("token_start") < F.col("parent_token_end")) & (F.col("parent_token_start") < F.col("token_end"))
    j = children.join(p, (F.col(doc_id) == F.col("__d")) & (F.col(unit_id) == F.col("__u")) & meets, "left").drop("__d", "__u")
    shared = F.least("token_end", "parent_token_end") - F.greatest("token_start", "parent_token_start")
    best = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.coalesce(shared, F.lit(0)).desc(), "parent_token_start"))
    return j.withColumn("__best", best).where("__best = 1").drop("__best")


def chunk(units: DataFrame, doc_id: str = "doc_id", unit_id: str = "unit_id", content: str = "content", seq: str | None = None) -> DataFrame:
    """Children of the default sizes with ids, ordinals within the document and parents.

    ``seq`` is the units' place in the document, which their ids don't tell (page:10 stands
    before page:2 as text, sections are hashes); without it a document has one unit."""
    keys = [doc_id, unit_id]
    own = [*keys, seq] if seq else keys
    child = identified(windows(units, own, content, DEFAULTS.child_size, DEFAULTS.child_overlap), doc_id, unit_id)
    parent = identified(windows(units, keys, content, DEFAULTS.parent_size, DEFAULTS.parent_overlap), doc_id, unit_id, "parent")
    ordinal = F.row_number().over(Window.partitionBy(doc_id).orderBy(seq or unit_id, "token_start")) - 1
    child = child.withColumn("ordinal", ordinal.cast("long"))
    return with_parents(child.drop(seq) if seq else child, parent, doc_id, unit_id)


def row_batches(df: DataFrame, order: list[str], line: Column, size: int = DEFAULTS.row_batch, by: list[str] | None = None) -> DataFrame:
    """Rows in batches of ``size``: row_start, row_end (from 1) and the lines joined by newlines.

    The order of a single sheet is global; ``by`` names the file or sheet when there are many."""
    by = by or []
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order))
    b = df.select(*by, n.alias("__n"), line.alias("__line")).withColumn("batch", F.floor((F.col("__n") - 1) / size).cast("long"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("__n", "__line"))), lambda x: x["__line"])
    return b.groupBy(*by, "batch").agg(F.min("__n").cast("long").alias("row_start"), F.max("__n").cast("long").alias("row_end"), F.array_join(lines, "\n").alias("content"))
