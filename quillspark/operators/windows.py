"""Context windows of neighbouring chunks, and the character budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def context_windows(chunks: DataFrame, doc: str, ordinal: str, content: str, neighbours: int = 1, most: int = 8000, unit: str | None = None, parent: str | None = None) -> DataFrame:
    """Adds ``window``: the text of the parent, then the chunk with its neighbours in the document
    that are of the same unit, each text once, parted by blank lines, cut to ``most``."""
    near = Window.partitionBy(doc).orderBy(ordinal).rowsBetween(-neighbours, neighbours)
    u = F.col(unit) if unit else F.lit("")
    around = chunks.withColumn("__near", F.collect_list(F.struct(u.alias("u"), F.col(content).alias("c"))).over(near))
    same = F.transform(F.filter("__near", lambda x: x["u"].eqNullSafe(u) | (u == "")), lambda x: x["c"])
    texts = F.concat(F.array(F.coalesce(F.col(parent) if parent else F.lit(""), F.lit(""))), same)
    # A blank text is no part; the ends of texts are stripped.
    texts = F.array_distinct(F.filter(F.transform(texts, lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), lambda t: t != ""))
    return around.withColumn("window", F.left(F.array_join(texts, "\n\n"), F.lit(most))).drop("__near")


def char_budget(ranked: DataFrame, question: str, rank: str, content: str, budget: int) -> DataFrame:
    """Rows while the budget lasts; the one that crosses it is cut. Empty contents are passed over."""
    before = Window.partitionBy(question).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    r = ranked.where(F.length(content) > 0).withColumn("__used", F.coalesce(F.sum(F.length(content)).over(before), F.lit(0)))
    r = r.where(F.col("__used") < budget).withColumn("packed", F.left(content, (budget - F.col("__used")).cast("int")))
    return r.drop("__used")
