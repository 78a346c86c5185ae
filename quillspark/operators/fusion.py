"""Reciprocal-rank fusion in its four forms, deduplication, caps, diversity and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.settings import DEFAULTS

C = DEFAULTS.rrf_constant


def term(rank: Column, weight: Column | float = 1.0, constant: int = C) -> Column:
    return (F.lit(weight) if not isinstance(weight, Column) else weight) / (constant + rank)


def by_max(df: DataFrame, column: str, key: str, into: str = "score") -> DataFrame:
    """``column`` over its maximum in ``key``, rounded; 0 where the maximum is 0."""
    top = F.max(column).over(Window.partitionBy(key))
    return df.withColumn(into, F.round(F.when(top > 0, F.col(column) / top).otherwise(0.0), 9))


def merge_queries(hits: DataFrame, question: str, query: str, chunk: str, rank: str, slot: str) -> DataFrame:
    """Fuses the sub-queries of a question: raw ranks (a repeat keeps its first), weight 1, slots gathered."""
    once = hits.groupBy(question, query, slot, chunk).agg(F.min(rank).alias("__rank"))
    f = once.groupBy(question, chunk).agg(F.sum(term(F.col("__rank"))).alias("__rrf"), F.array_sort(F.collect_set(slot)).alias("slots"))
    return by_max(f, "__rrf", question).drop("__rrf")


def merge_modalities(hits: DataFrame, question: str, chunk: str, rank: str, weight: Column) -> DataFrame:
    """Fuses modalities: raw ranks, a weight for each."""
    f = hits.groupBy(question, chunk).agg(F.sum(term(F.col(rank), weight)).alias("__rrf"))
    return by_max(f, "__rrf", question).drop("__rrf")


def fuse_sources(hits: DataFrame, question: str, chunk: str, source: str, score: str, weights: dict[str, float], weight: str | None = None) -> DataFrame:
    """Fuses sources: best row of each chunk in a source, ranks compacted, weighted by source or,
    where a row has one, by its column ``weight``; with the set of sources. Order: score,
    number of sources, vector first, chunk."""
    own = F.max(weight) if weight else F.lit(None).cast("double")
    best = hits.groupBy(question, source, chunk).agg(F.max(score).alias("__s"), own.alias("__own"))
    rank = F.row_number().over(Window.partitionBy(question, source).orderBy(F.col("__s").desc(), chunk))
    weight = F.coalesce("__own", F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(source)])
    f = best.withColumn("__rank", rank).groupBy(question, chunk).agg(F.sum(term(F.col("__rank"), weight)).alias("__rrf"), F.array_sort(F.collect_set(source)).alias("sources"))
    f = by_max(f, "__rrf", question).drop("__rrf")
    order = [F.col("score").desc(), F.size("sources").desc(), F.when(F.array_contains("sources", "vector"), 0).otherwise(1), F.col(chunk)]
    return f.withColumn("rank", F.row_number().over(Window.partitionBy(question).orderBy(*order)).cast("long"))


def deduplicate(contexts: DataFrame, question: str, chunk: str, score: str, source: str) -> DataFrame:
    """One row for each chunk: highest score, sources joined; ``hybrid`` where there are several."""
    d = contexts.groupBy(question, chunk).agg(F.max(score).alias("score"), F.array_sort(F.collect_set(source)).alias("sources"))
    return d.withColumn("source_type", F.when(F.size("sources") > 1, "hybrid").otherwise(F.element_at("sources", 1)))


def rerank(candidates: DataFrame, scores: DataFrame, question: str, chunk: str) -> DataFrame:
    """Candidates (question, chunk, rank) with slot scores (question, slot, chunk, score):
    a base term from the input order, a term for each slot, slots in which it ranks in the first four."""
    order = F.row_number().over(Window.partitionBy(question, "slot").orderBy(F.col("score").desc(), "rank"))
    ranked = scores.join(candidates, [question, chunk]).withColumn("__r", order)
    by_slot = ranked.groupBy(question, chunk).agg(
        F.sum(term(F.col("__r"), DEFAULTS.slot_weight)).alias("__slots"),
        F.max("score").alias("rerank_score"),
        F.array_sort(F.collect_set(F.when(F.col("__r") <= DEFAULTS.slot_match_top, F.col("slot")))).alias("slot_ids"),
    )
    f = candidates.join(by_slot, [question, chunk], "left").withColumn("__rrf", term(F.col("rank"), DEFAULTS.base_weight) + F.coalesce("__slots", F.lit(0.0)))
    f = by_max(f, "__rrf", question).drop("__rrf", "__slots", "rank")
    return f.withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0))).withColumn("slot_ids", F.coalesce("slot_ids", F.array().cast("array<string>")))


def cap_per_document(ranked: DataFrame, question: str, doc: str, rank: str, cap: int, k: int) -> DataFrame:
    """At most ``cap`` chunks of a document, then the first k."""
    c = ranked.withColumn("__n", F.row_number().over(Window.partitionBy(question, doc).orderBy(rank))).where(F.col("__n") <= cap)
    return c.withColumn("position", F.row_number().over(Window.partitionBy(question).orderBy(rank)).cast("long")).where(F.col("position") <= k).drop("__n")


def diverse(ranked: DataFrame, question: str, doc: str, rank: str, cap: int, k: int) -> DataFrame:
    """Chunks within the cap first, then those beyond it, k in all."""
    c = ranked.withColumn("__over", F.row_number().over(Window.partitionBy(question, doc).orderBy(rank)) > cap)
    return c.withColumn("position", F.row_number().over(Window.partitionBy(question).orderBy("__over", rank)).cast("long")).where(F.col("position") <= k).drop("__over")


def first_documents(ranked: DataFrame, question: str, doc: str, rank: str, k: int) -> DataFrame:
    d = ranked.groupBy(question, doc).agg(F.min(rank).cast("long").alias("first_rank"))
    return d.withColumn("position", F.row_number().over(Window.partitionBy(question).orderBy("first_rank")).cast("long")).where(F.col("position") <= k)


def _ranked(rows: DataFrame, question: str, fields: list[str], more: list[Column]) -> DataFrame:
    """One row for each question: its rows as an array in rank order. A question's candidates
    are bounded by its depth."""
    return rows.groupBy(question).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("__rows"), *more)


def pack_slots(candidates: DataFrame, question: str, top_k: int, cap: int = DEFAULTS.chunks_per_document) -> DataFrame:
    """Greedy packing: for each required slot the first match, of an unseen document if
    there is one; then the rest in order; at most ``cap`` of a document.

    Needs columns chunk_id, doc_id, rank, slot_ids and ``required`` (slots, in order). Two folds
    over a question's candidates, the first over its slots; what is packed is the state."""
    one = _ranked(candidates, question, ["rank", "chunk_id", "doc_id", "slot_ids"], [F.first("required").alias("__slots")])
    kind = one.schema["__rows"].dataType.simpleString()
    rows = F.col("__rows")
    seen = lambda done, x: F.exists(done, lambda y: y["doc_id"].eqNullSafe(x["doc_id"]))
    fits = lambda done, x: ~F.exists(done, lambda y: y["chunk_id"] == x["chunk_id"]) & (F.size(F.filter(done, lambda y: y["doc_id"].eqNullSafe(x["doc_id"]))) < cap)

    def for_slot(done: Column, slot: Column) -> Column:
        open_ = F.filter(rows, lambda x: F.array_contains(x["slot_ids"], slot) & fits(done, x))
        pick = F.slice(F.concat(F.filter(open_, lambda x: ~seen(done, x)), open_), 1, 1)
        return F.when(F.size(done) < top_k, F.concat(done, pick)).otherwise(done)

    def fill(done: Column, x: Column) -> Column:
        return F.when((F.size(done) < top_k) & fits(done, x), F.concat(done, F.array(x))).otherwise(done)

    none = F.array().cast(kind)
    one = one.withColumn("__done", F.aggregate(F.coalesce("__slots", F.array().cast("array<string>")), none, for_slot))
    one = one.withColumn("__done", F.aggregate(rows, F.col("__done"), fill))
    packed = one.select(question, F.posexplode("__done").alias("__at", "__x"))
    return packed.select(question, "__x.chunk_id", "__x.doc_id", (F.col("__at") + 1).cast("long").alias("position"))


def bind_citations(contexts: DataFrame, answers: DataFrame, question: str) -> DataFrame:
    """Answers (question, required, cited) with one citation of its own for each required slot.

    Contexts have chunk_id, rank and slot_ids; returns question, citation_ids, added. A fold over
    the slots: (ids so far, ids that serve a slot)."""
    one = _ranked(contexts, question, ["rank", "chunk_id", "slot_ids"], []).join(answers, question)
    rows = F.col("__rows")
    ids = F.transform(rows, lambda x: x["chunk_id"])
    valid = F.array_distinct(F.filter("cited", lambda c: F.array_contains(ids, c)))
    kind = f"array<{one.schema['__rows'].dataType.elementType['chunk_id'].dataType.simpleString()}>"

    def bind(state: Column, slot: Column) -> Column:
        serves = F.transform(F.filter(rows, lambda x: F.array_contains(x["slot_ids"], slot)), lambda x: x["chunk_id"])
        free = F.array_except(serves, state["used"])
        # A citation that is there already goes before the best context that isn't cited.
        pick = F.slice(F.concat(F.filter(state["ids"], lambda c: F.array_contains(free, c)), free), 1, 1)
        return F.struct(F.concat(state["ids"], F.array_except(pick, state["ids"])).alias("ids"), F.concat(state["used"], pick).alias("used"))

    start = F.struct(valid.cast(kind).alias("ids"), F.array().cast(kind).alias("used"))
    one = one.withColumn("__bound", F.aggregate("required", start, bind, lambda x: x["ids"]))
    return one.select(question, F.col("__bound").alias("citation_ids"), (F.size("__bound") - F.size(valid)).cast("long").alias("added"))
