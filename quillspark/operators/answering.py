"""Answers from evidence rows: temporal and comparative questions, judged natively.

Evidence (question_id, slot_id, citation_id and a date or a claim) comes from a model; all
of its citations must be among the retrieved chunks and every required slot must have
evidence, else the question abstains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import evidence as ev


def _complete(questions: DataFrame, evidence: DataFrame, contexts: DataFrame) -> DataFrame:
    """Questions (question_id, slots, relation) with ``why`` they abstain, or null."""
    seen = contexts.select("question_id", F.col("chunk_id").alias("citation_id"), F.lit(True).alias("__seen")).distinct()
    e = evidence.join(seen, ["question_id", "citation_id"], "left")
    g = e.groupBy("question_id").agg(
        F.bool_and(F.coalesce("__seen", F.lit(False))).alias("cited"),
        F.collect_set("slot_id").alias("have"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("slot_id", "citation_id"))), lambda x: x["citation_id"])).alias("citation_ids"),
    )
    q = questions.join(g, "question_id", "left")
    missing = F.size(F.array_except("slots", F.coalesce("have", F.array().cast("array<string>")))) > 0
    why = F.when(F.size("slots") < 2, "missing_required_slots").when(~F.coalesce("cited", F.lit(True)), "invalid_citation").when(missing, "missing_slot_evidence")
    return q.withColumn("why", why)


def _answers(q: DataFrame, answer: Column, unknown: str) -> DataFrame:
    why = F.coalesce("why", F.when(answer.isNull(), unknown))
    return q.select("question_id", why.isNull().alias("answerable"), F.when(why.isNull(), answer).alias("answer"), F.when(why.isNull(), F.col("citation_ids")).otherwise(F.array().cast("array<string>")).alias("citation_ids"), why.alias("why"))


def temporal(questions: DataFrame, evidence: DataFrame, contexts: DataFrame) -> DataFrame:
    """Evidence has ``date`` and, for claims, ``observed`` (same_claim or changed_claim).
    A slot has a date if all of its parsed dates are one. Yes where the observed relation of
    the first two slots is the one asked for."""
    q = _complete(questions, evidence, contexts)
    day = ev.evidence_date(F.col("date"))
    slots = evidence.groupBy("question_id", "slot_id").agg(F.when(F.count_distinct(day) == 1, F.max(day)).alias("day"), F.max("observed").alias("observed"))
    by = slots.groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("slot_id", "day"))).alias("days"), F.max("observed").alias("observed"))
    q = q.join(by, "question_id", "left")
    at = lambda i: F.try_element_at("days", F.get("slots", F.lit(i)))
    dated = ev.date_relation(at(0), at(1))
    claim = F.col("relation").isin("same_claim", "changed_claim")
    observed = F.when(claim, F.coalesce("observed", F.lit("unknown"))).otherwise(dated)
    return _answers(q, ev.yes_no(observed, F.col("relation")), "unknown")


def comparison(questions: DataFrame, evidence: DataFrame, contexts: DataFrame) -> DataFrame:
    """Evidence has ``supported`` (null: unknown); questions have ``claimed``, the model's verdict."""
    q = _complete(questions, evidence, contexts)
    s = evidence.groupBy("question_id").agg(F.collect_list(F.struct(F.col("supported").alias("s"))).alias("__s"))
    q = q.join(s, "question_id", "left").withColumn("__v", ev.verdict(F.transform(F.coalesce("__s", F.array().cast("array<struct<s:boolean>>")), lambda x: x["s"]), F.col("claimed")))
    return _answers(q, F.when(F.col("__v") == "yes", "Yes").when(F.col("__v") == "no", "No"), "inconsistent_or_unknown")
