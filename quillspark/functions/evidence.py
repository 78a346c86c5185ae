"""Evidence logic: dates, relations, verdicts, citations, routes; and the rule planner."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def evidence_date(c: Column) -> Column:
    """``YYYY``, ``YYYY-M`` or ``YYYY-M-D`` (or with slashes); missing parts are 1, invalid is null."""
    shape = r"^\s*([0-9]{4})(?:[-/]([0-9]{1,2})(?:[-/]([0-9]{1,2}))?)?\s*$"
    part = lambda i: F.lpad(F.coalesce(F.nullif(F.regexp_extract(c, shape, i), F.lit("")), F.lit("1")), 2, "0")
    return F.when(c.rlike(shape), F.try_to_date(F.concat_ws("-", F.regexp_extract(c, shape, 1), part(2), part(3)), "yyyy-MM-dd"))


def date_relation(left: Column, right: Column) -> Column:
    return F.when(left.isNull() | right.isNull(), "unknown").when(left < right, "before").when(left > right, "after").otherwise("same_time")


def yes_no(observed: Column, target: Column) -> Column:
    return F.when(observed == "unknown", F.lit(None).cast("string")).when(observed == target, "Yes").otherwise("No")


def verdict(supported: Column, claimed: Column) -> Column:
    """yes needs every slot supported; an unknown slot, or a yes without support, abstains; no stands."""
    unknown = F.exists(supported, lambda x: x.isNull()) | (F.size(supported) == 0)
    every = F.forall(supported, lambda x: F.coalesce(x, F.lit(False)))
    return F.when(unknown, "abstain").when(claimed == "yes", F.when(every, "yes").otherwise("abstain")).when(claimed == "no", "no").otherwise("abstain")


def valid_citations(cited: Column, retrieved: Column) -> Column:
    """Cited ids that were retrieved, each once, in the order cited."""
    return F.array_distinct(F.filter(cited, lambda x: F.array_contains(retrieved, x)))


def gate(answerable: Column, cited: Column) -> Column:
    return answerable & (F.size(cited) > 0)


def hops(intent: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in HOPS.items() for x in kv])[intent], F.lit(1))


def known_intent(intent: Column) -> Column:
    """An intent's label; those that aren't known are factoid."""
    low = F.lower(F.trim(intent))
    return F.when(low.isin(*HOPS), low).otherwise("factoid")


def wants_comparison(answer_type: Column, required: Column, relation: Column) -> Column:
    """A claim about two sources and more that isn't about the order of their dates."""
    return (answer_type == "boolean") & (required >= 2) & ~relation.isin("before", "after", "same_time")


def graph_weight(found: Column, intent: Column, entities: Column, configured: float = 0.85) -> Column:
    weak = (found == 0) | (entities == 0)
    strong = intent.isin("comparative", "temporal", "analytical") & (entities >= 2)
    return F.when(weak, 0.35).when(strong, 1.0).otherwise(configured)


def route(found: Column, answer_type: Column, required: Column, relation: Column, calculation: Column) -> Column:
    """Where a question's ``found`` contexts go; ``required`` counts its slots."""
    return (
        F.when(found == 0, "abstain")
        .when(wants_comparison(answer_type, required, relation), "comparison")
        .when(relation != "none", "temporal")
        .when(calculation, "calculator")
        .otherwise("answer")
    )


# Hops of the graph search by intent.
HOPS = {"factoid": 1, "procedural": 1, "analytical": 2, "comparative": 2, "temporal": 2, "exploratory": 3}

# Marker texts of the rule planner, in their order of evaluation.
TEMPORAL = ("between", "before", "after", "changed", "change", "consistent", "inconsistent", "remained", "subsequent", "一致", "变化", "之前", "之后")
BOOLEAN = ("is ", "was ", "are ", "were ", "did ", "does ", "has ", "have ")
RELATIONS = (
    ("same_claim", ("not inconsistent", "没有不一致")),
    ("changed_claim", ("not consistent", "并非一致")),
    ("before", ("before", "之前")),
    ("after", ("after", "之后")),
    ("same_time", ("same time", "simultaneous", "同时")),
    ("same_claim", ("consistent", "no change", "remained", "same", "一致", "没有变化")),
)


def _any(c: Column, markers: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(m)) for m in markers])


def fallback_plan(question: Column) -> Column:
    """intent, answer_type, target_relation, queries and slot ids of a question, by rules alone."""
    low = F.lower(question)
    temporal = _any(low, TEMPORAL)
    boolean = reduce(lambda a, b: a | b, [F.startswith(low, F.lit(m)) for m in BOOLEAN]) | F.contains(low, F.lit("是否"))
    relation = reduce(lambda out, r: out.when(_any(low, r[1]), r[0]), RELATIONS[1:], F.when(_any(low, RELATIONS[0][1]), RELATIONS[0][0])).otherwise("changed_claim")
    two = F.array(F.concat(question, F.lit(" first source")), F.concat(question, F.lit(" second source")))
    return F.struct(
        F.when(temporal, "temporal").otherwise("factoid").alias("intent"),
        F.when(temporal | boolean, "boolean").otherwise("text").alias("answer_type"),
        F.when(temporal, relation).otherwise("none").alias("target_relation"),
        F.when(temporal, two).otherwise(F.array(question)).alias("queries"),
        F.when(temporal, F.array(F.lit("left"), F.lit("right"))).otherwise(F.array(F.lit("evidence_1"))).alias("slots"),
    )


def normal_plan(queries: Column, entities: Column) -> tuple[Column, Column, Column]:
    """Trimmed, blank-free queries (3 at most), distinct entities (10 at most) and slot ids."""
    clean = lambda a: F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != "")
    q = F.slice(clean(queries), 1, 3)
    return q, F.slice(F.array_distinct(clean(entities)), 1, 10), F.transform(q, lambda x, i: F.concat(F.lit("evidence_"), (i + 1).cast("string")))
