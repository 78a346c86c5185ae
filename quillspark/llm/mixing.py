"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled (by a hash of doc_id and text). A document gets a
virtual finish time: the words of its source up to and with it, over the source's target.
A source goes round ROUNDS times at most, each round one copy of each document. The copies
of all sources are range-sorted through all partitions by finish time, their words are
summed in that order, and the queue is truncated where the sum would pass the budget, the
words of the whole corpus. The last copy taken is one tuple; whether a copy is taken is a
comparison with it, so no copy is joined back to its document. Documents are taken whole:
each source ends within about one document of its target.

Which copies are sorted at all is decided by a histogram of finish times: copies that
finish after the bin in which the budget is spent can't be taken.

Targets: the sources in order of their code points, null last, weigh 1, 2, 3 and again,
and share all words; a target stops at ROUNDS times its source's size, and the excess is
shared by weight among the others until none is above.

Defined results: a null or empty text has size 0 and is never taken; rows that repeat
queue one by one; an empty table gives an empty table; a corpus without a word has
targets of 0. The table of sources (one row for each) is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.ordering import in_order, key_of, running
from quillspark.llm.quality import GAPS
from quillspark.shared import cut, shuffle_partitions, small, text_or_empty

WEIGHTS = (1, 2, 3)
ROUNDS = 3
SEED = 17
#: Bins of the histogram for one unit of virtual time.
BINS = 64


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, GAPS, -1), "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, rounds: int = ROUNDS) -> DataFrame:
    """From (source, source_size): place in the order of names, and target of each source.

    With sources in order of rounds * size / weight, those before some place are full and
    the rest share what is left by weight; the first place at which the next source isn't
    above its limit is the right one.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights)).cast("int") + 1).cast("double")
    s = s.withColumn("weight", weight).withColumn("limit", (F.col("source_size") * rounds).cast("double"))
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("place"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest_of = fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.select(
        "*",
        F.row_number().over(fill).alias("turn"),
        (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))).alias("left"),
        F.sum("weight").over(rest_of).alias("open"),
    )
    fits = F.col("left") * F.col("weight") <= F.col("limit") * F.col("open")
    first = F.min(F.when(fits, F.struct("turn", "left", "open"))).over(everything)
    s = s.withColumn("first", first)
    level = F.col("first.left") * F.col("weight") / F.col("first.open")
    return s.select("source", "place", "source_size", F.least(F.col("limit"), level).alias("target"))


def _same(df: DataFrame, doc_id: str, text: str, source: str) -> Column:
    """A key that only rows with the same id, source and text share."""
    t = text_or_empty(text)
    return key_of(F.col(doc_id), F.col(source), F.octet_length(t), F.crc32(t.cast("binary")), F.xxhash64(t))


def _truncated(copies: DataFrame, budget: int) -> tuple | None:
    """The last (finish, place, round, upto) that the budget takes: copies (finish, place, round,
    upto, size) are range-sorted, their words summed, and the sum cut at the budget."""
    bins = copies.groupBy(F.floor(F.col("finish") * BINS).alias("bin")).agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.orderBy("bin"))  # a bin is one row: rounds * BINS of them, about
    spent = bins.withColumn("upto", upto).where(F.col("upto") > budget).agg(F.min("bin")).first()[0]
    order = [F.col(c) for c in ("finish", "place", "round", "upto")]
    queue = in_order(copies if spent is None else copies.where(F.floor(F.col("finish") * BINS) <= spent), order, F.col("size"))
    parts = queue.groupBy("__part").agg(F.sum("size").alias("words"), F.max(F.struct(*order)).alias("last"))
    done = F.sum("words").over(Window.orderBy("__part"))  # one row for each partition
    parts = cut(parts.withColumn("done", done))
    whole = parts.where(F.col("done") <= budget).agg(F.max_by("last", "__part").alias("last"), F.max("done").alias("done")).first()
    crossed = parts.where(F.col("done") > budget).agg(F.min("__part")).first()[0]
    if crossed is not None:
        room = budget - (whole["done"] or 0)
        last = queue.where((F.col("__part") == crossed) & (F.col("__run") + F.col("size") <= room)).agg(F.max(F.struct(*order)).alias("last")).first()["last"]
        if last is not None:
            return tuple(last)
    return tuple(whole["last"]) if whole["last"] is not None else None


def schedule(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, and ``copies``: the round and the
    virtual finish time of each time that the mix takes it."""
    t = text_or_empty(text)
    slim = df.select(
        F.col(doc_id).alias("__doc_id"),
        F.col(source).cast("string").alias("__source"),
        n_words(t).alias("__size"),
        _same(df, doc_id, text, source).alias("__same"),
        key_of(F.col(doc_id), F.md5(t.cast("binary")), seed=seed).alias("__key"),
    )
    slim = cut(slim)  # texts are split once
    sizes = slim.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"))
    goal = cut(targets(sizes, weights, rounds).withColumnRenamed("source", "__s"))
    placed = running(slim, "__source", ["__key"], "__ahead", F.col("__size"))
    placed = cut(placed.join(small(goal), F.col("__source").eqNullSafe(F.col("__s")), "left"))

    def copy(i: Column) -> Column:
        upto = i * F.col("source_size") + F.col("__ahead") + F.col("__size")
        return F.struct((upto / F.nullif("target", F.lit(0.0))).alias("finish"), F.col("place").alias("place"), i.alias("round"), upto.alias("upto"))

    every = F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), copy)
    copies = placed.where("__size > 0").select(F.explode(every).alias("c"), F.col("__size").alias("size")).select("c.*", "size")
    last = _truncated(copies, goal.agg(F.sum("source_size")).first()[0] or 0)
    kind = "array<struct<finish:double,place:int,round:int,upto:bigint>>"
    if last is None:
        taken = F.array().cast(kind)
    else:
        cut_at = F.struct(F.lit(last[0]).cast("double").alias("finish"), F.lit(last[1]).cast("int").alias("place"), F.lit(last[2]).cast("int").alias("round"), F.lit(last[3]).cast("bigint").alias("upto"))
        taken = F.when(F.col("__size") > 0, F.filter(every, lambda c: c <= cut_at)).otherwise(F.array().cast(kind))
    return placed.select(F.col("__doc_id").alias("doc_id"), F.col("__source").alias("source"), F.col("__size").alias("size"), "source_size", "target", taken.alias("copies"), F.col("__same").alias("same"))


def taken(scheduled: DataFrame) -> DataFrame:
    """The digest of a schedule: doc_id, size, source_size, target, taken."""
    return scheduled.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).cast("long").alias("taken"))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mixed corpus: the rows of ``df``, whole, as often as they are taken, sorted through
    all partitions by virtual finish time."""
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), _same(df, doc_id, text, source).alias("same"))
    plan = cut(schedule(df, doc_id, text, source, **how).select("same", "copies"))
    repeated = cut(plan.groupBy("same").count().where("count > 1").select("same"))
    if repeated.isEmpty():
        out = row.join(plan.where(F.size("copies") > 0), "same")
    else:
        # Rows that are the same are numbered, so that each meets a schedule of its own.
        repeated = small(repeated)
        numbered = lambda x: running(cut(x.join(repeated, "same", "left_semi")), "same", [], "__nth")
        single = row.join(plan.join(repeated, "same", "left_anti").where(F.size("copies") > 0), "same")
        several = numbered(row).join(numbered(plan).where(F.size("copies") > 0), ["same", "__nth"]).drop("__nth")
        out = single.unionByName(several)
    out = out.select("__row", F.explode("copies").alias("__copy"))
    # Virtual time is even in words, so its equal parts are even partitions; no sampling is needed.
    parts = shuffle_partitions(df.sparkSession)
    out = out.withColumn("__part", F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(F.col("__copy.finish") * parts).cast("int"))))
    return out.repartitionById(parts, "__part").sortWithinPartitions("__copy").select("__row.*")
