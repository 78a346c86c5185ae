"""The entity graph as four tables: upserts, deletes, neighbours, bounded search, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import entity_key, word_set
from quillspark.shared import small, written


def upsert_entities(rows: DataFrame, name: str = "name", kind: str = "type", description: str = "description", seq: str = "seq") -> DataFrame:
    """One row for each key: the last name and type, the last description that isn't empty."""
    r = rows.withColumn("key", entity_key(F.col(name))).where("key <> ''")
    told = F.when(F.col(description) != "", F.col(description))
    return r.groupBy("key").agg(
        F.max_by(name, seq).alias("name"),
        F.max_by(kind, seq).alias("type"),
        F.coalesce(F.max_by(told, F.when(told.isNotNull(), F.col(seq))), F.lit("")).alias("description"),
    )


def relations(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """(head_key, predicate, tail_key, chunk_id): both ends known, each once, the highest confidence."""
    keys = entities.select("key")
    r = rows.withColumn("head_key", entity_key(F.col("head"))).withColumn("tail_key", entity_key(F.col("tail")))
    r = r.join(keys.withColumnRenamed("key", "head_key"), "head_key", "left_semi").join(keys.withColumnRenamed("key", "tail_key"), "tail_key", "left_semi")
    return r.groupBy("head_key", "predicate", "tail_key", "chunk_id").agg(F.max("confidence").alias("confidence"))


def delete_chunks(gone: DataFrame, entities: DataFrame, mentions: DataFrame, related: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, mentions and relations without the chunks in ``gone``; entities that
    nothing mentions or relates any more go too."""
    m, r = mentions.join(gone, "chunk_id", "left_anti"), related.join(gone, "chunk_id", "left_anti")
    live = m.select("key").unionByName(r.select(F.col("head_key").alias("key"))).unionByName(r.select(F.col("tail_key").alias("key"))).distinct()
    return entities.join(live, "key", "left_semi"), m, r


def undirected(related: DataFrame) -> DataFrame:
    cols = ["predicate", "confidence"]
    return related.select("head_key", "tail_key", *cols).unionByName(related.select(F.col("tail_key").alias("head_key"), F.col("head_key").alias("tail_key"), *cols))


def neighbours(frontier: DataFrame, related: DataFrame, visited: DataFrame, limit: int) -> DataFrame:
    """(question_id, key, confidence, predicates) one step away, not visited, the best ``limit``."""
    step = undirected(related).withColumnRenamed("head_key", "key")
    n = frontier.select("question_id", "key").join(step, "key").select("question_id", F.col("tail_key").alias("key"), "predicate", "confidence")
    n = n.join(visited, ["question_id", "key"], "left_anti")
    n = n.groupBy("question_id", "key").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.array_sort(F.collect_set("predicate")).alias("predicates"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("confidence").desc(), "key"))
    return n.withColumn("__r", rank).where(F.col("__r") <= limit).drop("__r")


def bounded_bfs(start: DataFrame, related: DataFrame, mentions: DataFrame, hops: int, limit: int, own: str | None = None) -> DataFrame:
    """Chunks within ``hops`` (3 at most) of the starting keys: (question_id, chunk_id, hops,
    entities, matched), the first depth wins, at most ``limit`` for each question; a level may
    spend what is left of the limit on chunks already found. ``own`` is a column of ``start``
    with the hops of each question, if they differ.

    Frontiers are kept for classes of questions, never for each: questions with the same keys
    search as one, and those whose first step leads to the same keys share all later frontiers
    and rankings. They differ there by their own starting keys only, which are taken from the
    class's lists. Questions whose first step was cut by the cap keep a class of their own, as
    a later step could lead back to what was cut. A question leaves when its limit is spent.
    A question's rows are made at the end of a level, at most ``limit`` for each.

    ``related`` and ``mentions`` (key, chunk_id, each pair once) are read once a level; hand
    them over written."""
    cap = max(20 * limit, 200)
    far = F.col(own) if own else F.lit(hops)
    asked = written(start.where("key is not null").groupBy("question_id").agg(F.array_sort(F.collect_set("key")).alias("__keys"), F.max(far).alias("__far")))
    leads = written(asked.groupBy("__keys", "__far").agg(F.min("question_id").alias("__q")))
    origin = leads.select("__q", F.explode("__keys").alias("key"))
    # Who still searches, for which class; a class's frontier; what a class has visited.
    who = leads.select("__q", F.col("__q").alias("__c"), "__far", F.lit(limit).cast("long").alias("__left"))
    base = seen = origin.withColumnRenamed("__q", "__c")
    levels, minus = [], None
    for depth in range(min(max(hops, 0), 3) + 1):
        ranked = _ranked(base, mentions, limit if minus is None else None)
        level = _level(who, ranked, minus, mentions, limit) if depth else ranked.withColumnRenamed("__c", "__q")
        level = level.select("__q", "chunk_id", "matched", "entities")
        if levels:
            new = small(ranked.select("chunk_id").distinct())
            found = written(reduce(DataFrame.unionByName, levels).select("__q", "chunk_id").join(new, "chunk_id", "left_semi"))
            level = level.join(small(found), ["__q", "chunk_id"], "left_anti")
        levels.append(written(level))
        if depth == min(hops, 3):
            break
        have = levels[-1].groupBy("__q").agg(F.count("*").alias("__have"))
        who = who.join(have, "__q", "left").withColumn("__left", F.col("__left") - F.coalesce("__have", F.lit(0))).drop("__have")
        who = written(who.where((F.col("__left") > 0) & (F.col("__far") > depth)))
        if who.isEmpty():
            break
        active = small(who.select("__c").distinct())
        base, seen = base.join(active, "__c", "left_semi"), seen.join(active, "__c", "left_semi")
        who, base, seen, minus = _step(depth, who, origin, _reached(base, related, seen), seen, cap)
        if base.isEmpty():
            break
    out = reduce(DataFrame.unionByName, [x.withColumn("hops", F.lit(d).cast("long")) for d, x in enumerate(levels)])
    if asked.count() == leads.count():
        out = out.withColumnRenamed("__q", "question_id")
    else:
        out = out.join(small(written(asked.join(leads, ["__keys", "__far"]).select("question_id", "__q"))), "__q")
    return out.select("question_id", "chunk_id", "entities", "matched", "hops")


def _ranked(base: DataFrame, mentions: DataFrame, most: int | None) -> DataFrame:
    """The chunks of each class's frontier, most keys first: (__c, chunk_id, matched, __r,
    entities), the first ``most`` of a class or all."""
    keys = small(base).join(mentions, "key")
    r = keys.groupBy("__c", "chunk_id").agg(F.count("*").alias("matched"), F.min("key").alias("__a"), F.max("key").alias("__b"))
    r = r.withColumn("__r", F.row_number().over(Window.partitionBy("__c").orderBy(F.col("matched").desc(), "chunk_id")))
    r = written(r if most is None else r.where(F.col("__r") <= most))
    one = F.when(F.col("matched") == 1, F.array("__a")).otherwise(F.array("__a", "__b"))
    out = r.withColumn("entities", one).drop("__a", "__b")
    wide = r.where("matched > 2").select("__c", "chunk_id")
    if wide.isEmpty():
        return out
    # Which entities chunks of more than two keys have is looked up for those that stay.
    wide = wide.join(mentions, "chunk_id").join(base, ["__c", "key"]).groupBy("__c", "chunk_id").agg(F.array_sort(F.collect_set("key")).alias("__keys"))
    return written(out.join(wide, ["__c", "chunk_id"], "left").withColumn("entities", F.coalesce("__keys", "entities")).drop("__keys"))


def _level(who: DataFrame, ranked: DataFrame, minus: DataFrame | None, mentions: DataFrame, limit: int) -> DataFrame:
    """Each question's first chunks of its class's ranking, as many as it has left.

    ``minus`` (__q, key) are keys of the class's frontier that the question has started from.
    The chunks that they mention count as the rest of the frontier mentions them: they take
    their places, but are left out, as the question has found them (it has some of its limit
    left, so level 0 found all chunks of its starting keys)."""
    if minus is None:
        return who.join(small(ranked), "__c").where("__r <= __left")
    lost = small(minus).join(mentions, "key").groupBy("__q", "chunk_id").agg(F.count("*").alias("__lost"))
    lost = lost.join(who, "__q").join(ranked.select("__c", "chunk_id", "matched", "__r"), ["__c", "chunk_id"])
    lost = written(lost.select("__q", "chunk_id", (F.col("matched") - F.col("__lost")).alias("matched"), "__r", "__left"))
    more = _further(lost, F.col("__left"))
    most = limit + (more.agg(F.max("__m")).first()[0] or 0)
    rows = who.join(more, "__q", "left").join(small(written(ranked.where(F.col("__r") <= most))), "__c")
    rows = rows.where(F.col("__r") <= F.col("__left") + F.coalesce("__m", F.lit(0))).join(lost.select("__q", "chunk_id"), ["__q", "chunk_id"], "left_anti")
    rows = rows.select("__q", "chunk_id", "matched", "entities", "__left", F.lit(True).alias("__new"))
    taken = lost.where("matched > 0").select("__q", "chunk_id", "matched", F.lit(None).cast("array<string>").alias("entities"), "__left", F.lit(False).alias("__new"))
    order = F.row_number().over(Window.partitionBy("__q").orderBy(F.col("matched").desc(), "chunk_id"))
    return rows.unionByName(taken).withColumn("__r", order).where("__r <= __left and __new")


def _further(out: DataFrame, first: Column) -> DataFrame:
    """(__q, __m): how many rows more than ``first`` of a ranking hold that many without the
    rows at the ranks ``__r`` of ``out``."""
    nth = F.row_number().over(Window.partitionBy("__q").orderBy("__r"))
    return out.withColumn("__m", F.col("__r") - nth < first).groupBy("__q").agg(F.count_if("__m").alias("__m"))


def _reached(base: DataFrame, related: DataFrame, seen: DataFrame) -> DataFrame:
    """(__c, key, __r): what is one step from each class's frontier and not visited, best first."""
    step = undirected(related).withColumnRenamed("head_key", "key")
    n = small(base).join(step, "key").select("__c", F.col("tail_key").alias("key"), "confidence")
    n = n.join(seen, ["__c", "key"], "left_anti").groupBy("__c", "key").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))
    return n.select("__c", "key", F.row_number().over(Window.partitionBy("__c").orderBy(F.col("confidence").desc(), "key")).alias("__r"))


def _step(depth: int, who: DataFrame, origin: DataFrame, reached: DataFrame, seen: DataFrame, cap: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """The next ``who``, ``base`` and ``seen``, and the starting keys among the frontiers (or None)."""
    if not depth:  # each question is a class still; equal frontiers (by 128 bits of their keys' hashes) make the next ones
        reached = written(reached.where(F.col("__r") <= cap + 1))
        kept = reached.where(F.col("__r") <= cap)
        kind = ["__n", "__h0", "__h1"]
        same = reached.groupBy(F.col("__c").alias("__q")).agg(F.max("__r").alias("__n"), *[F.bit_xor(F.xxhash64(F.lit(i), "key")).alias(f"__h{i}") for i in range(2)])
        same = written(who.drop("__c").join(same, "__q"))
        shared, alone = same.where(F.col("__n") <= cap), same.where(F.col("__n") > cap).withColumn("__c", F.col("__q"))
        lead = small(written(shared.groupBy(*kind).agg(F.min("__q").alias("__c"))))
        who = written(shared.join(lead, kind).unionByName(alone).drop(*kind))
        base = written(kept.join(small(who.select("__c").distinct()), "__c", "left_semi").select("__c", "key"))
        return who, base, base.unionByName(seen.join(alone.select("__c"), "__c", "left_semi")), None
    most = origin.groupBy("__q").count().agg(F.max("count")).first()[0]
    reached = written(reached.where(F.col("__r") <= cap + most))
    sizes = reached.groupBy("__c").agg(F.max("__r").alias("__n"))
    starts = written(origin.join(who.select("__q", "__c"), "__q").join(reached, ["__c", "key"]).select("__q", "__c", "key", "__r"))
    far = who.join(sizes, "__c").join(_further(starts, F.lit(cap)), "__q", "left")
    far = written(far.withColumn("__p", F.least(F.col("__n"), cap + F.coalesce("__m", F.lit(0)))))
    lead = small(written(far.groupBy("__c", "__p").agg(F.min("__q").alias("__to"))))
    base = written(lead.join(reached, "__c").where("__r <= __p").select(F.col("__to").alias("__c"), "key"))
    seen = base.unionByName(lead.join(seen, "__c").select(F.col("__to").alias("__c"), "key"))
    starts = starts.join(far.select("__q", "__p"), "__q").where("__r <= __p").select("__q", "key")
    who = far.join(lead, ["__c", "__p"]).select("__q", F.col("__to").alias("__c"), "__far", "__left")
    return written(who), base, seen, None if starts.isEmpty() else starts


def graph_score(hits: DataFrame, query: str, content: str) -> DataFrame:
    """Adds score: clip(0.5 + 0.1 matched - 0.1 hops) weighted 0.7, and the share of query words (over two letters) found, 0.3."""
    asked = F.filter(word_set(F.col(query)), lambda x: F.length(x) > 2)
    share = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, word_set(F.concat_ws(" ", content, F.array_join("entities", " "))))) / F.size(asked)).otherwise(0.0)
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + F.greatest(F.col("matched"), F.lit(1)) * 0.1 - F.col("hops") * 0.1))
    return hits.withColumn("relevance", F.round(share, 6)).withColumn("score", F.round(F.least(F.lit(1.0), base * 0.7 + share * 0.3), 6))


def keyword_entities(entities: DataFrame, keyword: str, limit: int) -> DataFrame:
    low = keyword.lower()
    return entities.where(F.contains(F.lower("name"), F.lit(low)) | F.contains(F.lower("description"), F.lit(low))).orderBy("key").limit(limit)
