"""The engine: ingest documents, answer questions, apply changes, over stored tables.

Each call is one batch job over all of its documents or questions. Tables are the catalog,
chunks, the lexical index (postings), vectors, the graph (entities, mentions, relations and
the chunks it has taken in) and the event ledger. They stand in buckets by document, so a
change rewrites only the buckets of the documents that it touches.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark import models
from quillspark.functions import evidence as ev
from quillspark.functions import text as T
from quillspark.operators import answering, cdc, chunking, diff, fusion, graph, lexical, vectors, windows
from quillspark.settings import DEFAULTS as S
from quillspark.shared import cut, together
from quillspark.sources import documents as sources
from quillspark.sources.store import BUCKETS, Store, append_new

SCHEMAS = {
    "documents": "doc_id string, file_path string, content_hash string, version long, status string, error string, created_at double, updated_at double",
    "chunks": "doc_id string, chunk_id string, unit_id string, ordinal long, content string, content_hash string, kind string, token_start long, token_end long, parent_id string, parent_content string",
    "postings": "doc_id string, chunk_id string, term string, tf long, len long",
    "vectors": "doc_id string, chunk_id string, embedding array<float>, modality string",
    "graph_chunks": "doc_id string, chunk_id string",
    "entities": "key string, name string, type string, description string",
    "mentions": "doc_id string, key string, chunk_id string",
    "relations": "doc_id string, head_key string, predicate string, tail_key string, chunk_id string, confidence double",
    "events": "event_id string, operation string, doc_id string, file_path string, observed_hash string, status string, attempts long, error string, created_at double, updated_at double",
    "migrated": "doc_id string, chunk_id string, embedding array<float>, modality string",
}
BY_DOCUMENT = ("chunks", "postings", "vectors", "graph_chunks", "mentions", "relations", "migrated")
NO_IDS = "array<string>"


def doc_id_of(path: Column) -> Column:
    return F.left(F.sha2(path, 256), F.lit(32))


class Engine:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.store = spark, Store(spark, root, SCHEMAS, buckets=buckets)

    def _read(self, *names: str) -> list[DataFrame]:
        return [self.store.read(n) for n in names]

    # -- documents ---------------------------------------------------------------------

    def ingest(self, source: str | DataFrame, now: float = 0.0, force: bool = False) -> DataFrame:
        """Files of a folder, or of a table (path, content[, doc_id]): parsed, cut into chunks, and
        only what changed embedded and extracted. A document that fails keeps what it had.
        Returns doc_id, status, error, added, deleted, unchanged."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source) if isinstance(source, str) else source
        given = F.nullif("doc_id", F.lit("")) if "doc_id" in files.columns else F.lit(None).cast("string")
        files = files.select("path", "content", F.coalesce(given, doc_id_of(F.col("path"))).alias("doc_id"), F.sha2("content", 256).alias("content_hash"))
        catalog = self.store.read("documents")
        same = catalog.where("status = 'READY'").select("doc_id", "content_hash")
        todo = files if force else files.join(same, ["doc_id", "content_hash"], "left_anti")
        touched = cut(todo.select("doc_id", F.col("path").alias("file_path"), "content_hash"))
        units = cut(sources.units(todo).join(touched.select(F.col("file_path").alias("path"), "doc_id"), "path"))
        failed = units.where("error is not null").select("doc_id", "error").dropDuplicates(["doc_id"])
        good = units.where("error is null").join(failed, "doc_id", "left_anti")
        new = chunking.chunk(good.select("doc_id", "unit_id", "unit_seq", "content"), seq="unit_seq")
        kinds = good.groupBy("doc_id", "unit_id").agg(F.first("kind").alias("kind"))
        new = cut(new.join(kinds, ["doc_id", "unit_id"], "left"))
        done = cut(good.select("doc_id").distinct())
        before = cut(self.store.read("chunks").join(done, "doc_id", "left_semi"))
        counts = diff.diff_counts(diff.chunk_diff(before.limit(0) if force else before, new))
        version = catalog.select("doc_id", F.col("version").alias("old_version"), F.col("created_at").alias("old_created"))
        rows = touched.join(version, "doc_id", "left").join(failed, "doc_id", "left").select(
            "doc_id", "file_path", "content_hash", (F.coalesce("old_version", F.lit(0)) + 1).alias("version"),
            F.when(F.col("error").isNull(), "READY").otherwise("FAILED").alias("status"), F.left("error", F.lit(S.error_chars)).alias("error"),
            F.coalesce("old_created", F.lit(now)).alias("created_at"), F.lit(now).alias("updated_at"),
        )
        rows, counts = cut(rows), cut(counts)
        if not rows.isEmpty():
            self._replace_chunks(done, new, before, force)
            self.store.replace("documents", rows.select("doc_id"), rows)  # the commit: last
        out = files.select("doc_id").distinct().join(rows.select("doc_id", "status", "error"), "doc_id", "left").join(counts, "doc_id", "left")
        zero = {c: 0 for c in ("added", "deleted", "unchanged")}
        return cut(out.withColumn("status", F.coalesce("status", F.lit("UNCHANGED"))).fillna(zero))

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        modality = F.coalesce(F.nullif("kind", F.lit("")), F.lit("text"))
        text = T.embedding_text(F.col("content"), {"section": F.col("unit_id")})
        return chunks.select("doc_id", "chunk_id", models.embedding_udf()(text).alias("embedding"), modality.alias("modality"))

    def _extracted(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(entities, relations) of chunks, with their chunk and document."""
        found = cut(chunks.select("doc_id", "chunk_id", models.extraction_udf()("content").alias("x")))
        named = found.select("doc_id", "chunk_id", F.explode("x.entities").alias("e")).select("doc_id", "chunk_id", "e.*")
        return named, found.select("doc_id", "chunk_id", F.explode("x.relations").alias("r")).select("doc_id", "chunk_id", "r.*")

    def _graph_rows(self, named: DataFrame, told: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Entities with those that are new, and the new mentions and relations."""
        old = self.store.read("entities").select("name", "type", "description", F.lit("").alias("seq"))
        known = cut(graph.upsert_entities(old.unionByName(named.select("name", "type", "description", F.col("chunk_id").alias("seq")))))
        where = told.select("chunk_id", "doc_id").distinct()
        related = graph.relations(told, known).join(where, "chunk_id")
        return known, named.select("doc_id", T.entity_key(F.col("name")).alias("key"), "chunk_id").where("key <> ''").distinct(), related

    def _replace_chunks(self, done: DataFrame, new: DataFrame, before: DataFrame, force: bool) -> None:
        """Tables of the documents in ``done``: what stays is carried over, what is new is made."""
        stay = before.limit(0).select("chunk_id") if force else before.select("chunk_id").join(new.select("chunk_id"), "chunk_id", "left_semi")
        stay = cut(stay)
        added = cut(new.join(stay, "chunk_id", "left_anti"))
        theirs = {n: self.store.read(n).join(done, "doc_id", "left_semi").join(stay, "chunk_id", "left_semi") for n in BY_DOCUMENT if n not in ("chunks", "migrated")}
        known, told, related = self._graph_rows(*self._extracted(added))
        counts = lexical.postings(added, "chunk_id", "content").withColumnRenamed("doc_id", "chunk_id").join(added.select("doc_id", "chunk_id"), "chunk_id")
        more = {"vectors": self._embedded(added), "postings": counts, "graph_chunks": added.select("doc_id", "chunk_id"), "mentions": told, "relations": related}
        together([lambda n=n, r=r: self.store.replace(n, done, cut(theirs[n].unionByName(r.select(*theirs[n].columns)))) for n, r in more.items()])
        self._orphans(known)
        self.store.replace("chunks", done, new)

    def _orphans(self, entities: DataFrame) -> None:
        """Keeps of ``entities`` what a mention or a relation still names."""
        mentions, related = self._read("mentions", "relations")
        gone = self.spark.createDataFrame([], "chunk_id string")
        self.store.write("entities", cut(graph.delete_chunks(gone, entities, mentions, related)[0]))

    def documents(self, failed: bool = False) -> DataFrame:
        d = self.store.read("documents")
        return (d if failed else d.where("status = 'READY'")).orderBy("created_at", "doc_id")

    def delete_documents(self, ids: DataFrame) -> None:
        """Removes documents (doc_id) from all tables."""
        ids = cut(ids.select("doc_id").distinct())
        together([lambda n=n: self.store.replace(n, ids) for n in (*BY_DOCUMENT, "documents")])
        self._orphans(cut(self.store.read("entities")))

    def inconsistent(self) -> DataFrame:
        """Chunks that the catalog, the vectors and the graph don't all have."""
        return diff.inconsistent(*self._read("chunks", "vectors", "graph_chunks"))

    def repair(self) -> int:
        """Makes again what vectors or graph have lost, drops what the catalog doesn't have;
        returns the number of such chunks. Only the buckets of their documents are written."""
        bad = cut(self.inconsistent())
        n = bad.count()
        if not n:
            return 0
        chunks, vecs, taken = self._read("chunks", "vectors", "graph_chunks")
        everywhere = chunks.select("doc_id", "chunk_id").unionByName(vecs.select("doc_id", "chunk_id")).unionByName(taken)
        ids = cut(everywhere.join(bad, "chunk_id", "left_semi").select("doc_id").distinct())
        mine = cut(chunks.join(ids, "doc_id", "left_semi"))
        lost = lambda leg: mine.join(bad.where(f"in_catalog and not {leg}"), "chunk_id", "left_semi")
        known, told, related = self._graph_rows(*self._extracted(lost("in_graph")))
        more = {"vectors": self._embedded(lost("in_vectors")), "graph_chunks": lost("in_graph").select("doc_id", "chunk_id"), "mentions": told, "relations": related}

        def mend(name: str, rows: DataFrame) -> None:
            kept = self.store.read(name).join(ids, "doc_id", "left_semi").join(mine.select("chunk_id"), "chunk_id", "left_semi")
            kept = kept.select(*rows.columns).unionByName(rows).dropDuplicates([c for c in rows.columns if c not in ("embedding", "confidence")])
            self.store.replace(name, ids, cut(kept))

        together([lambda n=n, r=r: mend(n, r) for n, r in more.items()])
        self._orphans(known)
        return n

    def rebuild(self, ids: DataFrame, files: DataFrame, now: float = 0.0) -> DataFrame:
        """Documents (doc_id) made anew from ``files`` (path, content), whether they changed or not."""
        paths = self.store.read("documents").join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("file_path").alias("path"))
        return self.ingest(files.select("path", "content").join(paths, "path"), now, force=True)

    def migrate(self, model: str = "vl_embedding") -> DataFrame:
        """Embeds with another model, into the table ``migrated``, the chunks that aren't there yet;
        so it goes on where it was broken off. (doc_id, missing, migrated), a document that the
        model fails on with a null."""
        chunks, there = self._read("chunks", "migrated")
        todo = cut(chunks.join(there.select("chunk_id"), "chunk_id", "left_anti"))
        if todo.isEmpty():
            return self.spark.createDataFrame([], "doc_id string, missing long, migrated long")
        made = cut(todo.select("doc_id", "chunk_id", models.safe_embedding_udf(model)("content").alias("embedding"), F.coalesce("kind", F.lit("text")).alias("modality")))
        bad = made.where("embedding is null").select("doc_id").distinct()
        good = cut(made.join(bad, "doc_id", "left_anti"))
        self.store.replace("migrated", good.select("doc_id").limit(0), good)
        counts = todo.groupBy("doc_id").agg(F.count("*").alias("missing"))
        return cut(counts.join(good.groupBy("doc_id").agg(F.count("*").alias("migrated")), "doc_id", "left"))

    def stats(self) -> DataFrame:
        one = lambda n: self.store.read(n).agg(F.lit(n).alias("table"), F.count("*").alias("rows"))
        out = one("documents")
        for n in ("chunks", "vectors", "entities", "mentions", "relations", "events"):
            out = out.unionByName(one(n))
        return out

    # -- questions ---------------------------------------------------------------------

    def _planned(self, questions: DataFrame) -> DataFrame:
        """(question_id, question, document_ids, plan, entities): planned by the model, if there is
        one, and by rules where it fails or names nothing known."""
        ids = F.col("document_ids") if "document_ids" in questions.columns else F.lit(None).cast(NO_IDS)
        q = questions.select("question_id", "question", ids.alias("document_ids"), ev.fallback_plan(F.col("question")).alias("rule"))
        if "planner" not in models.names():
            return cut(q.select("question_id", "question", "document_ids", F.struct("rule.*", F.lit(False).alias("needs_calculation")).alias("plan"), F.array().cast(NO_IDS).alias("entities")))
        q = cut(q.withColumn("said", models.planner_udf()("question")))
        queries, entities, slots = ev.normal_plan(F.coalesce("said.queries", F.array().cast(NO_IDS)), F.coalesce("said.entities", F.array().cast(NO_IDS)))
        use = F.col("said.intent").isNotNull() & (F.size(queries) > 0)
        made = F.struct(
            ev.known_intent(F.col("said.intent")).alias("intent"), F.coalesce("said.answer_type", F.lit("text")).alias("answer_type"), F.coalesce("said.target_relation", F.lit("none")).alias("target_relation"),
            queries.alias("queries"), slots.alias("slots"), F.coalesce("said.needs_calculation", F.lit(False)).alias("needs_calculation"),
        )
        rule = F.struct("rule.*", F.lit(False).alias("needs_calculation"))
        return cut(q.select("question_id", "question", "document_ids", F.when(use, made).otherwise(rule).alias("plan"), F.when(use, entities).otherwise(F.array().cast(NO_IDS)).alias("entities")))

    def retrieve(self, questions: DataFrame, top_k: int = S.top_k, mode: str = "hybrid", depth: int | None = None) -> DataFrame:
        """For (question_id, question[, document_ids]): ranked chunks with scores and sources.

        ``mode``: vector (dense and lexical), graph, or hybrid. Candidates are fused, reranked
        with their windows, the best documents searched once more, and reranked by chunk."""
        depth = depth or max(S.candidate_depth, 4 * top_k)
        q = self._planned(questions)
        sub = q.select("question_id", "document_ids", F.posexplode("plan.queries").alias("n", "query"), F.col("plan.slots").alias("slots"))
        sub = cut(sub.select("question_id", "document_ids", "query", F.coalesce(F.get("slots", F.col("n")), F.concat(F.lit("query_"), F.col("n").cast("string"))).alias("slot"), F.concat_ws("#", F.col("question_id").cast("string"), F.col("n").cast("string")).alias("sub")))
        found = []
        if mode != "graph":
            hits_of = together([lambda: self._dense(sub, depth), lambda: self._lexical(sub, depth)])
            for name, hits in zip(("vector", "lexical"), hits_of, strict=True):
                found.append(fusion.merge_queries(hits, "question_id", "sub", "chunk_id", "rank", "slot").select("question_id", "chunk_id", "score", F.lit(name).alias("source"), F.lit(None).cast("double").alias("weight")))
        if mode != "vector":
            found.append(self._graph(q, depth))
        both = found[0]
        for f in found[1:]:
            both = both.unionByName(f)
        weights = {"vector": S.vector_weight, "lexical": S.lexical_weight, "graph": S.graph_weight}
        fused = cut(fusion.fuse_sources(both, "question_id", "chunk_id", "source", "score", weights, "weight").where(F.col("rank") <= depth))
        ranked = self._reranked(self._with_windows(fused, q))
        if mode != "graph":
            ranked = self._refined(ranked, fused, sub, q)
        return self._packed(ranked, top_k)

    @staticmethod
    def _permitted(hits: DataFrame, sub: DataFrame) -> DataFrame:
        j = hits.join(sub, "sub").where("document_ids is null or size(document_ids) = 0 or array_contains(document_ids, doc_id)")
        return j.drop("document_ids")

    def _ready(self, table: DataFrame) -> DataFrame:
        return table.join(self.store.read("documents").where("status = 'READY'").select("doc_id"), "doc_id", "left_semi")

    def _dense(self, sub: DataFrame, depth: int) -> DataFrame:
        """The nearest chunks of each sub-query, by modality and then of all. Questions that name
        documents are scored against the vectors of these alone."""
        asked = cut(sub.select("sub", "question_id", "document_ids", models.embedding_udf()("query").alias("vector")))
        vecs = self._ready(self.store.read("vectors"))
        free = asked.where("document_ids is null or size(document_ids) = 0").select(F.col("sub").alias("question_id"), "vector")
        bound = asked.where("size(document_ids) > 0")
        hits = vectors.nearest(vecs, free, max(2 * depth, 10), "chunk_id", by="modality").select(F.col("question_id").alias("sub"), "chunk_id", F.col("similarity").alias("s"))
        if not bound.isEmpty():
            some = bound.select("sub", "vector", F.explode(F.array_distinct("document_ids")).alias("doc_id")).join(vecs, "doc_id")
            hits = hits.unionByName(some.select("sub", "chunk_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), vectors.cosine(F.col("embedding"), F.col("vector")))), 6).alias("s")))
        return lexical.top(hits.join(sub.drop("document_ids"), "sub"), "sub", [F.col("s").desc(), F.col("chunk_id")], depth)

    def _lexical(self, sub: DataFrame, depth: int) -> DataFrame:
        """BM25 from the stored postings; filters apply to matches, not to the statistics."""
        post = self._ready(self.store.read("postings"))
        sizes = post.groupBy("chunk_id").agg(F.max("len").alias("len"))
        where = self.store.read("chunks").select("chunk_id", "doc_id")
        hits = lexical.bm25_stored(post.select("term", F.col("chunk_id").alias("doc_id"), "tf", "len"), sizes, sub, "sub", "query")
        hits = hits.select(F.col("question_id").alias("sub"), F.col("doc_id").alias("chunk_id"), F.col("bm25").alias("s")).join(where, "chunk_id")
        return lexical.top(self._permitted(hits, sub), "sub", [F.col("s").desc(), F.col("chunk_id")], depth)

    def _graph(self, q: DataFrame, depth: int) -> DataFrame:
        """Chunks near the named entities; hops and weight follow the question's intent and what was found."""
        entities, relations, mentions, chunks = self._read("entities", "relations", "mentions", "chunks")
        told = q.select("question_id", F.explode(F.transform("entities", lambda e: F.lower(F.trim(e)))).alias("key")).join(entities.select("key"), "key", "left_semi")
        words = q.where(F.size("entities") == 0).select("question_id", F.explode(T.word_set(F.col("question"))).alias("word"))
        named = entities.select("key", F.explode(F.split("key", " ")).alias("word")).where("length(word) > 2")
        start = cut(told.select("question_id", "key").unionByName(words.join(named, "word").select("question_id", "key")).distinct())
        far = q.select("question_id", ev.hops(F.col("plan.intent")).alias("far"))
        hits = graph.bounded_bfs(start.join(far, "question_id"), relations, mentions.select("key", "chunk_id").distinct(), 3, depth, own="far")
        hits = hits.join(self._ready(chunks).select("chunk_id", "doc_id", "content"), "chunk_id").join(q.select("question_id", "question", "document_ids"), "question_id")
        hits = cut(hits.where("document_ids is null or size(document_ids) = 0 or array_contains(document_ids, doc_id)"))
        n_named = start.groupBy("question_id").agg(F.count("*").alias("named"))
        n_found = hits.groupBy("question_id").agg(F.count("*").alias("found"))
        weight = q.join(n_named, "question_id", "left").join(n_found, "question_id", "left").fillna(0, ["named", "found"])
        weight = weight.select("question_id", ev.graph_weight(F.col("found"), F.col("plan.intent"), F.col("named"), S.graph_weight).alias("weight"))
        return graph.graph_score(hits, "question", "content").join(weight, "question_id").select("question_id", "chunk_id", "score", F.lit("graph").alias("source"), "weight")

    def _with_windows(self, found: DataFrame, q: DataFrame) -> DataFrame:
        """Adds texts and context windows: only documents of the candidates are read for them."""
        some = cut(found.select("chunk_id").distinct())
        chunks = self.store.read("chunks")
        docs = chunks.join(some, "chunk_id", "left_semi").select("doc_id").distinct()
        theirs = windows.context_windows(chunks.join(docs, "doc_id", "left_semi"), "doc_id", "ordinal", "content", S.window_neighbours, S.window_chars, "unit_id", "parent_content")
        theirs = theirs.join(some, "chunk_id", "left_semi").select("chunk_id", "doc_id", "content", "window")
        return cut(found.join(theirs, "chunk_id").join(q.select("question_id", "question", "plan"), "question_id"))

    def _reranked(self, found: DataFrame) -> DataFrame:
        """Scores of the reranker by slot, fused with the order so far; a slot that fails has no
        scores, and where all fail the order stays."""
        model = models.get("reranker")

        def scores(g):
            import pandas as pd

            g = g.sort_values("rank")
            out, texts = [], g["window"].str[: S.rerank_chars].tolist()
            for slot, query in zip(g["slots"].iloc[0], g["queries"].iloc[0], strict=False):
                try:
                    got = models.attempt(lambda query=query: model(query, texts), models.Usage(), models.checked_scores(len(texts)))
                except Exception:
                    continue
                out += [(g["question_id"].iloc[0], c, slot, s) for c, s in zip(g["chunk_id"], got, strict=True)]
            return pd.DataFrame(out, columns=["question_id", "chunk_id", "slot", "score"])

        kind = found.schema["question_id"].dataType.simpleString()
        # A question has a bounded number of candidates.
        asked = found.select("question_id", "chunk_id", "rank", "window", F.col("plan.slots").alias("slots"), F.col("plan.queries").alias("queries"))
        judged = asked.groupBy("question_id").applyInPandas(scores, f"question_id {kind}, chunk_id string, slot string, score double")
        order = fusion.rerank(found.select("question_id", "chunk_id", "rank"), cut(judged), "question_id", "chunk_id")
        order = order.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("score").desc(), "chunk_id")))
        return cut(found.drop("score", "rank").join(order, ["question_id", "chunk_id"]))

    def _refined(self, ranked: DataFrame, fused: DataFrame, sub: DataFrame, q: DataFrame) -> DataFrame:
        """The best documents searched once more: their nearest chunks for each sub-query join the
        candidates that are theirs, and all are reranked."""
        docs = cut(fusion.first_documents(ranked, "question_id", "doc_id", "rank", S.rerank_documents).select("question_id", "doc_id"))
        n = docs.groupBy("question_id").agg(F.least(F.count("*") * S.local_per_document, F.lit(S.local_max)).alias("most"))
        asked = sub.select("sub", "question_id", "slot", models.embedding_udf()("query").alias("vector")).join(docs, "question_id")
        near = asked.join(self.store.read("vectors").select("doc_id", "chunk_id", "embedding"), "doc_id")
        near = near.select("sub", "question_id", "slot", "chunk_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), vectors.cosine(F.col("embedding"), F.col("vector")))), 6).alias("s"))
        near = lexical.top(near, "sub", [F.col("s").desc(), F.col("chunk_id")], S.local_max).join(n, "question_id").where("rank <= most")
        local = fusion.merge_queries(near, "question_id", "sub", "chunk_id", "rank", "slot").select("question_id", "chunk_id", "score", F.array(F.lit("vector")).alias("sources"))
        mine = fused.join(ranked.join(docs, ["question_id", "doc_id"], "left_semi").select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_semi").select("question_id", "chunk_id", "score", "sources")
        return self._reranked(self._with_windows(self._pool(mine.unionByName(local)), q))

    @staticmethod
    def _pool(rows: DataFrame) -> DataFrame:
        """Chunks once, with the best score and all sources; the first ``local_max`` of each question."""
        one = rows.groupBy("question_id", "chunk_id").agg(F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
        rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("score").desc(), "chunk_id"))
        return cut(one.withColumn("rank", rank).where(F.col("rank") <= S.local_max))

    def _packed(self, ranked: DataFrame, top_k: int) -> DataFrame:
        """Slots first, two chunks of a document at most."""
        packed = fusion.pack_slots(ranked.select("question_id", "chunk_id", "doc_id", "rank", "slot_ids", F.col("plan.slots").alias("required")), "question_id", top_k)
        rest = ranked.drop("doc_id", "rank")
        return cut(packed.join(rest, ["question_id", "chunk_id"]).select("question_id", "question", "position", "chunk_id", "doc_id", "content", "window", "score", "sources", "slot_ids", "plan"))

    def supplement(self, questions: DataFrame, found: DataFrame, top_k: int = S.top_k, short: DataFrame | None = None) -> DataFrame:
        """Results of ``retrieve`` in which some questions (question_id; if none are named, those
        that lack evidence for a slot) are searched once more, deeper and by vectors alone, within
        the same documents, and packed again from old and new rows."""
        if short is None:
            have = found.groupBy("question_id").agg(F.array_distinct(F.flatten(F.collect_list("slot_ids"))).alias("have"), F.first("plan.slots").alias("need"))
            short = have.where(F.size(F.array_except("need", "have")) > 0).select("question_id")
        short = cut(short)
        if short.isEmpty():
            return found
        q = self._planned(questions.join(short, "question_id", "left_semi"))
        sub = cut(q.select("question_id", "document_ids", F.posexplode("plan.queries").alias("n", "query"), F.col("plan.slots").alias("slots")).select("question_id", "document_ids", "query", F.coalesce(F.get("slots", F.col("n")), F.concat(F.lit("query_"), F.col("n").cast("string"))).alias("slot"), F.concat_ws("#", F.col("question_id").cast("string"), F.col("n").cast("string")).alias("sub")))
        deeper = fusion.merge_queries(self._dense(sub, S.local_max), "question_id", "sub", "chunk_id", "rank", "slot").select("question_id", "chunk_id", "score", F.array(F.lit("vector")).alias("sources"))
        old = found.join(short, "question_id", "left_semi").select("question_id", "chunk_id", "score", "sources")
        again = self._packed(self._reranked(self._with_windows(self._pool(old.unionByName(deeper)), q)), top_k)
        return cut(found.join(short, "question_id", "left_anti").unionByName(again))

    def _chosen(self, found: DataFrame) -> DataFrame:
        """The contexts of an answer: for each slot one first, ``answer_chunks`` in all, within the
        budget of characters."""
        n = fusion.pack_slots(found.select("question_id", "chunk_id", "doc_id", F.col("position").alias("rank"), "slot_ids", F.col("plan.slots").alias("required")), "question_id", S.answer_chunks, S.answer_chunks)
        rows = found.drop("position").join(n.drop("doc_id"), ["question_id", "chunk_id"])
        return cut(windows.char_budget(rows, "question_id", "position", "content", S.answer_chars))

    def ask(self, questions: DataFrame, top_k: int = S.top_k, mode: str = "hybrid") -> DataFrame:
        """(question_id, route, answerable, answer, citation_ids, evidence_score, why, contexts).

        Questions without a context abstain; claims about two sources are verified, relations of
        dates compared (both searched once more if evidence is lacking), sums calculated, all
        others answered from the contexts."""
        top_k = max(1, min(S.max_top_k, top_k))
        found = self.retrieve(questions, top_k, mode)
        per = found.groupBy("question_id").agg(F.count("*").alias("n"), F.first("plan").alias("plan"))
        p = F.col("plan")
        way = ev.route(F.coalesce("n", F.lit(0)), p["answer_type"], F.size(p["slots"]), p["target_relation"], p["needs_calculation"])
        routed = cut(questions.select("question_id", "question").join(per, "question_id", "left").withColumn("route", F.coalesce(way, F.lit("abstain"))))
        judged, found = self._judged(questions, routed, found, top_k)
        said = self._said(routed.where("route in ('answer', 'calculator')"), found)
        every = said.unionByName(judged)
        contexts = found.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("position", "chunk_id", "score"))).alias("contexts"))
        j = routed.select("question_id", "route").join(every, "question_id", "left").join(contexts, "question_id", "left")
        got = F.coalesce(F.transform("contexts", lambda c: c["chunk_id"]), F.array().cast(NO_IDS))
        j = j.withColumn("citation_ids", ev.valid_citations(F.coalesce("cited", F.array().cast(NO_IDS)), got))
        ok = ev.gate(F.coalesce("answerable", F.lit(False)), F.col("citation_ids"))
        cited = F.filter("contexts", lambda c: F.array_contains("citation_ids", c["chunk_id"]))
        total = F.aggregate(cited, F.lit(0.0), lambda a, c: a + c["score"]) / F.nullif(F.size("citation_ids"), F.lit(0))
        why = F.when(~ok, F.coalesce("why", F.when(F.col("route") == "abstain", "no_evidence").when(F.coalesce("answerable", F.lit(False)), "no_valid_citation").otherwise("not_answerable")))
        return j.select("question_id", "route", ok.alias("answerable"), F.when(ok, F.col("answer")).otherwise("").alias("answer"), F.when(ok, F.col("citation_ids")).otherwise(F.array().cast(NO_IDS)).alias("citation_ids"), F.when(ok, F.coalesce(F.round(F.least(F.lit(1.0), total), 4), F.lit(0.0))).otherwise(0.0).alias("evidence_score"), why.alias("why"), "contexts")

    def _judged(self, questions: DataFrame, routed: DataFrame, found: DataFrame, top_k: int) -> tuple[DataFrame, DataFrame]:
        """Answers (question_id, answerable, answer, cited, why) of the temporal and comparison
        routes, and the contexts, those of incomplete questions after their supplement."""
        out = None
        for route, judge in (("temporal", answering.temporal), ("comparison", answering.comparison)):
            mine = routed.where(F.col("route") == route)
            first = judge(*self._evidence(route, mine, found))
            # What a second search may mend.
            short = cut(first.where("not answerable").select("question_id"))
            if not short.isEmpty():
                found = self.supplement(questions, found, top_k, short)
                again = judge(*self._evidence(route, mine.join(short, "question_id", "left_semi"), found))
                first = first.join(short, "question_id", "left_anti").unionByName(again)
            part = first.select("question_id", "answerable", F.coalesce("answer", F.lit("")).alias("answer"), F.col("citation_ids").alias("cited"), F.concat(F.lit(f"{route}:"), F.col("why")).alias("why"))
            out = part if out is None else out.unionByName(part)
        return cut(out), found

    def _evidence(self, route: str, mine: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(questions, evidence, contexts) as the judging operators take them; evidence by the model."""
        model = models.get(route)
        rows = self._chosen(found.join(mine.select("question_id"), "question_id", "left_semi"))
        kind = rows.schema["question_id"].dataType.simpleString()

        def run(g):
            import pandas as pd

            g = g.sort_values("position")
            slots, contexts = list(g["slots"].iloc[0]), [(c, t, list(s)) for c, t, s in zip(g["chunk_id"], g["packed"], g["slot_ids"], strict=True)]
            try:
                got = models.attempt(lambda: model(g["question"].iloc[0], slots, contexts), models.Usage(), list)
            except Exception:
                got = []
            rows = [(g["question_id"].iloc[0], e.get("slot_id"), e.get("citation_id"), e.get("date"), e.get("observed"), e.get("supported")) for e in got]
            return pd.DataFrame(rows, columns=["question_id", "slot_id", "citation_id", "date", "observed", "supported"]).astype({"supported": object})

        told = rows.select("question_id", "question", "position", "chunk_id", "packed", "slot_ids", F.col("plan.slots").alias("slots"))
        evidence = cut(told.groupBy("question_id").applyInPandas(run, f"question_id {kind}, slot_id string, citation_id string, date string, observed string, supported boolean"))
        claimed = F.when(F.col("plan.target_relation") == "changed_claim", "no").otherwise("yes")
        q = mine.select("question_id", F.col("plan.slots").alias("slots"), F.col("plan.target_relation").alias("relation"), claimed.alias("claimed"))
        return q, evidence, rows.select("question_id", "chunk_id")

    def _said(self, mine: DataFrame, found: DataFrame) -> DataFrame:
        """Answers of the answering model: (question_id, answerable, answer, cited, why). Each
        required slot gets a citation of its own; yes or no is demanded of yes-no questions; an
        expression that the model gives is calculated."""
        from quillspark.functions.metrics import calculate

        model = models.get("answerer")
        rows = self._chosen(found.join(mine.select("question_id"), "question_id", "left_semi"))
        kind = rows.schema["question_id"].dataType.simpleString()

        def run(g):
            import pandas as pd

            g = g.sort_values("position")
            why, a = None, {"answerable": False, "answer": "", "citation_ids": [], "calculation": ""}
            try:
                a = models.attempt(lambda: model(g["question"].iloc[0], list(zip(g["chunk_id"], g["packed"], strict=True))), models.Usage(), models.checked_answer)
            except Exception as e:
                why = f"model:{type(e).__name__}"
            answer = a["answer"]
            if a["calculation"] and (value := calculate(a["calculation"])) is not None:
                answer = f"{answer} ({a['calculation']} = {value:g})".strip()
            return pd.DataFrame({"question_id": [g["question_id"].iloc[0]], "answerable": [a["answerable"]], "answer": [answer], "said": [list(a["citation_ids"])], "why": [why]})

        said = rows.select("question_id", "question", "position", "chunk_id", "packed").groupBy("question_id").applyInPandas(run, f"question_id {kind}, answerable boolean, answer string, said array<string>, why string")
        said = cut(said.join(mine.select("question_id", "plan"), "question_id"))
        bound = fusion.bind_citations(rows.select("question_id", "chunk_id", F.col("position").alias("rank"), "slot_ids"), said.where("answerable").select("question_id", F.col("said").alias("cited"), F.col("plan.slots").alias("required")), "question_id")
        j = said.join(bound, "question_id", "left")
        boolean = F.col("plan.answer_type") == "boolean"
        stands = F.lower(F.trim("answer")).rlike(r"^(yes|no|是|否)\b") | F.lower(F.trim("answer")).isin("yes", "no", "是", "否")
        ok = F.col("answerable") & (~boolean | stands)
        why = F.coalesce("why", F.when(F.col("answerable") & boolean & ~stands, "not_yes_or_no"))
        return j.select("question_id", ok.alias("answerable"), "answer", F.coalesce("citation_ids", "said").alias("cited"), why.alias("why"))

    # -- changes -----------------------------------------------------------------------

    def submit_events(self, events: DataFrame, now: float = 0.0) -> int:
        """Adds events (event_id, operation, doc_id, file_path, observed_hash) that are new, as PENDING."""
        rows = events.select("event_id", "operation", "doc_id", "file_path", "observed_hash", F.lit("PENDING").alias("status"), F.lit(0).cast("long").alias("attempts"), F.lit(None).cast("string").alias("error"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))
        return append_new(self.store, "events", rows.where(F.col("operation").isin("INSERT", "UPDATE", "DELETE")), "event_id")

    def event_status(self) -> DataFrame:
        return self.store.read("events")

    def recover_events(self, cutoff: float) -> int:
        """Claims older than ``cutoff``, left by a runner that died, fail and may be claimed again."""
        stale = cut(cdc.recover(self.store.read("events").where("status = 'APPLYING'"), cutoff).where("status = 'FAILED'"))
        self.store.replace("events", stale.select("event_id"), stale)
        return stale.count()

    def apply_events(self, files: DataFrame, now: float = 0.0, backoff: float = 0.0) -> DataFrame:
        """Claims events and applies them: deletes, and ingests of ``files`` (path, content). The
        claim is stored first, so another runner doesn't take the same events. Of the events of a
        document the last one decides; each document stands for itself: a file that is missing or
        can't be read fails its own events. Failed events are tried again, ``retries`` times in
        all. Returns the ledger."""
        for k in range(S.retries):
            ledger = self.store.read("events")
            mine = cdc.claim(ledger).where("claimed").select("event_id", "status", "attempts")
            mine = cut(ledger.drop("status", "attempts", "updated_at").join(mine, "event_id").withColumn("updated_at", F.lit(now)))
            if mine.isEmpty():
                break
            if k and backoff:
                time.sleep(backoff * min(2 ** (k - 1), 4))
            self.store.replace("events", mine.select("event_id"), mine)
            outcome = self._apply(mine, files, now)
            status = F.when(F.col("why").isNull(), "COMMITTED").otherwise("FAILED")
            done = mine.drop("status", "error").join(outcome, "event_id").withColumn("status", status).withColumn("error", F.left("why", F.lit(S.error_chars))).drop("why")
            self.store.replace("events", mine.select("event_id"), cut(done))
        return self.store.read("events")

    def _apply(self, mine: DataFrame, files: DataFrame, now: float) -> DataFrame:
        """(event_id, why): applies the last event of each document; ``why`` it failed, or null."""
        by_path = self.store.read("documents").groupBy("file_path").agg(F.min("doc_id").alias("__known"))
        doc = F.coalesce(F.nullif("doc_id", F.lit("")), "__known", doc_id_of(F.col("file_path")))
        mine = cut(mine.join(by_path, "file_path", "left").withColumn("doc", doc).select("event_id", "operation", "doc", "file_path", "created_at"))
        latest = F.struct("created_at", "event_id")
        last = cut(mine.groupBy("doc").agg(F.max_by("operation", latest).alias("operation"), F.max_by("file_path", latest).alias("path")))
        live = last.where("operation <> 'DELETE'").select("path", F.col("doc").alias("doc_id"))
        nothing = self.spark.createDataFrame([], "doc string, why string")
        try:
            gone = last.where("operation = 'DELETE'").select(F.col("doc").alias("doc_id"))
            if not gone.isEmpty():
                self.delete_documents(gone)
            here = files.select("path", "content").join(live, "path")
            missing = live.join(files.select("path").distinct(), "path", "left_anti").select(F.col("doc_id").alias("doc"), F.lit("the file is missing").alias("why"))
            bad = nothing
            if not here.isEmpty():
                bad = self.ingest(here, now).where("status = 'FAILED'").select(F.col("doc_id").alias("doc"), F.coalesce("error", F.lit("failed")).alias("why"))
            bad = cut(bad.unionByName(missing))
            if self.repair():
                left = self.inconsistent()
                chunks = self.store.read("chunks").select("chunk_id", F.col("doc_id").alias("doc")).join(left, "chunk_id", "left_semi").select("doc").distinct()
                bad = cut(bad.unionByName(chunks.join(bad, "doc", "left_anti").select("doc", F.lit("inconsistent after repair").alias("why"))))
        except Exception as e:  # the batch as a whole
            return cut(mine.select("event_id", F.lit(f"{type(e).__name__}: {e}"[: S.error_chars]).alias("why")))
        return cut(mine.select("event_id", "doc").join(bad, "doc", "left").select("event_id", "why"))

    # -- dispatch ----------------------------------------------------------------------

    def run(self, task: str, **given) -> DataFrame:
        """One entry for all flows: ingest, ask, update, delete, rebuild, migrate, status or stats."""
        flows = {"ingest": self.ingest, "ask": self.ask, "update": self.apply_events, "rebuild": self.rebuild, "migrate": self.migrate, "status": self.event_status, "documents": self.documents, "stats": self.stats}
        if task not in flows:
            raise ValueError(f"unknown task {task!r}; one of {', '.join(sorted(flows))}")
        return flows[task](**given)
