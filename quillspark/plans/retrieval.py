"""Lexical, dense and hybrid retrieval, fusion, reranking and packing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import fusion, lexical, vectors
from quillspark.plans.registry import query
from quillspark.settings import DEFAULTS as S
from quillspark.shared import cut, spread, table

#: The questions: all texts of benchmark; of the embeddings every fiftieth row.
ASKED_VECTORS = "vec_id % 50 = 0"
_T = "regexp_extract_all(lower(text), '[a-z0-9]+')"

BM25 = f"""d AS (SELECT doc_id, {_T} AS t, len({_T}) AS n FROM documents),
st AS (SELECT count(*)::DOUBLE AS nd, avg(n) AS al FROM d),
p AS (SELECT doc_id, term, count(*) AS tf, max(n) AS n FROM (SELECT doc_id, n, unnest(t) AS term FROM d) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id AS question_id, unnest({_T}) AS term FROM benchmark),
bm AS (SELECT q.question_id, p.doc_id, round(sum(greatest(1e-6::DOUBLE, ln((nd - df + 0.5) / (df + 0.5))) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / al))), 6) AS bm25
  FROM q JOIN df USING (term) JOIN p USING (term), st GROUP BY q.question_id, p.doc_id)"""
LEX = f"lx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY bm25 DESC, doc_id) AS rank FROM bm) WHERE rank <= {S.candidate_depth})"
_SIM = "round(greatest(0::DOUBLE, least(1::DOUBLE, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6)"
DENSE = f"""sm AS (SELECT q.vec_id AS question_id, v.vec_id, v.label, {_SIM} AS similarity FROM embeddings v, embeddings q WHERE q.{ASKED_VECTORS}),
dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, vec_id) AS rank FROM sm) WHERE rank <= {S.candidate_depth})"""


def _said(df, column):
    """An array column as text, so that any engine shows the same."""
    return df.withColumn(column, F.array_join(column, ","))


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark")


def _bm25(spark, sf_dir, k, restrict=None):
    return lexical.bm25_top(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), _asked(spark, sf_dir), k, restrict=restrict)


def _lexical(spark, sf_dir):
    return lexical.top(_bm25(spark, sf_dir, S.candidate_depth), "question_id", [F.col("bm25").desc(), F.col("doc_id")], S.candidate_depth)


def _nearest(spark, sf_dir, k, by=None):
    e = table(spark, sf_dir, "embeddings")
    q = e.where(ASKED_VECTORS).select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    return vectors.nearest(e.withColumn("modality", F.col("label") % 3), q, k, by=by)


def _dense(spark, sf_dir):
    return lexical.top(_nearest(spark, sf_dir, S.candidate_depth), "question_id", [F.col("similarity").desc(), F.col("vec_id")], S.candidate_depth)


@query(f"WITH {BM25}, {LEX} SELECT question_id, doc_id, bm25, rank, round(1 / (1 + abs(bm25)), 6) AS score FROM lx")
def bm25_topk(spark, sf_dir):
    """``score`` falls as relevance rises; order by bm25 or rank only."""
    return _lexical(spark, sf_dir).select("question_id", "doc_id", "bm25", "rank", F.round(1 / (1 + F.abs("bm25")), 6).alias("score"))


@query(f"WITH {BM25} SELECT * FROM (SELECT question_id, doc_id, bm25, row_number() OVER (PARTITION BY question_id ORDER BY bm25 DESC, doc_id) AS rank FROM bm WHERE doc_id % 2 = 0) WHERE rank <= 10")
def bm25_doc_filter(spark, sf_dir):
    """The filter reaches matches, not the statistics."""
    return lexical.top(_bm25(spark, sf_dir, 10, F.col("doc_id") % 2 == 0), "question_id", [F.col("bm25").desc(), F.col("doc_id")], 10).select("question_id", "doc_id", "bm25", "rank")


@query(
    f"""WITH q AS (SELECT item_id AS question_id, regexp_extract_all(lower(text), '[a-z0-9_][a-z0-9_.-]*') AS f FROM benchmark),
u AS (SELECT question_id, tok, min(i) AS i FROM (SELECT question_id, unnest(f) AS tok, unnest(range(1, len(f) + 1)) AS i FROM q) GROUP BY ALL),
t AS (SELECT question_id, tok FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY i) AS n FROM u) WHERE n <= 32),
m AS (SELECT question_id, doc_id, count(*) AS n, count(*) FILTER (WHERE contains(lower(text), tok)) AS matched,
   sum(((length(lower(text)) - length(replace(lower(text), tok, ''))) // length(tok))) AS freq FROM t, documents GROUP BY question_id, doc_id),
s AS (SELECT question_id, doc_id, matched, round(matched / n::DOUBLE + least(freq, 10) / 100.0::DOUBLE, 6) AS score FROM m WHERE matched > 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 40"""
)
def lexical_fallback_topk(spark, sf_dir):
    """Without an index: each text is searched once for each word that any question has."""
    from quillspark.functions.text import lexical_tokens

    q = _asked(spark, sf_dir).select(F.col("item_id").alias("question_id"), lexical_tokens(F.col("text")).alias("toks"))
    s = lexical.fallback_top(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), q, 40, "doc_id", "text")
    return lexical.top(s, "question_id", [F.col("score").desc(), F.col("doc_id")], 40)


@query(f"WITH {DENSE} SELECT question_id, vec_id, similarity, rank FROM dn")
def cosine_topk(spark, sf_dir):
    return _dense(spark, sf_dir).select("question_id", "vec_id", "similarity", "rank")


_MODAL = "m AS (SELECT * FROM (SELECT question_id, label % 3 AS modality, vec_id, similarity, row_number() OVER (PARTITION BY question_id, label % 3 ORDER BY similarity DESC, vec_id) AS rank FROM sm) WHERE rank <= 20)"


def _modal(spark, sf_dir):
    from pyspark.sql import Window

    s = _nearest(spark, sf_dir, 20, "modality")
    rank = F.row_number().over(Window.partitionBy("question_id", "modality").orderBy(F.col("similarity").desc(), "vec_id"))
    return s.withColumn("rank", rank.cast("long")).where("rank <= 20").select("question_id", "modality", "vec_id", "similarity", "rank")


@query(f"WITH {DENSE}, {_MODAL} SELECT question_id, modality, vec_id, similarity, rank FROM m")
def cosine_topk_per_modality(spark, sf_dir):
    return _modal(spark, sf_dir)


@query(
    f"""WITH {DENSE}, {_MODAL}, f AS (SELECT question_id, vec_id, sum((CASE modality WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.95::DOUBLE ELSE 0.90::DOUBLE END) / (60 + rank)) AS rrf FROM m GROUP BY question_id, vec_id)
SELECT question_id, vec_id, round(rrf / max(rrf) OVER (PARTITION BY question_id), 9) AS score FROM f"""
)
def modality_rrf(spark, sf_dir):
    w = F.when(F.col("modality") == 0, 1.0).when(F.col("modality") == 1, 0.95).otherwise(0.90)
    return fusion.merge_modalities(_modal(spark, sf_dir), "question_id", "vec_id", "rank", w)


@query(
    f"""WITH {DENSE}, h AS (SELECT question_id % 3 AS q, question_id AS sub, 'slot_' || (question_id % 2) AS slot, vec_id, rank FROM dn),
f AS (SELECT q, vec_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, list_sort(list_distinct(list(slot))) AS slots FROM h GROUP BY q, vec_id)
SELECT q, vec_id, array_to_string(slots, ',') AS slots, round(rrf / max(rrf) OVER (PARTITION BY q), 9) AS score FROM f"""
)
def subquery_rrf(spark, sf_dir):
    h = _dense(spark, sf_dir).select((F.col("question_id") % 3).alias("q"), F.col("question_id").alias("sub"), F.concat(F.lit("slot_"), (F.col("question_id") % 2).cast("string")).alias("slot"), "vec_id", "rank")
    return _said(fusion.merge_queries(h, "q", "sub", "vec_id", "rank", "slot"), "slots")


_HYBRID = f"""{BM25}, {LEX}, {DENSE},
c AS (SELECT question_id, doc_id AS id, 'lexical' AS source, bm25 AS s FROM lx UNION ALL SELECT question_id, vec_id, 'vector', similarity FROM dn),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id, source ORDER BY s DESC, id) AS rk FROM c),
f AS (SELECT question_id, id, sum((CASE source WHEN 'vector' THEN {S.vector_weight}::DOUBLE ELSE {S.lexical_weight}::DOUBLE END) / (60 + rk)) AS rrf, list_sort(list_distinct(list(source))) AS sources FROM r GROUP BY question_id, id),
g AS (SELECT question_id, id, sources, round(rrf / max(rrf) OVER (PARTITION BY question_id), 9) AS score FROM f),
hy AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, len(sources) DESC, CASE WHEN list_contains(sources, 'vector') THEN 0 ELSE 1 END, id) AS rank FROM g)"""


def _hybrid(spark, sf_dir):
    lex = _lexical(spark, sf_dir).select("question_id", F.col("doc_id").alias("id"), F.lit("lexical").alias("source"), F.col("bm25").alias("s"))
    den = _dense(spark, sf_dir).select("question_id", F.col("vec_id").alias("id"), F.lit("vector").alias("source"), F.col("similarity").alias("s"))
    return fusion.fuse_sources(lex.unionByName(den), "question_id", "id", "source", "s", {"vector": S.vector_weight, "lexical": S.lexical_weight})


@query(f"WITH {_HYBRID} SELECT question_id, id, array_to_string(sources, ',') AS sources, score, rank FROM hy WHERE rank <= 10")
def hybrid_rrf_topk(spark, sf_dir):
    """The flagship: BM25 and cosine candidates, fused by weighted reciprocal ranks."""
    return _said(_hybrid(spark, sf_dir).where("rank <= 10").select("question_id", "id", "sources", "score", "rank"), "sources")


@query(f"WITH {_HYBRID} SELECT question_id, id, max(s) AS score, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, CASE WHEN count(DISTINCT source) > 1 THEN 'hybrid' ELSE min(source) END AS source_type FROM c GROUP BY question_id, id")
def dedup_contexts(spark, sf_dir):
    lex = _lexical(spark, sf_dir).select("question_id", F.col("doc_id").alias("id"), F.lit("lexical").alias("source"), F.col("bm25").alias("s"))
    den = _dense(spark, sf_dir).select("question_id", F.col("vec_id").alias("id"), F.lit("vector").alias("source"), F.col("similarity").alias("s"))
    return _said(fusion.deduplicate(lex.unionByName(den), "question_id", "id", "s", "source"), "sources")


_SLOTS = """sc AS (SELECT hy.question_id, hy.id, hy.rank, 'slot_' || k AS slot, round(((hy.id * (7 + k * 6)) % 101) / 101.0::DOUBLE, 6) AS score FROM hy, (SELECT unnest([0, 1]) AS k) WHERE hy.rank <= 20),
rs AS (SELECT *, row_number() OVER (PARTITION BY question_id, slot ORDER BY score DESC, rank) AS r FROM sc)"""
_RERANKED = f"""{_SLOTS}, bs AS (SELECT question_id, id, sum(1.0::DOUBLE / (60 + r)) AS t, max(score) AS rerank_score, list_sort(list_distinct(list(slot) FILTER (WHERE r <= 4))) AS slot_ids, min(rank) AS rank FROM rs GROUP BY question_id, id),
rr AS (SELECT question_id, id, rerank_score, coalesce(slot_ids, []) AS slot_ids, round((1.0::DOUBLE / (60 + rank) + t) / max(1.0::DOUBLE / (60 + rank) + t) OVER (PARTITION BY question_id), 9) AS score FROM bs)"""


def _reranked(spark, sf_dir):
    c = cut(_hybrid(spark, sf_dir).where("rank <= 20").select("question_id", "id", "rank"))
    k = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
    s = c.select("question_id", "id", k)
    s = s.select("question_id", "id", F.concat(F.lit("slot_"), F.col("k").cast("string")).alias("slot"), F.round(((F.col("id") * (7 + F.col("k") * 6)) % 101) / 101.0, 6).alias("score"))
    return fusion.rerank(c, s, "question_id", "id")


@query(f"WITH {_HYBRID}, {_RERANKED} SELECT question_id, id, rerank_score, array_to_string(slot_ids, ',') AS slot_ids, score FROM rr")
def rerank_slot_fusion(spark, sf_dir):
    return _said(_reranked(spark, sf_dir), "slot_ids")


_DOCS = "rd AS (SELECT question_id, id, id % 5 AS doc, rank FROM hy)"


def _docs(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("question_id", "id", (F.col("id") % 5).alias("doc"), "rank")


@query(f"WITH {_HYBRID}, {_DOCS}, cc AS (SELECT *, row_number() OVER (PARTITION BY question_id, doc ORDER BY rank) AS n FROM rd), pp AS (SELECT question_id, id, doc, rank, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS position FROM cc WHERE n <= 2) SELECT * FROM pp WHERE position <= 8")
def pack_cap_per_doc(spark, sf_dir):
    return fusion.cap_per_document(_docs(spark, sf_dir), "question_id", "doc", "rank", S.chunks_per_document, 8)


@query(f"WITH {_HYBRID}, {_DOCS}, cc AS (SELECT *, row_number() OVER (PARTITION BY question_id, doc ORDER BY rank) > 1 AS o FROM rd), pp AS (SELECT question_id, id, doc, rank, row_number() OVER (PARTITION BY question_id ORDER BY o, rank) AS position FROM cc) SELECT * FROM pp WHERE position <= 12")
def select_diverse(spark, sf_dir):
    return fusion.diverse(_docs(spark, sf_dir), "question_id", "doc", "rank", 1, 12)


@query(f"WITH {_HYBRID}, {_DOCS}, m AS (SELECT question_id, doc, min(rank) AS first_rank FROM rd GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY first_rank) AS position FROM m) SELECT * FROM o WHERE position <= 3")
def select_documents(spark, sf_dir):
    return fusion.first_documents(_docs(spark, sf_dir), "question_id", "doc", "rank", 3)


_TOP = "tp AS (SELECT * FROM (SELECT question_id, id, id % 5 AS doc, slot_ids, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM rr) WHERE rank <= {})"
#: Two slots: the first match of the first; of the second the first of another document, else the first other chunk; then the rest, two of a document.
_PACKED = """p0 AS (SELECT question_id, min_by(id, rank) AS id, min_by(doc, rank) AS doc FROM tp WHERE list_contains(slot_ids, 'slot_0') GROUP BY 1),
o1 AS (SELECT tp.*, coalesce(tp.doc = p0.doc, false) AS again FROM tp LEFT JOIN p0 USING (question_id) WHERE list_contains(slot_ids, 'slot_1') AND tp.id IS DISTINCT FROM p0.id),
p1 AS (SELECT question_id, arg_min(id, again::INT * 1000 + rank) AS id FROM o1 GROUP BY 1),
ch AS (SELECT tp.*, CASE WHEN tp.id = p0.id THEN 0 WHEN tp.id = p1.id THEN 1 ELSE 2 END AS turn FROM tp LEFT JOIN p0 USING (question_id) LEFT JOIN p1 USING (question_id)),
cd AS (SELECT *, row_number() OVER (PARTITION BY question_id, doc ORDER BY turn, rank) AS n FROM ch),
pk AS (SELECT question_id, id, doc, row_number() OVER (PARTITION BY question_id ORDER BY turn, rank) AS position FROM cd WHERE n <= 2)"""


@query(f"WITH {_HYBRID}, {_RERANKED}, {_TOP.format(20)}, {_PACKED} SELECT question_id, id AS chunk_id, doc AS doc_id, position FROM pk WHERE position <= 8")
def pack_slots(spark, sf_dir):
    r = lexical.top(_reranked(spark, sf_dir), "question_id", [F.col("score").desc(), F.col("id")], 20)
    r = r.select("question_id", F.col("id").alias("chunk_id"), (F.col("id") % 5).alias("doc_id"), "rank", "slot_ids", F.array(F.lit("slot_0"), F.lit("slot_1")).alias("required"))
    return fusion.pack_slots(r, "question_id", 8)


#: What is cited is the smallest id; it serves a slot before any other does.
_BOUND = """ct AS (SELECT question_id, min(id) AS c FROM tp GROUP BY 1),
b0 AS (SELECT question_id, c, arg_min(id, CASE WHEN id = c THEN 0 ELSE rank END) FILTER (WHERE list_contains(slot_ids, 'slot_0')) AS x FROM tp JOIN ct USING (question_id) GROUP BY 1, 2),
b1 AS (SELECT question_id, c, x, arg_min(id, CASE WHEN id = c THEN 0 ELSE rank END) FILTER (WHERE list_contains(slot_ids, 'slot_1') AND id IS DISTINCT FROM x) AS y FROM tp JOIN b0 USING (question_id) GROUP BY 1, 2, 3),
l AS (SELECT question_id, c, list_distinct([c]) || list_filter([x], lambda i: i IS NOT NULL AND i <> c) || list_filter([y], lambda i: i IS NOT NULL AND i <> c) AS ids FROM b1)"""


@query(f"WITH {_HYBRID}, {_RERANKED}, {_TOP.format(8)}, {_BOUND} SELECT question_id, array_to_string(ids, ',') AS citation_ids, (len(ids) - 1)::BIGINT AS added FROM l")
def bind_citations(spark, sf_dir):
    r = lexical.top(_reranked(spark, sf_dir), "question_id", [F.col("score").desc(), F.col("id")], 8)
    c = cut(r.select("question_id", F.col("id").alias("chunk_id"), "rank", "slot_ids"))
    a = c.groupBy("question_id").agg(F.array(F.min("chunk_id")).alias("cited"), F.array(F.lit("slot_0"), F.lit("slot_1")).alias("required"))
    return _said(fusion.bind_citations(c, a, "question_id"), "citation_ids")


@query(f"WITH {_HYBRID} SELECT question_id, count(*) AS candidates, count(*) FILTER (WHERE list_contains(sources, 'vector')) AS dense_candidates, count(*) FILTER (WHERE list_contains(sources, 'lexical')) AS lexical_candidates, count(*) FILTER (WHERE len(sources) > 1) AS shared FROM hy GROUP BY question_id")
def trace_counts(spark, sf_dir):
    h = _hybrid(spark, sf_dir)
    return h.groupBy("question_id").agg(F.count("*").alias("candidates"), F.count_if(F.array_contains("sources", "vector")).alias("dense_candidates"), F.count_if(F.array_contains("sources", "lexical")).alias("lexical_candidates"), F.count_if(F.size("sources") > 1).alias("shared"))
