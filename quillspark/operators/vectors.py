"""Cosine search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.shared import cut

#: Question vectors are sent to all tasks only up to this many.
QUESTIONS_AT_ONCE = 2000
#: Rows that are scored together against a block of questions.
ROWS_AT_ONCE = 2000


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Rows of length 1; vectors that are null, empty or of length 0 are nan."""
    out = np.full((len(vectors), width), np.nan)
    for i, v in enumerate(vectors):
        if v is not None and len(v) == width:
            out[i] = [np.nan if x is None else x for x in v]
    with np.errstate(invalid="ignore", divide="ignore"):
        return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def by_id(ids: pa.Array) -> np.ndarray:
    """Places in the order of ids (numbers or texts), nulls last."""
    return pc.sort_indices(ids).to_numpy()


def first_k(scores: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(question, row) of the k highest scores of each question among ``rows``, which are in the
    order that breaks ties; nan counts as lowest."""
    best = np.argsort(-np.nan_to_num(scores[:, rows], nan=-1.0), axis=1, kind="stable")[:, :k]
    return np.repeat(np.arange(len(scores)), best.shape[1]), rows[best].ravel()


def nearest(vectors: DataFrame, questions: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding", by: str | None = None) -> DataFrame:
    """(question_id, vec_id[, by], similarity): the k nearest vectors of each question, and of
    each value of ``by`` apart, and more that may be: the best of each task. Similarity is the
    cosine, clipped to 0..1, rounded to six digits; ties go to the smaller id.

    Questions stand in blocks of a bounded number, one after the other, each cut; a task takes
    the products of its rows with the whole block and keeps the best, so what is shuffled is k
    rows for each question and task, never all pairs."""
    if by is None:
        vectors, cols = vectors.withColumn("__by", F.lit(0)), []
    else:
        vectors, cols = vectors.withColumn("__by", F.col(by)), [by]
    rows = vectors.select(vec_id, "__by", F.col(embedding).cast("array<double>").alias("v"))
    asked = cut(questions.select("question_id", F.col("vector").cast("array<double>").alias("vector")))
    n = asked.count()
    blocks = max(1, -(-n // QUESTIONS_AT_ONCE))
    kinds = {f.name: f.dataType.simpleString() for f in [*rows.schema, *asked.schema]}
    shape = f"question_id {kinds['question_id']}, {vec_id} {kinds[vec_id]}, __by {kinds['__by']}, similarity double"
    out = None
    for i in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == i)
        some = part.toArrow()  # a bounded number
        width = max((len(v) for v in some.column("vector").to_pylist() if v is not None), default=0)
        held = vectors.sparkSession.sparkContext.broadcast((some.column("question_id").combine_chunks(), _matrix(some.column("vector").to_pylist(), width)))

        def run(batches: Iterator[pa.RecordBatch], held=held, width=width) -> Iterator[pa.RecordBatch]:
            ids, q = held.value
            for whole in batches:
                for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                    b = whole.slice(start, ROWS_AT_ONCE)
                    with np.errstate(invalid="ignore"):
                        s = np.round(np.clip(q @ _matrix(b.column("v").to_pylist(), width).T, 0.0, 1.0), 6)
                    place = by_id(b.column(vec_id))
                    groups = np.array([repr(x) for x in b.column("__by").to_pylist()])
                    at_q, at_v = [], []
                    for g in np.unique(groups):
                        q_, v_ = first_k(s, place[groups[place] == g], k)
                        at_q.append(q_)
                        at_v.append(v_)
                    x, y = np.concatenate(at_q), np.concatenate(at_v)
                    good = ~np.isnan(s[x, y])
                    x, y = x[good], y[good]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), b.column(vec_id).take(pa.array(y)), b.column("__by").take(pa.array(y)), pa.array(s[x, y])], names=["question_id", vec_id, "__by", "similarity"])

        found = cut(rows.mapInArrow(run, shape))
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("__by", by) if cols else out.drop("__by")
