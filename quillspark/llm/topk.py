"""Exact top-k search by distributed histogram selection.

Rows stand in packed blocks and never move after they are packed. Queries are packed too
and taken in rounds of a bounded size (QUERIES_AT_ONCE), which are sent to all tasks; a
task scores its blocks against all queries of the round. A first pass counts scores in
wide bins; the bin that holds the kth score is found from the summed counts and split
again, until bins are single scores. Then the kth score of each query is known, and a
last pass emits the scores above it and, of those equal to it, as many smallest ids as
are needed. Only counts and results are shuffled, at most about k for each query and
block, so what is shuffled doesn't grow with the rows' width.

A block leaves out only bins below its own kth score: the kth score of all rows is not
below that of some of them, so the counts that decide are whole.

Vectors that are null or hold null or non-finite components take no part. Vectors of
unequal length are compared as if the shorter were padded with zeros. Queries are rows
(a repeated vec_id asks once for each row); a row is a candidate for all queries but
itself; a null vec_id is no query and stands last among ties. Empty tables give no rows.
Scores are exact for all finite components: in floating point while every sum fits 53
bits, in 64-bit integers up to 62 bits, and in integers of any size beyond; a score that
no long holds is shown as the nearest long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.shared import cut, shuffle_partitions

K = 20
SCALE = 64
ROW_BLOCK = 4096
#: Queries that are sent to all tasks at once (of 64 components: 16 MB).
QUERIES_AT_ONCE = 32_768
#: Queries that are scored together, for the size of a task's matrix.
QUERY_BLOCK = 512
#: Bits by which one pass narrows a bin.
PASS_BITS = 8
LONG = np.iinfo(np.int64)
NO_ID = LONG.max
#: Lengths (Euclidean) up to which products of two vectors stay exact in double and in long.
EXACT_DOUBLE, EXACT_LONG = 2.0**26, 2.0**31


def integers(vectors: list[list[float]], width: int) -> tuple[np.ndarray, dict[int, list[int]]]:
    """Rows of floor(SCALE * x) as doubles, and by row those too large for exact sums, as integers."""
    data = np.zeros((len(vectors), width), np.float64)
    for i, v in enumerate(vectors):
        data[i, : len(v)] = v
    with np.errstate(over="ignore"):
        data = np.floor(data * SCALE)
    big = np.flatnonzero(~((np.abs(data) < EXACT_LONG).all(axis=1)))
    whole = {int(i): [math.floor(Fraction(x) * SCALE) for x in vectors[i]] for i in big}
    data[big] = 0.0
    return data, whole


def inner(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole doubles, each below EXACT_LONG."""
    if not len(q) or not len(c):
        return np.zeros((len(q), len(c)), np.int64)
    qn, cn = np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
    if qn.max() * cn.max() < 2.0**52:
        return (q @ c.T).astype(np.int64)
    out = np.zeros((len(q), len(c)), np.int64)
    qs, cs = qn < EXACT_DOUBLE, cn < EXACT_DOUBLE
    out[np.ix_(qs, cs)] = (q[qs] @ c[cs].T).astype(np.int64)
    for a, b in ((qs, ~cs), (~qs, np.ones(len(c), bool))):
        if a.any() and b.any():
            x, y = q[a].astype(np.int64), c[b].astype(np.int64)
            if qn[a].max() * cn[b].max() < 2.0**62:
                out[np.ix_(a, b)] = x @ y.T
            else:
                part = x.astype(object) @ y.T.astype(object)
                out[np.ix_(a, b)] = np.clip(part, int(LONG.min), int(LONG.max)).astype(np.int64)
    return out


def scored(q: np.ndarray, q_big: dict[int, list[int]], c: np.ndarray, c_big: dict[int, list[int]]) -> np.ndarray:
    """Scores of queries against candidates; rows with huge components in integers of any size."""
    s = inner(q, c)

    def product(a: list[int], b: list[int]) -> int:
        return min(max(sum(x * y for x, y in zip(a, b, strict=False)), int(LONG.min)), int(LONG.max))

    exact = lambda data, big, i: big.get(i) or [int(x) for x in data[i]]
    for i, v in q_big.items():
        s[i] = [product(v, exact(c, c_big, j)) for j in range(len(c))]
    for j, v in c_big.items():
        s[:, j] = [product(exact(q, q_big, i), v) for i in range(len(q))]
    return s


def _pack(rows: DataFrame, blocks: int) -> DataFrame:
    """One row for each block: block, uids, ids, width, integer components as bytes, huge rows.
    Blocks are dealt evenly over the partitions, several to each once there are many."""

    def run(t: pa.Table) -> pa.Table:
        vectors = t.column("vector").to_pylist()
        width = max(map(len, vectors))
        data, whole = integers(vectors, width)
        ids = np.array([NO_ID if x is None else x for x in t.column("vec_id").to_pylist()], np.int64)
        huge = [{"row": i, "parts": [str(x) for x in v]} for i, v in whole.items()]
        return pa.table(
            {
                "block": pa.array([t.column("block")[0].as_py()], pa.int32()),
                "width": pa.array([width], pa.int32()),
                "uids": [t.column("uid").to_numpy().astype(np.int64).tobytes()],
                "ids": [ids.tobytes()],
                "data": [data.tobytes()],
                "huge": pa.array([huge], pa.list_(pa.struct([("row", pa.int32()), ("parts", pa.list_(pa.string()))]))),
            }
        )

    dealt = rows.select(F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("block"), "uid", "vec_id", "vector")
    packed = dealt.groupBy("block").applyInArrow(run, "block int, width int, uids binary, ids binary, data binary, huge array<struct<row:int,parts:array<string>>>")
    parts = min(blocks, max(shuffle_partitions(rows.sparkSession), blocks // 16))
    return cut(packed.repartitionById(parts, F.pmod("block", F.lit(parts))))


class Block:
    """A packed block, unpacked."""

    def __init__(self, row):
        self.uids, self.ids = np.frombuffer(row["uids"], np.int64), np.frombuffer(row["ids"], np.int64)
        self.data = np.frombuffer(row["data"], np.float64).reshape(len(self.uids), row["width"])
        self.big = {h["row"]: [int(x) for x in h["parts"]] for h in row["huge"] or []}

    def part(self, at: slice) -> tuple[np.ndarray, dict[int, list[int]]]:
        return self.data[at], {i - at.start: v for i, v in self.big.items() if at.start <= i < at.stop}


def _matrices(batches: Iterator[pa.RecordBatch], queries: list[Block]) -> Iterator[tuple[int, slice, Block, np.ndarray, np.ndarray]]:
    """For each block of rows and part of the queries: (first place of the query block, part, rows, scores, own)."""
    for batch in batches:
        for i in range(batch.num_rows):
            c = Block(batch.slice(i, 1).to_pylist()[0])
            first = 0
            for q in queries:
                width = min(q.data.shape[1], c.data.shape[1])
                for start in range(0, len(q.uids), QUERY_BLOCK):
                    at = slice(start, min(start + QUERY_BLOCK, len(q.uids)))
                    data, big = q.part(at)
                    s = scored(data[:, :width], big, c.data[:, :width], c.big)
                    yield first, at, c, s, q.uids[at][:, None] == c.uids[None, :]
                first += len(q.uids)


def search(df: DataFrame, k: int = K, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``."""
    spark = df.sparkSession
    v = F.col(embedding).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = F.col(embedding).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(fine(x), F.lit(False)))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector")).where(whole)
    rows = cut(rows.withColumn("uid", F.monotonically_increasing_id()))
    asked = rows.where(F.col("vec_id") % every == 0)
    n_rows, n_asked = rows.count(), asked.count()
    if not n_asked or n_rows < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    candidates = _pack(rows, -(-n_rows // ROW_BLOCK))
    per_block = min(QUERIES_AT_ONCE, ROW_BLOCK)
    q_blocks = -(-n_asked // per_block)
    queries = _pack(asked, q_blocks)
    found, at_once = None, max(1, QUERIES_AT_ONCE // per_block)
    for first in range(0, q_blocks, at_once):
        part = _round(candidates, queries.where(F.col("block").between(first, first + at_once - 1)), k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("uid").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = F.when(F.col("vec_id") != int(NO_ID), F.col("vec_id")).alias("vec_id")
    return ranked.select("query_id", "rank", ids, "score")


def _round(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(uid, query_id, vec_id, score), cut: k candidates, or more where ids tie, of each query of the round."""
    spark = candidates.sparkSession
    packed = sorted((r.asDict(recursive=True) for r in queries.collect()), key=lambda r: r["block"])  # a bounded number
    if not packed:
        return spark.createDataFrame([], "uid long, query_id long, vec_id long, score long")
    held = spark.sparkContext.broadcast(packed)
    blocks = [Block(r) for r in packed]
    uids, qids = np.concatenate([b.uids for b in blocks]), np.concatenate([b.ids for b in blocks])
    place = {int(u): i for i, u in enumerate(uids)}

    def histogram(shift: int, last: int | None, bins: np.ndarray, need: np.ndarray) -> DataFrame:
        state = spark.sparkContext.broadcast((bins, need))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bins, need = state.value
            uids = None
            for first, at, _, s, own in _matrices(batches, [Block(r) for r in held.value]):
                if uids is None:
                    uids = np.concatenate([np.frombuffer(r["uids"], np.int64) for r in held.value])
                here = slice(first + at.start, first + at.stop)
                live = (need[here] > 0)[:, None] & ~own
                if last is not None:
                    live &= (s >> last) == bins[here][:, None]
                else:
                    # Below this block's own kth score no bin counts.
                    low = np.where(live, s, LONG.min)
                    most = min(int(need[here].max(initial=1)), s.shape[1])
                    kth = np.partition(low, s.shape[1] - most, axis=1)[:, s.shape[1] - most]
                    live &= s >= (kth >> shift << shift)[:, None]
                q, col = np.nonzero(live)
                if not len(q):
                    continue
                b = s[q, col] >> shift
                o = np.lexsort((b, q))
                q, b = q[o], b[o]
                new = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (b[1:] != b[:-1])))
                n = np.diff(np.append(new, len(q)))
                yield pa.RecordBatch.from_arrays([pa.array(uids[here][q[new]]), pa.array(b[new]), pa.array(n.astype(np.int64))], names=["uid", "bin", "n"])

        return candidates.mapInArrow(run, "uid long, bin long, n long").groupBy("uid", "bin").agg(F.sum("n").alias("n"))

    def choose(counts: DataFrame, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the bin that holds its kth score, and how many of the bin it needs."""
        asked = spark.createDataFrame(pa.table({"uid": uids, "want": want}))
        down = Window.partitionBy("uid").orderBy(F.col("bin").desc())
        c = counts.join(F.broadcast(asked), "uid")  # the round's queries
        c = c.withColumn("upto", F.sum("n").over(down)).withColumn("above", F.col("upto") - F.col("n"))
        # Where there are fewer candidates than k, the lowest bin holds the last of them.
        c = c.withColumn("lowest", F.row_number().over(Window.partitionBy("uid").orderBy("bin")) == 1)
        c = c.where("above < want and (upto >= want or lowest)")
        got = c.select("uid", "bin", (F.least("want", "upto") - F.col("above")).alias("need")).toArrow()
        at = np.array([place[int(u)] for u in got.column("uid").to_numpy()], np.int64)
        bins, need = np.zeros(len(uids), np.int64), np.zeros(len(uids), np.int64)
        bins[at], need[at] = got.column("bin").to_numpy(), got.column("need").to_numpy()
        return bins, need

    # A score is at most the product of the two lengths, or what a long holds.
    longest = candidates.select(F.max(F.size("huge"))).first()[0]
    top = 63 if longest else min(63, int(np.ceil(np.log2(_bound(candidates) * _bound(queries) + 2))) + 1)
    shift, last = max(0, top - PASS_BITS), None
    bins, need = np.zeros(len(uids), np.int64), np.full(len(uids), k, np.int64)
    while True:
        bins, need = choose(histogram(shift, last, bins, need), need)
        if shift == 0:
            break
        shift, last = max(0, shift - PASS_BITS), shift
    state = spark.sparkContext.broadcast((bins, need, uids, qids))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kth, need, uids, qids = state.value
        for first, at, c, s, own in _matrices(batches, [Block(r) for r in held.value]):
            here = slice(first + at.start, first + at.stop)
            live = (need[here] > 0)[:, None] & ~own
            q, col = np.nonzero(live & (s > kth[here][:, None]))
            eq, ecol = np.nonzero(live & (s == kth[here][:, None]))
            # Of equal scores the smallest ids of this block, as many as are needed in all.
            o = np.lexsort((c.ids[ecol], eq))
            eq, ecol = eq[o], ecol[o]
            begin = np.flatnonzero(np.append(True, eq[1:] != eq[:-1])) if len(eq) else np.empty(0, np.int64)
            nth = np.arange(len(eq)) - np.repeat(begin, np.diff(np.append(begin, len(eq))))
            keep = nth < need[here][eq]
            q, col = np.concatenate([q, eq[keep]]), np.concatenate([col, ecol[keep]])
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(uids[here][q]), pa.array(qids[here][q]), pa.array(c.ids[col]), pa.array(s[q, col])], names=["uid", "query_id", "vec_id", "score"])

    return cut(candidates.mapInArrow(emit, "uid long, query_id long, vec_id long, score long"))


def _bound(packed: DataFrame) -> float:
    """The largest length of a packed row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = [float(np.sqrt((Block(r).data ** 2).sum(axis=1).max())) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(most, pa.float64())], names=["x"])

    return packed.mapInArrow(run, "x double").agg(F.max("x")).first()[0] or 0.0
