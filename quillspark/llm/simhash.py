"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a word of 64 bits within r of both.
So each distinct fingerprint emits its ball of radius r = 2, balls are dealt out by their
members, and fingerprints that emit the same member are linked (and verified).

A ball of 2,081 members isn't shuffled member by member. The bits are split into m low
ones, which name a cell, and the others. A fingerprint goes to each cell that its ball
reaches (1 + m + m(m-1)/2 of them) and the cell's task makes the members that lie in
it, with the flips that are left. All members of a cell share its low bits, so every
collision is found in one place. Fingerprints that share a member are within 2r of each
other, so each is linked to the smallest of them and a group costs as many links as it
has fingerprints. Equal fingerprints are one node from the start.

Defined results: a null or empty text, or one without a word, has fingerprint zero and is
linked like any other; a null doc_id has a component but is never its name; rows that
repeat are reported one by one; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.components import components
from quillspark.shared import cut, shuffle_partitions

WORDS = 4
SEED = 42
RADIUS = 2
#: Members that a task holds at once, and fingerprint copies for each partition.
AT_ONCE = 2_000_000
COPIES = 1_000_000


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The fingerprint of a UTF-8 text; bytes are lower-cased and split in ASCII only."""
    parts = text.lower().split()
    n = len(parts)
    if not n:
        return 0
    joined = b" ".join(parts)
    if n <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], dtype=">u8")
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        votes += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tag, fp): one row for each row; the tag is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(fingerprint(t or b"")) for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], names=["doc_id", "tag", "fp"])

    kind = df.schema[doc_id].dataType.simpleString()
    t = F.col(text).cast("string")
    return df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(t).alias("tag"), t.alias("text")).mapInArrow(run, f"doc_id {kind}, tag long, fp long")


def flips(bits: list[int], most: int) -> np.ndarray:
    """Masks of at most ``most`` (0 to 2) of the bits."""
    one = [1 << b for b in bits] if most >= 1 else []
    two = [(1 << a) | (1 << b) for k, a in enumerate(bits) for b in bits[:k]] if most >= 2 else []
    return np.array([0, *one, *two], dtype=np.uint64)


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links (a, b): each linked value with the smallest of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = nodes != nodes[root]
    return nodes[other], nodes[root][other]


def _expand(low: np.ndarray, fp: np.ndarray, used: np.ndarray, m: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints in cells of m bits, dealt on to the cells of ``to`` bits that their balls
    reach with the flips that are left: (cell, fingerprint, flips used)."""
    cell = np.uint64((1 << to) - 1) ^ np.uint64((1 << m) - 1)
    lows, fps, useds = [], [], []
    for u in range(RADIUS + 1):
        mine = used == u
        masks = flips(list(range(m, to)), RADIUS - u)
        lows.append(((low[mine] | (fp[mine] & cell))[:, None] ^ masks[None, :]).ravel())
        fps.append(np.repeat(fp[mine], len(masks)))
        useds.append(np.tile(np.bitwise_count(masks).astype(np.int64) + u, int(mine.sum())))
    return np.concatenate(lows), np.concatenate(fps), np.concatenate(useds)


def _collide(low: np.ndarray, fp: np.ndarray, m: int, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints that share a member in the cells ``low`` of m bits.

    Whole cells go together up to AT_ONCE members. A larger cell is dealt on to smaller
    ones, of more bits, in which each member is still made once."""
    cell = np.uint64((1 << m) - 1)
    if used is None:
        used = np.bitwise_count((fp & cell) ^ low).astype(np.int64)
    masks = [flips(list(range(m, 64)), RADIUS - u) for u in range(RADIUS + 1)]
    sizes = np.array([len(x) for x in masks])[used]
    order = np.argsort(low, kind="stable")
    low, fp, used, sizes = low[order], fp[order], used[order], sizes[order]
    left, right = [], []

    def members(at: slice) -> None:
        values, owners = [], []
        for u in range(RADIUS + 1):
            mine = np.flatnonzero(used[at] == u) + at.start
            if len(mine):
                values.append((((fp[mine] & ~cell) | low[mine])[:, None] ^ masks[u][None, :]).ravel())
                owners.append(np.repeat(fp[mine], len(masks[u])))
        v, o = np.concatenate(values), np.concatenate(owners)
        s = np.sort(v)
        twice = s[1:][s[1:] == s[:-1]]
        if not len(twice):
            return
        twice = np.unique(twice)
        at_ = np.minimum(np.searchsorted(twice, v), len(twice) - 1)
        hit = twice[at_] == v
        group, o = at_[hit], o[hit]
        best = np.full(len(twice), np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(best, group, o)
        a, b = o, best[group]
        near = (a != b) & (np.bitwise_count(a ^ b) <= 2 * RADIUS)  # holds for all; verified nevertheless
        a, b = _roots(a[near], b[near])
        left.append(a)
        right.append(b)

    total = np.cumsum(sizes)
    edges = np.flatnonzero(np.append(low[1:] != low[:-1], True)) + 1
    start = begin = 0  # of the cells taken together; of the cell at hand
    for k, end in enumerate(edges):
        held = int(total[end - 1] - (total[begin - 1] if begin else 0))
        before = int(total[start - 1]) if start else 0
        if held > AT_ONCE and m < 60:
            if start < begin:
                members(slice(start, begin))
            at = slice(begin, end)
            a, b = _collide(*_roomy(low[at], fp[at], used[at], m, held))
            left.append(a)
            right.append(b)
            start = end
        elif k == len(edges) - 1 or total[edges[k + 1] - 1] - before > AT_ONCE:
            members(slice(start, end))
            start = end
        begin = end
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return _roots(np.concatenate(left), np.concatenate(right))


def _roomy(low: np.ndarray, fp: np.ndarray, used: np.ndarray, m: int, held: int) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """A cell of ``held`` members in cells of so many more bits that they should hold AT_ONCE each."""
    to = min(64, m + max(2, (held // AT_ONCE).bit_length()))
    a, b, u = _expand(low, fp, used, m, to)
    return a, b, to, u


def links(distinct: DataFrame, n: int) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``fp`` that connect all within 2 * RADIUS bits."""
    parts = max(shuffle_partitions(distinct.sparkSession), n * 64 // COPIES)
    m = min(24, max(6, (8 * parts - 1).bit_length()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, cell = flips(list(range(m)), RADIUS), np.uint64((1 << m) - 1)
        for b in batches:
            every = b.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(every), 10_000):
                fp = every[k : k + 10_000]
                low = ((fp & cell)[:, None] ^ masks[None, :]).ravel().astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(np.repeat(fp, len(masks)).view(np.int64))], names=["low", "fp"])

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, fp = [], []
        for b in batches:
            low.append(b.column(0).to_numpy().astype(np.uint64))
            fp.append(b.column(1).to_numpy().view(np.uint64))
        if low:
            a, b = _collide(np.concatenate(low), np.concatenate(fp), m)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    cells = distinct.select("fp").mapInArrow(spread, "low int, fp long").repartition(parts, "low")
    return cells.mapInArrow(collide, "a long, b long")


def link(fps: DataFrame) -> DataFrame:
    """``fps`` (doc_id, fp and more) with root, the component's fingerprint, and component_id."""
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(distinct, distinct.count()))
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = cut(named)
    # Cut, so that the join deals both sides anew and a large component's rows can be split.
    names = cut(named.groupBy("root").agg(F.min("least").alias("component_id")))
    of = cut(named.join(names, "root").select("fp", "root", "component_id"))
    return fps.join(of, "fp", "left")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    linked = link(cut(fingerprints(df, doc_id, text)))
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component one row, as it was: the smallest doc_id's (nulls last). Where that
    doc_id repeats in the component, the row with the smallest hash of its text stays; of
    rows with the same id and text any one, all but extra columns being equal."""
    ids = cut(link(cut(fingerprints(df, doc_id, text))).select("doc_id", "tag", "root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tag"))
    kept = ids.groupBy("root").agg(first.alias("first")).select(F.col("first.doc_id").alias("id"), F.col("first.tag").alias("tag"))
    times = ids.groupBy("doc_id", "tag").count().select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), "count")
    kept = cut(kept.join(times, F.col("id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t"))).select("id", "tag", "count"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(doc_id).alias("d"), F.xxhash64(F.col(text).cast("string")).alias("t"))
    on = F.col("d").eqNullSafe(F.col("id")) & (F.col("t") == F.col("tag"))
    out = rows.join(kept.where("count = 1"), on).select("row")
    several = kept.where("count > 1")
    if not several.isEmpty():
        # Rows that are the same in id and text: partial aggregates keep one of each.
        out = out.unionByName(rows.join(several, on).groupBy("d", "t").agg(F.first("row").alias("row")).select("row"))
    return out.select("row.*")
