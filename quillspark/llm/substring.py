"""Passages that repeat across documents, by collinear chaining of shared seeds.

Seeds are five-word shingles chosen by winnowing: of every WINDOW shingles in a row the
one with the smallest hash. A passage of 50 words that two documents share gives both
the same seeds (two at least). A seed that at most FEW documents have joins each of them
with each other; a seed of more documents joins each with the first and with the last that
has it (by a hash of the document). So a seed costs at most FEW anchors for each of its
occurrences at first; the pairs that this leaves out are tried later (see below).

For each pair of documents the anchors (place here, place there) are chained: both places
rise, and a chain pays for its gaps. The best predecessor comes from a Fenwick tree of
maxima over the ranks of the places there. Chains that can reach 50 words are aligned on
the words themselves (between rising matches of four words, so in time that hardly exceeds
their length), extended at both ends while that pays, and kept if at least MIN_WORDS long
and MIN_SAME alike. A chain that isn't alike enough as a whole, as its links lead over
foreign words, is kept in the parts that are.

A passage of a large group that neither the first nor the last document has as a whole
(one has its beginning, say, and another its end) would be missed. All of its seeds are
shared, though; where a document has such a run of shared seeds that no reported passage
shows, its windows of MIN_WORDS words are matched exactly, in whichever documents they are,
and whether those places are shown or not: all places that have the same seeds are looked
up. So no document is missed that repeats MIN_WORDS words of another word for word.

Edited passages that the first and the last document of their seeds don't show are found by
pairs of seeds: two that stand REACH apart or more and no farther than a chain links them, one
of more than FEW documents at least. All documents that have such a pair of seeds are parted in
classes: those whose passages show these words with the same documents are one. Any two
documents of different classes are chained with all seeds that they share. So two documents
with a chain that spans REACH words in both (there, no more than SLACK words more or less) are
either chained with each other or linked, at its words, through the passages of their class.

Defined results: a null text has no words; rows that are the same document with the same
id are one document; texts shorter than a shingle have no seed; an empty table gives no
rows.
"""

from __future__ import annotations

import difflib
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.shared import cut, shuffle_partitions, text_or_empty, written

SHINGLE, WINDOW = 5, 16
MIN_WORDS, MIN_SAME = 50, 0.8
#: What one word of gap costs, on either side; a seed earns its five words.
GAP = 0.1
MARGIN = 64
#: How far apart the first and the last seed of a passage of MIN_WORDS are at least, and how
#: far beyond its first seed all seeds still belong to it.
REACH = MIN_WORDS - SHINGLE - 2 * (WINDOW - 1)
FAR = MIN_WORDS - SHINGLE - (WINDOW - 1)
#: How many words a passage of MIN_WORDS may have on one side only.
SLACK = round(MIN_WORDS * (1 - MIN_SAME))
#: A seed that so many documents have at most joins all of them, two by two.
FEW = 6
#: How often one of each class is tried with few others before all pairs are.
TURNS = 1
#: Of at most so many documents the keys (eight bytes each) may be sent to all executors.
KEYS = 2_000_000
#: Words that match in a row between which an alignment is made, and the largest gap (words
#: here times words there) that is aligned word by word.
MATCH, GAP_CELLS = 4, 4096
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
PRIME = np.uint64(0x9E3779B97F4A7C15)


def word_codes(text: bytes | None) -> np.ndarray:
    """A 32-bit code for each word; A to Z are lower-cased, ASCII white space divides."""
    words = (text or b"").lower().split()
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * PRIME
    return x ^ (x >> np.uint64(29))


def seeds(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, place, hash) of the seeds of many documents at once.

    Documents are laid end to end with room between them that no shingle takes."""
    room = WINDOW + SHINGLE
    starts = np.cumsum([0, *(len(c) + room for c in codes)])
    words = np.zeros(starts[-1] + room, np.uint64)
    free = np.zeros(len(words), bool)
    owner = np.zeros(len(words), np.int32)
    for i, c in enumerate(codes):
        s = starts[i]
        words[s : s + len(c)] = c
        if len(c) >= SHINGLE:
            free[s : s + len(c) - SHINGLE + 1] = True
        owner[s : s + len(c)] = i
    n = len(words) - SHINGLE + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            h = h * np.uint64(0x100000001B3) + _mixed(words[k : k + n] + np.uint64(1))
        h = _mixed(h)
    h = np.where(free[:n], np.minimum(h, LAST - np.uint64(1)), LAST)
    low, at = h, np.arange(n, dtype=np.int64)
    width = 1
    while width < WINDOW:  # the smallest of 2, 4, 8, 16 in a row, the right one among equals
        a, b = low[:-width], low[width:]
        right = b <= a
        at = np.where(right, at[width:], at[:-width])
        low = np.where(right, b, a)
        width *= 2
    chosen = np.unique(at[low != LAST])
    doc = owner[chosen]
    return doc.astype(np.int64), chosen - starts[doc], h[chosen]


def chains(p: np.ndarray, q: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """Best chains of anchors (p, q), disjoint: (first p, last p, first q, last q, score).

    score(j) = SHINGLE + max(0, max over p_i < p_j, q_i < q_j of score(i) - GAP * distance).
    """
    order = np.lexsort((q, p))
    p, q = p[order].tolist(), q[order].tolist()
    values = sorted(set(q))
    rank = {v: k + 1 for k, v in enumerate(values)}
    size, n = len(values), len(p)
    best: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)
    score, back = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        end = i
        while end < n and p[end] == p[i]:
            end += 1
        for j in range(i, end):  # all with this p ask before any of them is entered
            k, found = rank[q[j]] - 1, (-1e18, -1)
            while k > 0:
                found = max(found, best[k])
                k -= k & -k
            gain = found[0] - GAP * (p[j] + q[j])
            score[j] = SHINGLE + max(0.0, gain)
            back[j] = found[1] if gain > 0 else -1
        for j in range(i, end):
            entry, k = (score[j] + GAP * (p[j] + q[j]), j), rank[q[j]]
            while k <= size:
                best[k] = max(best[k], entry)
                k += k & -k
        i = end
    used, out = [False] * n, []
    for j in sorted(range(n), key=lambda x: (-score[x], p[x], q[x])):
        if used[j]:
            continue
        k, first = j, j
        while k >= 0 and not used[k]:
            used[k], first = True, k
            k = back[k]
        out.append((p[first], p[j], q[first], q[j], score[j]))
    return out


def _reach(same: np.ndarray) -> int:
    """How far an extension goes: the best prefix, given up once 12 below the best."""
    if not len(same):
        return 0
    s = np.cumsum(np.where(same, 1, -2))
    top = np.maximum.accumulate(np.maximum(s, 0))
    stop = np.flatnonzero(top - s > 12)
    s = s[: stop[0]] if len(stop) else s
    return int(s.argmax()) + 1 if len(s) and s.max() > 0 else 0


def align(a: np.ndarray, b: np.ndarray, pa_: tuple[int, int], pb: tuple[int, int]) -> list[tuple[int, int, int, int, float]]:
    """The passages around a chain (its places in a and b): bounds in a and in b, and the share of like words.

    The chain as a whole if it is MIN_SAME alike, otherwise its parts that are."""
    (a0, a1), (b0, b1) = pa_, pb
    blocks = matched(a[a0:a1], b[b0:b1])
    same = sum(n for _, _, n in blocks)
    n = min(len(a) - a1, len(b) - b1)
    right = _reach(a[a1 : a1 + n] == b[b1 : b1 + n])
    m = min(a0, b0)
    left = _reach((a[a0 - m : a0] == b[b0 - m : b0])[::-1])
    after, before = a[a1 : a1 + right] == b[b1 : b1 + right], a[a0 - left : a0] == b[b0 - left : b0]
    share = (same + int(after.sum()) + int(before.sum())) / max(a1 - a0 + left + right, b1 - b0 + left + right)
    if share >= MIN_SAME:
        found = [(a0 - left, a1 + right, b0 - left, b1 + right, share)]
    else:
        core = [(a0 + x, b0 + y, n) for x, y, n in blocks]
        found = parts([*_equal(before, a0 - left, b0 - left), *core, *_equal(after, a1, b1)])
    return [x for x in found if min(x[1] - x[0], x[3] - x[2]) >= MIN_WORDS]


def _rising(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of pairs with rising i, the numbers of the most whose j rises too."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(j)
    for k, y in enumerate(j.tolist()):
        at = bisect_left(tails, y)
        back[k] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(y)
            ends.append(k)
        else:
            tails[at], ends[at] = y, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return np.array(out[::-1], np.int64)


def matched(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """(place in a, place in b, words) of like runs, rising in both, of two texts that begin and end alike."""
    if len(a) == len(b) and 10 * int((a == b).sum()) >= 9 * len(a):
        return _equal(a == b, 0, 0)
    if len(a) * len(b) <= GAP_CELLS or min(len(a), len(b)) < 2 * MATCH:
        return [(x.a, x.b, x.size) for x in difflib.SequenceMatcher(None, a.tolist(), b.tolist(), autojunk=False).get_matching_blocks() if x.size]

    def grams(x: np.ndarray) -> np.ndarray:
        h = np.zeros(len(x) - MATCH + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(MATCH):
                h = h * np.uint64(0x100000001B3) + _mixed(x[k : k + len(h)].astype(np.uint64) + np.uint64(1))
        return h

    # Runs of MATCH words that each side has once, and the ends.
    sides = [np.unique(grams(x), return_index=True, return_counts=True) for x in (a, b)]
    (u, ui, un), (v, vi, vn) = sides
    _, x, y = np.intersect1d(u[un == 1], v[vn == 1], assume_unique=True, return_indices=True)
    i, j = ui[un == 1][x], vi[vn == 1][y]
    inside = (i > 0) & (j > 0) & (i < len(a) - MATCH) & (j < len(b) - MATCH)
    i, j = i[inside], j[inside]
    order = np.argsort(i)
    i, j = i[order], j[order]
    best = _rising(i, j)
    i, j = np.concatenate([[0], i[best], [len(a) - MATCH]]), np.concatenate([[0], j[best], [len(b) - MATCH]])
    edges = np.flatnonzero(np.diff(j - i)) + 1
    out: list[tuple[int, int, int]] = []
    at, bt = 0, 0  # up to where both are aligned
    for s, e in pairwise([0, *edges, len(i)]):
        first, last, shift = max(int(i[s]), at, bt - int(j[s] - i[s])), int(i[e - 1]) + MATCH, int(j[s] - i[s])
        if last <= first:
            continue
        ga, gb = a[at:first], b[bt : first + shift]
        if len(ga) and len(gb):
            if len(ga) * len(gb) <= GAP_CELLS:
                out += [(at + x.a, bt + x.b, x.size) for x in difflib.SequenceMatcher(None, ga.tolist(), gb.tolist(), autojunk=False).get_matching_blocks() if x.size]
            else:  # a long gap: only what goes on alike from either end
                n = min(len(ga), len(gb))
                fore = int(np.append(ga[:n] != gb[:n], True).argmax())
                back = min(int(np.append((ga[-n:] != gb[-n:])[::-1], True).argmax()), n - fore)
                out += [(at, bt, fore)] * (fore > 0) + [(first - back, first + shift - back, back)] * (back > 0)
        out += _equal(a[first:last] == b[first + shift : last + shift], first, first + shift)
        at, bt = last, last + shift
    return out


def _equal(same: np.ndarray, a: int, b: int) -> list[tuple[int, int, int]]:
    """(place in a, place in b, words) of the runs of like words of a stretch that begins at a and b."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.astype(np.int8), [0]))))
    return [(a + int(s), b + int(s), int(e - s)) for s, e in zip(edges[::2], edges[1::2], strict=True)]


def parts(blocks: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, float]]:
    """What of an alignment (its runs of like words) is MIN_SAME alike over MIN_WORDS.

    From each run the farthest run is sought up to which both sides are alike enough. Of
    these stretches as few are kept as show every word of all of them; they may overlap."""
    if not blocks:
        return []
    a, b, n = np.array(blocks, np.int64).T
    total = np.concatenate(([0], np.cumsum(n)))
    wide: list[tuple[int, int]] = []
    for i in range(len(n)):
        if wide and wide[-1][1] == len(n) - 1:
            break  # what begins here lies in the last one
        span = np.maximum(a[i:] + n[i:] - a[i], b[i:] + n[i:] - b[i])
        short = np.minimum(a[i:] + n[i:] - a[i], b[i:] + n[i:] - b[i])
        fit = np.flatnonzero((total[i + 1 :] - total[i] >= MIN_SAME * span) & (short >= MIN_WORDS))
        if len(fit) and (not wide or i + fit[-1] > wide[-1][1]):
            # The one before isn't needed if this one meets the one before that.
            if len(wide) > 1 and i <= wide[-2][1]:
                wide.pop()
            wide.append((i, i + int(fit[-1])))
    out = []
    for i, j in wide:
        x, y = int(a[j] + n[j]), int(b[j] + n[j])
        out.append((int(a[i]), x, int(b[i]), y, float((total[j + 1] - total[i]) / max(x - a[i], y - b[i]))))
    return out


def _keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = text_or_empty(F.col(text).cast("string"))
    return df.select(F.xxhash64(F.col(doc_id), t).alias("key"), F.col(doc_id).alias("doc_id"), t.cast("binary").alias("text"))


def passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, other_doc_id, start, stop, other_start, other_stop, same): word places, stops exclusive."""
    spark = df.sparkSession
    docs = _keyed(df, doc_id, text)

    def sow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                keys = part.column(0).to_numpy()
                # A text of fewer words has no passage.
                doc, at, h = seeds([c if len(c) >= MIN_WORDS else c[:0] for c in map(word_codes, part.column(1).to_pylist())])
                # The first place of a seed in its document may stand for it.
                order = np.lexsort((at, h, doc))
                first = np.ones(len(order), bool)
                first[1:] = (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1])
                lead = np.empty(len(order), bool)
                lead[order] = first
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(keys[doc]), pa.array(at.astype(np.int32)), pa.array(lead)], names=["h", "key", "at", "lead"])

    sown = written(docs.select("key", "text").mapInArrow(sow, "h long, key long, at int, lead boolean"))
    groups = sown.where("lead").groupBy("h").agg(F.count("*").alias("n"), F.min("key").alias("k0"), F.min_by("at", "key").alias("a0"), F.max("key").alias("k1"), F.max_by("at", "key").alias("a1"))
    groups = cut(groups.where("k0 <> k1"))
    # From here on only seeds count that two documents have.
    sown = written(sown.join(groups.select("h", (F.col("n") > FEW).alias("hot")), "h"))
    first = sown.where("lead").select("h", "key", "at")
    # The first document of a seed has no anchor there, but a mark: its seed is shared.
    own = F.col("key") == F.col("k0")
    ends = F.array(F.struct(F.when(~own, F.col("k0")).alias("other"), F.when(~own, F.col("a0")).alias("there")), F.when((F.col("n") > FEW) & ~own & (F.col("key") != F.col("k1")), F.struct(F.col("k1").alias("other"), F.col("a1").alias("there"))))
    to = F.filter(ends, lambda x: x.isNotNull())
    anchors = sown.join(groups, "h").select("key", "at", F.explode(to).alias("x")).select("key", "x.other", "at", "x.there")
    # Between the first document and each of the others stand at most FEW - 2 that a document joins too.
    between = first.join(groups.where(F.col("n").between(3, FEW)).select("h", "k0"), "h").where("key <> k0")
    # Dealt anew, few rows by then, so that adaptive execution may split a hot seed in the join.
    inner = between.repartition("h").groupBy("h").agg(F.array_sort(F.collect_set(F.struct("key", "at"))).alias("members"))
    here = F.posexplode("members").alias("nth", "m")
    pairs = inner.select("members", here).select(F.col("m.key").alias("key"), F.col("m.at").alias("at"), F.explode(F.slice("members", 1, F.col("nth"))).alias("x")).select("key", "at", F.col("x.key").alias("other"), F.col("x.at").alias("there"))
    anchors = anchors.unionByName(pairs)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: int, parts: list[tuple]) -> list[tuple]:
            at, other, there, mark = (np.concatenate(x) for x in zip(*parts, strict=True))
            out = []
            p, q, o = at[~mark], there[~mark], other[~mark]
            for s, e in pairwise([0, *np.flatnonzero(o[1:] != o[:-1]) + 1, len(o)]):
                if e > s and p[s:e].max() - p[s:e].min() >= REACH:
                    out += [(key, int(o[s]), *c[:4], None) for c in chains(p[s:e], q[s:e]) if c[1] - c[0] >= REACH]
            marks = np.unique(at)
            if any(len(r) > 1 and r[-1] - r[0] >= REACH for r in _runs(marks)):
                out.append((key, None, None, None, None, None, marks.astype("<i4").tobytes()))
            return out

        current, parts = None, []
        for b in batches:
            if not b.num_rows:
                continue
            key, at = b.column(0).to_numpy(), b.column(2).to_numpy().astype(np.int64)
            mark = b.column(1).is_null().to_numpy(zero_copy_only=False)
            other, there = b.column(1).fill_null(0).to_numpy(), b.column(3).fill_null(0).to_numpy().astype(np.int64)
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            out = []
            for s, e in zip(new, [*new[1:], len(key)], strict=True):
                if int(key[s]) != current:
                    if parts:
                        out += done(current, parts)
                    current, parts = int(key[s]), []
                parts.append((at[s:e], other[s:e], there[s:e], mark[s:e]))
            if out:
                yield rows(out)
        if parts and (out := done(current, parts)):
            yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 6 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "other", "p0", "p1", "q0", "q1", "marks"])

    # A document's first anchors are bounded by its length, FEW for each seed at most.
    def chained(anchors: DataFrame) -> DataFrame:
        dealt = anchors.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", "other", "at", "there")
        return cut(dealt.mapInArrow(chain, "key long, other long, p0 long, p1 long, q0 long, q1 long, marks binary"))

    every = chained(anchors)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [word_codes(t).astype("<u4").tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.binary())], names=["key", "doc_id", "codes"])

    # Rows that are the same document come once.
    kind = df.schema[doc_id].dataType.simpleString()
    coded = docs.mapInArrow(encode, f"key long, doc_id {kind}, codes binary")

    def coded_of(keys: DataFrame) -> DataFrame:
        """The words of some documents, so that the others are neither read as words nor dealt."""
        keys = cut(keys.distinct())
        return docs.join(F.broadcast(keys), "key", "left_semi").mapInArrow(encode, f"key long, doc_id {kind}, codes binary") if keys.count() <= KEYS else coded

    side = lambda n, key, a, b: F.struct(F.lit(n).alias("side"), F.col(key).alias("key"), F.col(a).alias("a"), F.col(b).alias("b"))
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, out = [], []
            p0, p1, q0, q1, xb, yb = (b.column(c).to_numpy() for c in ("p0", "p1", "q0", "q1", "xb", "yb"))
            xs, ys = b.column("xc").to_pylist(), b.column("yc").to_pylist()
            for i in range(b.num_rows):
                for a0, a1, b0, b1, same in align(np.frombuffer(xs[i], "<u4"), np.frombuffer(ys[i], "<u4"), (int(p0[i] - xb[i]), int(p1[i] + SHINGLE - xb[i])), (int(q0[i] - yb[i]), int(q1[i] + SHINGLE - yb[i]))):
                    keep.append(i)
                    out.append((a0 + int(xb[i]), a1 + int(xb[i]), b0 + int(yb[i]), b1 + int(yb[i]), same))
            if keep:
                at = pa.array(keep, pa.int64())
                cols = [pa.array(c) for c in zip(*out, strict=True)]
                names = ["key", "other", "doc_id", "other_doc_id"]
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in names], *cols], names=[*names, "start", "stop", "other_start", "other_stop", "same"])

    def aligned_(every: DataFrame, coded: DataFrame) -> DataFrame:
        found = every.where("other is not null")
        wanted = found.select(
            F.struct("key", "other", "p0", "q0", "p1", "q1").alias("chain"),
            F.explode(F.array(side(0, "key", "p0", "p1"), side(1, "other", "q0", "q1"))).alias("w"),
        ).select("chain", "w.*")
        begin = F.greatest(F.col("a") - MARGIN, F.lit(0))
        slices = wanted.join(coded, "key").select(
            "chain",
            "side",
            F.struct("doc_id", begin.cast("long").alias("begin"), F.substr("codes", (begin * 4 + 1).cast("int"), ((F.col("b") + SHINGLE + MARGIN - begin) * 4).cast("int")).alias("codes")).alias("s"),
        )
        both = slices.groupBy("chain").agg(F.first(F.when(F.col("side") == 0, F.col("s")), ignorenulls=True).alias("x"), F.first(F.when(F.col("side") == 1, F.col("s")), ignorenulls=True).alias("y"))
        flat = both.select("chain.key", "chain.other", "x.doc_id", F.col("y.doc_id").alias("other_doc_id"), "chain.p0", "chain.p1", "chain.q0", "chain.q1", F.col("x.begin").alias("xb"), F.col("x.codes").alias("xc"), F.col("y.begin").alias("yb"), F.col("y.codes").alias("yc"))
        return cut(flat.mapInArrow(finish, f"key long, other long, doc_id {kind}, other_doc_id {kind}, start long, stop long, other_start long, other_stop long, same double"))

    columns = ["doc_id", "other_doc_id", "start", "stop", "other_start", "other_stop", "same"]
    linked = aligned_(every, coded)
    need = cut(_open_places(every.where("other is null").select("key", "marks"), linked))
    if not need.isEmpty():
        met = cut(_met_places(need, sown))
        linked = cut(linked.unionByName(_exact(need, met, coded_of(need.select("key").unionByName(met.select("key"))), kind)))
    here, there = sown.select("h", "key", "at"), first.select("h", F.col("key").alias("other"), F.col("at").alias("there"))
    # First one of each class with one of the largest, so that few are apart when all pairs are tried.
    asked = tried = None
    for turn in range(TURNS + 1):
        met = cut(_apart(sown, linked, asked, turn, turn == TURNS))
        apart = met.where("other is not null").select("key", "other").distinct()
        apart = cut(apart if tried is None else apart.join(tried, ["key", "other"], "left_anti"))
        if met.isEmpty():
            break
        asked, tried = met.where("other is null").select("pair", "key"), apart if tried is None else tried.unionByName(apart)
        if apart.isEmpty():
            continue
        both = coded_of(apart.select("key").unionByName(apart.select(F.col("other").alias("key"))))
        rest = aligned_(chained(apart.join(here, "key").join(there, ["other", "h"]).select("key", "other", "at", "there")), both)
        # What a passage of the same documents shows already isn't said again.
        said = linked.select("key", "other", *columns[2:6])
        back = said.toDF("other", "key", "other_start", "other_stop", "start", "stop")
        x, y = rest.alias("x"), said.unionByName(back).alias("y")
        within = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "other")] + [F.col(f"x.{c}") >= F.col(f"y.{c}") for c in ("start", "other_start")] + [F.col(f"x.{c}") <= F.col(f"y.{c}") for c in ("stop", "other_stop")]
        linked = cut(linked.unionByName(x.join(y, within, "left_anti")))
    return linked.select(*columns)


def _runs(marks: np.ndarray) -> list[np.ndarray]:
    """Shared seeds that may be neighbours: winnowing leaves no more than WINDOW between them."""
    return np.split(marks, np.flatnonzero(np.diff(marks) > WINDOW) + 1)


def open_places(marks: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of starts at which a repeated passage of MIN_WORDS may begin that no span shows.

    All seeds of such a passage are shared. If its first is m, it begins at most WINDOW - 1
    before m and holds all seeds up to m + FAR; it is shown if one span has all of these."""
    s = np.array([x[0] for x in spans], np.int64)
    e = np.array([x[1] for x in spans], np.int64)
    out: list[tuple[int, int]] = []
    for run in _runs(marks):
        if len(run) < 2 or run[-1] - run[0] < REACH or ((s <= run[0]) & (e >= run[-1] + SHINGLE)).any():
            continue
        last = run[np.searchsorted(run, run + FAR, side="right") - 1]
        for m, n in zip(run.tolist(), last.tolist(), strict=True):
            if n - m < REACH or ((s <= m) & (e >= n + SHINGLE)).any():
                continue
            low = max(0, m - WINDOW + 1)
            if out and low <= out[-1][1] + 1:
                out[-1] = (out[-1][0], m)
            else:
                out.append((low, m))
    return out


def _open_places(marked: DataFrame, aligned: DataFrame) -> DataFrame:
    """(key, p0, p1) of the places that the aligned passages leave open."""
    spans = aligned.select("key", "start", "stop").unionByName(aligned.select(F.col("other").alias("key"), F.col("other_start").alias("start"), F.col("other_stop").alias("stop")))
    # Of the places that begin within a few words of one another the longest suffices, so a
    # document has fewer spans than words, however many others show it; what is left out only
    # leaves more to be matched exactly.
    longest = spans.groupBy("key", F.floor(F.col("start") / 8).alias("__at")).agg(F.max(F.struct("stop", "start")).alias("s"))
    spans = longest.groupBy("key").agg(F.collect_list(F.struct("s.start", "s.stop")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, marks, shown in zip(*(c.to_pylist() for c in b.columns), strict=True):
                places = open_places(np.frombuffer(marks, "<i4").astype(np.int64), [(x["start"], x["stop"]) for x in shown or []])
                out += [(key, *p) for p in places]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["key", "p0", "p1"])

    return marked.join(spans, "key", "left").select("key", "marks", "spans").mapInArrow(run, "key long, p0 long, p1 long")


def _met_places(need: DataFrame, sown: DataFrame) -> DataFrame:
    """(key, p0, p1) of the places, in all documents, that may hold a window of the open ones.

    Equal windows have a run of equal seeds; so these are the runs of the open places' seeds."""
    inside = (F.col("at") >= F.col("p0")) & (F.col("at") <= F.col("p1") + MIN_WORDS - SHINGLE)
    asked = cut(sown.join(need, "key").where(inside).select("h").distinct())
    marks = sown.join(asked, "h", "left_semi").groupBy("key").agg(F.array_sort(F.collect_set("at")).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(key, *p) for key, m in zip(*(c.to_pylist() for c in b.columns), strict=True) for p in open_places(np.array(m, np.int64), [])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["key", "p0", "p1"])

    return marks.mapInArrow(run, "key long, p0 long, p1 long")


def _exact(need: DataFrame, met: DataFrame, coded: DataFrame, kind: str) -> DataFrame:
    """Passages of MIN_WORDS and more, word for word the same, of which one place at least is open.

    The windows of MIN_WORDS words are hashed; equal windows are linked to the first
    document that has them, and windows that follow one another become one passage."""
    both = need.withColumn("open", F.lit(True)).unionByName(met.withColumn("open", F.lit(False)))
    part = F.substr("codes", (F.col("p0") * 4 + 1).cast("int"), ((F.col("p1") - F.col("p0") + MIN_WORDS) * 4).cast("int"))
    texts = both.join(coded, "key").select("key", "doc_id", "p0", part.alias("codes"), "open")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                words = np.frombuffer(b.column(3)[i].as_py(), "<u4").astype(np.uint64)
                n = len(words) - MIN_WORDS + 1
                if n <= 0:
                    continue
                h = np.zeros(n, np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(MIN_WORDS):
                        h = h * np.uint64(0x100000001B3) + _mixed(words[k : k + n] + np.uint64(1))
                # A window that comes again in the same text counts where it comes first.
                where = np.sort(np.unique(h, return_index=True)[1])
                h, at = h[where], int(b.column(2)[i].as_py()) + where
                one = pa.array([0] * len(where), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(0).slice(i, 1).take(one), b.column(1).slice(i, 1).take(one), pa.array(at), b.column(4).slice(i, 1).take(one)], names=["w", "key", "doc_id", "at", "open"])

    seen = texts.mapInArrow(run, f"w long, key long, doc_id {kind}, at long, open boolean")
    # Of a document's places an open one counts before those that are shown.
    seen = cut(seen.groupBy("w", "key", "doc_id").agg(F.coalesce(F.min(F.when(F.col("open"), F.col("at"))), F.min("at")).alias("at"), F.max("open").alias("open")))
    first = seen.groupBy("w").agg(F.min(F.struct("key", "at", "doc_id", "open")).alias("f"), F.max("key").alias("k1")).where("f.key <> k1")
    met = seen.join(cut(first), "w").where("key <> f.key and (open or f.open)").select("key", "doc_id", "at", F.col("f.key").alias("other"), F.col("f.doc_id").alias("other_doc_id"), (F.col("at") - F.col("f.at")).alias("shift"))
    nth = F.row_number().over(Window.partitionBy("key", "other", "shift").orderBy("at"))
    run_of = met.withColumn("run", F.col("at") - nth).groupBy("key", "other", "shift", "run")
    out = run_of.agg(F.first("doc_id").alias("doc_id"), F.first("other_doc_id").alias("other_doc_id"), F.min("at").alias("start"), (F.max("at") + MIN_WORDS).alias("stop"))
    return out.select("key", "other", "doc_id", "other_doc_id", "start", "stop", (F.col("start") - F.col("shift")).alias("other_start"), (F.col("stop") - F.col("shift")).alias("other_stop"), F.lit(1.0).alias("same"))


def seed_pairs(doc: np.ndarray, at: np.ndarray, h: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair of seeds, document number, first place, last place, whether these are the first of both seeds), of shared seeds ordered by document and place.

    The best chain reaches REACH words with one of its links. Before that link it has no more
    seeds than the document has different ones in REACH words (a chain has no seed twice, as
    there its first place counts), each earns SHINGLE at most, and the link costs GAP for each
    word of either side; a passage of MIN_WORDS may lack some words on one side."""
    place = doc * np.int64(1 << 32) + at
    n, end = len(at), np.searchsorted(place, place + REACH)
    order = np.lexsort((place, h, doc))
    again = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    before = np.full(n, -1)
    before[order[1:][again]] = order[:-1][again]
    first, clump = np.arange(n), np.zeros(n, np.int64)
    for k in range(int((end - first).max(initial=0))):
        nth = np.minimum(first + k, n - 1)
        clump += (first + k < end) & (before[nth] < first)
    far = REACH + (clump * SHINGLE / GAP / 2).astype(np.int64) + SLACK
    low, high = np.searchsorted(place, place + REACH), np.searchsorted(place, place + far, side="right")
    n = high - low
    i = np.repeat(np.arange(len(at)), n)
    j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + low[i]
    keep = hot[i] | hot[j]
    i, j = i[keep], j[keep]
    with np.errstate(over="ignore"):
        pair = _mixed(_mixed(h[i].view(np.uint64)) * PRIME + h[j].view(np.uint64)).view(np.int64)
    return pair, doc[i], at[i], at[j], (before[i] < 0) & (before[j] < 0)


def across(key: np.ndarray, low: np.ndarray, high: np.ndarray, lead: np.ndarray, near: np.ndarray, far: np.ndarray, every: bool = True, turn: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of documents that have a pair of seeds, each with two that show its words (a document may
    come several times), all pairs of different classes; otherwise one of each class with one of
    the largest and with any of another, others in each turn.

    The second of a pair has its seeds at their first places; if both have, it is the smaller.
    The seeds are near to far words apart; an edit changes that by SLACK at most."""
    names, number = np.unique(np.concatenate([key, low, high]), return_inverse=True)
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    n = len(key)
    number = number.tolist()
    for k in range(n):
        for other in (number[n + k], number[2 * n + k]):
            root[find(number[k])] = find(other)
    once = np.unique(key, return_index=True)[1]
    key, lead, near, far = key[once], lead[once], near[once], far[once]
    label = np.unique([find(number[k]) for k in once.tolist()], return_inverse=True)[1]
    n = len(key)
    if label.max() == 0:
        return

    def met(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fit = (label[x] != label[y]) & (lead[x] | lead[y]) & (near[x] <= far[y] + SLACK) & (far[x] >= near[y] - SLACK)
        x, y = x[fit], y[fit]
        swap = ~lead[x] | ((key[x] > key[y]) & lead[y])
        return np.where(swap, key[x], key[y]), np.where(swap, key[y], key[x])

    if not every:
        with np.errstate(over="ignore"):
            dice = _mixed(_mixed(key.view(np.uint64) + np.uint64(turn)))
        order = np.lexsort((dice, ~lead, label))
        own = order[np.append(True, label[order][1:] != label[order][:-1])]
        top = own[np.argmax(np.bincount(label))]
        own = own[own != top]
        yield met(own, np.full(len(own), top))
        if turn:
            yield met(own, (dice[own] % np.uint64(n)).astype(np.int64))
        return
    order = np.lexsort((~lead, label))
    label, key, lead, near, far = label[order], key[order], lead[order], near[order], far[order]
    leads = np.flatnonzero(lead)
    ends = np.searchsorted(label, label, side="right")
    for k in range(int(np.searchsorted(ends, n))):  # the last class has met all others
        others = np.arange(ends[k], n) if lead[k] else leads[np.searchsorted(leads, ends[k]) :]
        yield met(others, np.full(len(others), k))


def _apart(sown: DataFrame, linked: DataFrame, asked: DataFrame | None, turn: int, every: bool) -> DataFrame:
    """(pair, key, other): the documents that share the seeds of a link, one of them hot, and are in different classes.

    With another document: two to be chained (see across). With none: a document of such a
    group; only these are ``asked`` in the next turn, as classes only grow together."""
    full = asked is not None
    if full:
        keys = asked.select("key").distinct()
        sown, linked = sown.join(keys, "key", "left_semi"), linked.join(keys, "key", "left_semi")
    spans = linked.groupBy("key").agg(F.collect_list(F.struct("start", "stop", "other")).alias("spans"))
    marks = sown.groupBy("key").agg(F.array_sort(F.collect_set(F.struct(F.col("at").cast("long").alias("at"), "h", "hot"))).alias("marks"), F.max("hot").alias("any")).where("any").drop("any")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 200):
                b = whole.slice(s, 200)
                keys, marked, shown = b.column(0).to_numpy(), b.column(1), b.column(2).to_pylist()
                at, h, hot = marked.flatten().flatten()
                doc = np.repeat(np.arange(b.num_rows), np.diff(marked.offsets.to_numpy()))
                pair, doc, a0, a1, lead = seed_pairs(doc, at.to_numpy(), h.to_numpy(), hot.to_numpy(zero_copy_only=False))
                if not len(pair):
                    continue
                order = np.lexsort((pair, doc))
                pair, doc, a0, a1, lead = pair[order], doc[order], a0[order], a1[order], lead[order]
                low, high = keys[doc], keys[doc]
                bounds = np.searchsorted(doc, np.arange(b.num_rows + 1))
                # A pair of seeds that comes again in its document counts once.
                fresh = np.append(True, (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1]))
                new, nth = np.flatnonzero(fresh), np.cumsum(fresh) - 1
                more = []
                for d, found in enumerate(shown):
                    part = slice(bounds[d], bounds[d + 1])
                    for x in found or []:
                        inside = (a0[part] >= x["start"]) & (a1[part] + SHINGLE <= x["stop"])
                        low[part][inside] = np.minimum(low[part][inside], x["other"])
                        high[part][inside] = np.maximum(high[part][inside], x["other"])
                        if full:
                            which = np.unique(nth[part][inside])
                            more.append((which, np.full(len(which), x["other"], np.int64)))
                low, high = np.minimum.reduceat(low, new), np.maximum.reduceat(high, new)
                take = np.arange(len(new))
                if more:  # all that show its words, the smallest and the largest in the first row
                    which, other = (np.concatenate(x) for x in zip(*more, strict=True))
                    inner = (other != low[which]) & (other != high[which])
                    which, other = np.unique(np.stack([which[inner], other[inner]]), axis=1)
                    take, low, high = np.append(take, which), np.append(low, other), np.append(high, other)
                width = (a1 - a0).astype(np.int32)
                cols = [pair[new][take], keys[doc[new]][take], low, high, np.logical_or.reduceat(lead, new)[take], np.minimum.reduceat(width, new)[take], np.maximum.reduceat(width, new)[take]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["pair", "key", "low", "high", "lead", "near", "far"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple], groups: list[tuple]) -> Iterator[pa.RecordBatch]:
            names = ["pair", "key", "other"]
            if found:
                both = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(both), pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], names=names)
            if groups and not every:
                pair, key = (np.concatenate(x) for x in zip(*groups, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(key), pa.nulls(len(key), pa.int64())], names=names)

        left, found, groups, size = None, [], [], 0
        for b in (*batches, None):
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns] if b is not None else None
            if cols is not None:
                cols = [np.concatenate(x) for x in zip(left, cols, strict=True)] if left else cols
            else:
                cols = left
            if not cols or not len(cols[0]):
                continue
            pair, low, high, lead = cols[0], *cols[2:5]
            edges = np.append(np.flatnonzero(np.append(True, pair[1:] != pair[:-1])), len(pair))
            if b is not None:  # the last pair may go on
                left, edges = [c[edges[-2] :] for c in cols], edges[:-1]
            if len(edges) < 2:
                continue
            one = [np.minimum.reduceat(x[: edges[-1]], edges[:-1]) == np.maximum.reduceat(x[: edges[-1]], edges[:-1]) for x in (low, high)]
            some = np.logical_or.reduceat(lead[: edges[-1]], edges[:-1])
            for k in np.flatnonzero(some & ~(one[0] | one[1])).tolist():
                s, e = edges[k], edges[k + 1]
                apart = False
                for x in across(*(c[s:e] for c in cols[1:]), every, turn):
                    apart = True
                    found.append(x)
                    size += len(x[0])
                    if size > 200_000:
                        yield from out(found, groups)
                        found, groups, size = [], [], 0
                if apart and not every:
                    key = np.unique(cols[1][s:e])
                    groups.append((np.full(len(key), pair[s]), key))
                    size += len(key)
        yield from out(found, groups)

    nodes = marks.join(spans, "key", "left").select("key", "marks", "spans").mapInArrow(pairs, "pair long, key long, low long, high long, lead boolean, near int, far int")
    if full:
        nodes = nodes.join(asked, ["pair", "key"], "left_semi")
    dealt = nodes.repartition(shuffle_partitions(sown.sparkSession), "pair").sortWithinPartitions("pair")
    return dealt.mapInArrow(meet, "pair long, key long, other long")
