"""Best-fit packing: patterns of few documents, fitted to the histogram of lengths.

A sequence holds at most CAPACITY tokens. The histogram of piece lengths has at most
CAPACITY entries, whatever the corpus. On the driver, patterns are enumerated that fill a
sequence exactly: up to three different lengths, two of which may repeat (so that short
documents have patterns too). Non-negative least squares fits how often each pattern is to
be repeated so that the histogram is used up; the repeats are rounded and, where lengths
remain, fitted again, at last with patterns that leave a few tokens free. What
then remains is packed by best fit, longest first, on counts. The plan (a few thousand
patterns with repeats) is bounded by the number of lengths, not of documents.

Each piece gets its place from its ordinal among the pieces of its length, and ordinals
come from a range-sort by (length, hash), so a length that a third of all pieces share is
still dealt out evenly.

Ids are those of byte_bpe_50k.json as ``tokenizers`` loads it, its added token found inside
texts. They are made from the same vocabulary's ranks, at a quarter of the time.

Defined results: a null or empty text has the end token alone; rows that repeat are
packed one by one; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.ordering import running
from quillspark.shared import cut

CAPACITY = 1024
END = 2
#: The vocabulary as ranks; it gives the same ids as the tokenizers file of the same name.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The added token of the tokenizers file, which it finds inside texts as it is loaded.
ADDED = {"<|endoftext|>": 50256}
#: Patterns of three different lengths stand on a grid of this many tokens.
GRID = 16
#: Tokens that the patterns of the last fit may leave free.
SLACK = 8
#: The pattern of the published pre-tokenizer, with possessive repeats; same pieces.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

_encoders: dict[str, object] = {}


def encoder(vocabulary: str = VOCABULARY):
    """The encoder of a vocabulary file of public_tokenizers (or a path), once for each worker."""
    if vocabulary not in _encoders:
        import base64
        import os

        import public_tokenizers
        import tiktoken

        path = vocabulary if os.path.sep in vocabulary else public_tokenizers.path(vocabulary)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[vocabulary] = tiktoken.Encoding(vocabulary, pat_str=PIECES, mergeable_ranks=ranks, special_tokens=ADDED)
    return _encoders[vocabulary]


def token_ids(text: str | None, vocabulary: str = VOCABULARY) -> np.ndarray:
    """The ids of a text, little-endian, with the end token."""
    ids = encoder(vocabulary).encode(text, allowed_special="all") if text else []
    return np.array([*ids, END], dtype="<u4")


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first, which has the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): one row for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, numbers = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = token_ids(t, vocabulary)
                for k, (start, n) in enumerate(cuts(len(ids), capacity)):
                    rows.append(i)
                    numbers.append((k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            k, start, n, crc = (list(x) for x in zip(*numbers, strict=True)) if numbers else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def enumerate_patterns(counts: np.ndarray, capacity: int = CAPACITY, slack: int = 0, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, repeats), a row for each pattern with three places; unused places are 0.

    ``counts`` is the histogram. Patterns of one or two lengths repeat them as often as they
    fit (and occur); patterns of three different lengths have each once, the two longer ones
    on the grid where there are many lengths. All leave at most ``slack`` tokens free."""
    lengths = np.flatnonzero(counts)
    lengths = lengths[lengths > 0]
    # All (length, times) by what they take together.
    runs: dict[int, list[tuple[int, int]]] = {}
    for n in lengths.tolist():
        for times in range(1, min(capacity // n, int(counts[n])) + 1):
            runs.setdefault(n * times, []).append((n, times))
    found: list[tuple[int, int, int, int, int, int]] = []
    for full in range(capacity - slack, capacity + 1):
        found += [(n, 0, 0, k, 0, 0) for n, k in runs.get(full, [])]
        for taken, some in runs.items():
            found += [(n, m, 0, k, j, 0) for n, k in some for m, j in runs.get(full - taken, []) if m < n]
    have = counts > 0
    on_grid = [n for n in lengths[::-1].tolist() if n % grid == 0 or len(lengths) <= capacity // grid]
    for a in on_grid:
        for b in on_grid:
            c = capacity - a - b
            if b < a and 0 < c < b and have[c]:
                found.append((a, b, c, 1, 1, 1))
    # Two runs, one of which takes a multiple of a sixteenth, and a third length beside them.
    for full in range(capacity // 16, capacity, max(1, capacity // 16)):
        for n, k in runs.get(full, [])[-1:]:
            for taken, some in runs.items():
                m, j = some[-1]
                c = capacity - full - taken
                if 0 < c and have[c] and len({n, m, c}) == 3:
                    found.append((n, m, c, k, j, 1))
    both = np.array(found, np.int64).reshape(-1, 6)
    return both[:, :3], both[:, 3:]


def nnls(patterns: np.ndarray, times: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeats x >= 0 that minimise the squared distance of the lengths used from the
    histogram, by accelerated projected gradients. Each length weighs as its tokens do, and
    relative to its count, so that rare lengths count too."""
    if not len(patterns):
        return np.zeros(0)
    size = len(histogram)
    weight = np.arange(size) / size / np.maximum(histogram, 1.0)
    flat, often = patterns.ravel(), times.astype(float)

    def use(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, (x[:, None] * often).ravel(), size)

    def slope(x: np.ndarray) -> np.ndarray:
        return ((weight * (use(x) - histogram))[patterns] * often).sum(axis=1)

    # A diagonal bound of the curvature: for each pattern the sum of its rows' row sums.
    reach = weight * use(often.sum(axis=1))
    step = 1.0 / np.maximum((reach[patterns] * often).sum(axis=1), 1e-12)
    x = np.zeros(len(patterns))
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * slope(y))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def fitted(left: np.ndarray, capacity: int, slack: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with their rounded repeats; takes what they use from ``left``.

    Repeats are rounded down; then, by falling fraction, up, as long as the lengths last."""
    patterns, times = enumerate_patterns(left, capacity, slack)
    x = nnls(patterns, times, left.astype(float))
    down = np.floor(x + 1e-6).astype(np.int64)
    chosen = np.zeros(len(x), np.int64)

    def take(k: int, most: int) -> None:
        used = times[k] > 0
        kinds, each = patterns[k][used], times[k][used]
        n = int(min(most, (left[kinds] // each).min()))
        left[kinds] -= n * each
        chosen[k] += n

    for k in np.argsort(-down, kind="stable"):
        if down[k] <= 0:
            break
        take(k, down[k])
    part = np.where(x > 1e-6, x - down, 0.0)
    for k in np.argsort(-part, kind="stable"):
        if part[k] <= 0:
            break
        take(k, 1)
    return [(tuple(np.repeat(patterns[k], times[k]).tolist()), int(chosen[k])) for k in np.flatnonzero(chosen)]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of all sequences; every length is used as often as it occurs."""
    left = np.zeros(capacity + 1, np.int64)
    for n, count in histogram.items():
        left[n] += count
    out: list[tuple[tuple[int, ...], int]] = []
    for slack in (0, 0, 0, SLACK, SLACK):
        out += fitted(left, capacity, slack)
    return out + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of what the patterns leave over."""
    # Best fit, longest first, on counts: open[room] has (lengths, how many such sequences).
    open_: dict[int, list[list]] = {}
    done: list[tuple[tuple[int, ...], int]] = []
    for n in range(capacity, 0, -1):
        count = int(left[n])
        while count:
            room = next((r for r in range(n, capacity) if open_.get(r)), None)
            if room is None:
                # As many of the length as fit stand in new sequences together.
                fit = min(capacity // n, count)
                times = count // fit
                open_.setdefault(capacity - n * fit, []).append([(n,) * fit, times])
                count -= times * fit
                continue
            kind = open_[room][-1]
            times = min(count, kind[1])
            kind[1] -= times
            if not kind[1]:
                open_[room].pop()
            open_.setdefault(room - n, []).append([(*kind[0], n), times])
            count -= times
    for kinds in open_.values():
        done += [(tuple(p), times) for p, times in kinds]
    return done


def places(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ordinals, and for each the first sequence, its step and the offset."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for lengths, times in planned:
        offset = 0
        for n in lengths:
            rows.setdefault(n, []).append((first, times, offset))
            offset += n
        first += times
    out = {}
    for n, parts in rows.items():
        sequence, times, offset = (np.array(x, np.int64) for x in zip(*parts, strict=True))
        begin = np.concatenate(([0], np.cumsum(times)[:-1]))
        out[n] = (begin, sequence, times, offset)
    return out


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut_up = cut(pieces(df, doc_id, text, capacity, vocabulary))  # texts are encoded once
    histogram = {r["length"]: r["count"] for r in cut_up.groupBy("length").count().collect()}  # at most CAPACITY rows
    where = places(plan(histogram, capacity))
    keyed = cut_up.withColumn("__key", F.xxhash64("doc_id", "piece", "ids_crc32"))
    ordered = running(keyed, "length", ["__key"], "__nth").drop("__key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, nth = b.column("length").to_numpy(), b.column("__nth").to_numpy()
            sequence, offset = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                begin, first, _, at = where[int(n)]
                k = np.searchsorted(begin, nth[rows], side="right") - 1
                sequence[rows] = first[k] + nth[rows] - begin[k]
                offset[rows] = at[k]
            keep = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = df.schema[doc_id].dataType.simpleString()
    return ordered.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
