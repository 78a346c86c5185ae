"""License scans: MinHash bands over overlapping windows find templates, shingles verify.

A template is indexed at every offset by windows of WINDOW shingles; documents are read in
windows of the same size, STRIDE apart, so any copied stretch of WINDOW + STRIDE shingles
holds one that is in the index. With 8 bands of 2 rows a window at Jaccard similarity j is
found with probability 1 - (1 - j^2)^8: 0.9997 at 0.8. Each hit says which template and
where; there the share of the template's five-word shingles that the text holds is counted
exactly, on words, and a match needs 0.8 of them. Where no single place has enough, as
foreign words part the copy, the places found next to one another count together.

Notices that have fewer shingles than two windows and a stride can't be met by windows. A
rule of their own finds them: each shingle of a notice is looked up (a window of one
shingle, whose MinHash is itself), so that none is missed; a notice of fewer than five
words is one shingle of all its words. They are verified like other templates.

Words are lower-cased letters and digits with inner dots, hyphens and apostrophes, so
punctuation and line breaks don't matter.

Defined results: a null or empty text matches nothing; a template without a word matches
nothing; rows that repeat are scanned one by one; an empty table gives no rows. Of matches
that overlap, the one of which most shingles are there stays, then the tightest, then the
first by name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.license_texts import TEMPLATES

SHINGLE, SHARE = 5, 0.8
WINDOW, STRIDE, BANDS, ROWS = 8, 4, 8, 2
#: Templates of fewer shingles are notices, looked up shingle by shingle.
SHORT = 2 * WINDOW + STRIDE
WORD = re.compile(rb"[a-z0-9\x80-\xff]+(?:[.\-'][a-z0-9\x80-\xff]+)*")
PRIME = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * PRIME
    return x ^ (x >> np.uint64(29))


def shingle_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    n = len(codes) - size + 1
    h = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size if n > 0 else 0):
            h = h * np.uint64(0x100000001B3) + _mixed(codes[k : k + n].astype(np.uint64) + np.uint64(1))
        return _mixed(h)


def bands(h: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, band keys: one row for each window) of windows of WINDOW shingles."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty((0, BANDS), np.uint64)
    at = np.arange(0, n, stride)
    keys = np.zeros((len(at), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for p in range(BANDS * ROWS):
            x = _mixed(h ^ (np.uint64(p + 1) * np.uint64(0xC2B2AE3D27D4EB4F)))
            width = 1
            while width < WINDOW:
                x = np.minimum(x[:-width], x[width:])
                width *= 2
            keys[:, p // ROWS] = keys[:, p // ROWS] * PRIME + x[at]
        return at, _mixed(keys + np.arange(BANDS, dtype=np.uint64))


class Index:
    """Notices by their single shingles, other templates by the bands of their windows."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.shingles: list[list[tuple[bytes, ...]]] = []
        single: dict[int, list[tuple[int, int, int]]] = {}
        banded: list[tuple[int, int, int]] = []
        for t, name in enumerate(self.names):
            w = words(templates[name].encode())
            size = min(SHINGLE, len(w))
            self.shingles.append([tuple(w[k : k + size]) for k in range(len(w) - size + 1)] if w else [])
            if not w:
                continue
            h = shingle_hashes(np.array([zlib.crc32(x) for x in w], np.uint32), size)
            if len(h) < SHORT:
                single.setdefault(size, []).extend((int(x), t, k) for k, x in enumerate(h))
            else:
                at, keys = bands(h, 1)
                banded += [(int(x), t, int(k)) for k, row in zip(at, keys, strict=True) for x in row]
        self.single = {size: self._table(rows) for size, rows in single.items()}
        self.banded = self._table(banded)

    @staticmethod
    def _table(rows: list[tuple[int, int, int]]) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]]]:
        found: dict[int, list[tuple[int, int]]] = {}
        for key, t, k in rows:
            found.setdefault(key, []).append((t, k))
        return np.array(sorted(found), np.uint64), found

    @staticmethod
    def _hits(keys: np.ndarray, table: tuple[np.ndarray, dict]) -> np.ndarray:
        known = table[0]
        if not len(known) or not len(keys):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.flatnonzero(known[at] == keys)

    def places(self, codes: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """By word place: the templates found there and where in them."""
        out: dict[int, list[tuple[int, int]]] = {}
        for size, table in self.single.items():
            h = shingle_hashes(codes, size)
            for i in self._hits(h, table):
                out.setdefault(int(i), []).extend(table[1][int(h[i])])
        at, keys = bands(shingle_hashes(codes, SHINGLE), STRIDE)
        flat = keys.ravel()
        for i in self._hits(flat, self.banded):
            out.setdefault(int(at[i // BANDS]), []).extend(self.banded[1][int(flat[i])])
        return out

    def _judge(self, w: list[bytes], t: int, lo: int, hi: int) -> tuple[float, int, int]:
        """(share, first word, stop) of template t among the shingles from lo to hi of a text."""
        template = self.shingles[t]
        need, size = set(template), len(template[0])
        here = [tuple(w[k : k + size]) for k in range(max(0, lo), max(0, lo, min(hi, len(w) - size + 1)))]
        hit = [k for k, s in enumerate(here) if s in need]
        if not hit:
            return 0.0, 0, 0
        return len({here[k] for k in hit}) / len(need), max(0, lo) + hit[0], max(0, lo) + hit[-1] + size

    def matches(self, w: list[bytes], found: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(name, first word, stop, share) of the verified matches among (place, template, offset)."""
        begins: dict[int, set[int]] = {}
        for place, t, offset in found:
            begins.setdefault(t, set()).add(place - offset)
        kept: dict[tuple[int, int], tuple] = {}

        def keep(t: int, *bounds: tuple[int, int]) -> bool:
            share, start, stop = max((self._judge(w, t, lo, hi) for lo, hi in bounds), key=lambda m: m[0])
            if share >= SHARE:
                kept[t, start] = max(kept.get((t, start), (0.0, 0)), (share, start - stop, t, start, stop))
            return share >= SHARE

        for t, some in begins.items():
            n = len(self.shingles[t])
            slack, left = n // 4, []
            for begin in sorted(some):
                # As it stands, or else with room for words more and less.
                if not keep(t, (begin, begin + n), (begin - slack, begin + n + slack)):
                    left.append(begin)
            # Places that fail alone and lie within a template's length of one another.
            first = 0
            for k in range(1, len(left) + 1):
                if k == len(left) or left[k] - left[k - 1] > n:
                    if k - first > 1:
                        keep(t, (left[first] - slack, left[k - 1] + n + slack))
                    first = k
        out, taken = [], []
        for share, _, t, start, stop in sorted(kept.values(), key=lambda m: (-round(m[0] * len(set(self.shingles[m[2]]))), -m[1], self.names[m[2]], m[3])):
            if all(stop <= a or start >= b for a, b in taken):
                taken.append((start, stop))
                out.append((self.names[t], start, stop, share))
        return sorted(out, key=lambda m: m[1])


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, start, stop, share): one row for each match; places count words."""
    chosen = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(chosen)
        for b in batches:
            rows, out = [], []
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                texts = [words(t) for t in part.column(1).to_pylist()]
                # End to end; at least WINDOW words that never match keep documents apart, and
                # each begins at a multiple of STRIDE, so that its windows don't depend on others.
                room = np.array([len(w) + WINDOW for w in texts], np.int64)
                ends = np.cumsum(room + -room % STRIDE)
                starts = np.concatenate(([0], ends[:-1]))
                codes = np.zeros(int(ends[-1]), np.uint32)
                for s, w in zip(starts, texts, strict=True):
                    codes[s : s + len(w)] = np.fromiter(map(zlib.crc32, w), np.uint32, len(w))
                found: dict[int, list[tuple[int, int, int]]] = {}
                for place, hits in index.places(codes).items():
                    d = int(np.searchsorted(starts, place, side="right")) - 1
                    found.setdefault(d, []).extend((place - int(starts[d]), t, o) for t, o in hits)
                for d, hits in sorted(found.items()):
                    for m in index.matches(texts[d], hits):
                        rows.append(k + d)
                        out.append(m)
            if rows:
                cols = [pa.array(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), *cols], names=["doc_id", "license", "start", "stop", "share"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, license string, start long, stop long, share double")
