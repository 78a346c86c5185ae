"""Each operator against a plain version of its contract, on difficult tables."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import SCHEMA, words
from pyspark.sql import functions as F

from quillspark.llm import classifier, components, licenses, mixing, packing, pii, quality, sharding, simhash, substring, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# -- personal data ---------------------------------------------------------------------

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits: str) -> bool:
    double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in double) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 16 <= len(digits) <= 19 and luhn(digits or "0"),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TRICKY = ["a@b.com_foo@c.de x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4", "+1 (017) 555-7713 +49 2", "é😀 4111 1111 1111 1111, 5555-5555 5555 4444", "a." * 20000, "..1.1.1.1.", "+12345678@a.b-c.d", "@" * 999]


def test_pii(spark, docs, rows, nothing):
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    for df, data in ((docs, [r[:2] for r in rows]), (more, [(100 + i, t) for i, t in enumerate(TRICKY)])):
        want = []
        for d, t in data:
            b = base_spans(t)
            n = Counter(x.split(":")[0] for x in b)
            want.append((d, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(b).encode()).hexdigest()))
        assert ordered(want) == ordered(pii.report(df).drop("spans", "scores", "found").collect())
    assert pii.report(nothing).count() == 0


def test_pii_added_kinds_and_masks(spark):
    df = spark.createDataFrame([(1, "iban GB82 WEST 1234 5698 7654 32 ok", 3), (2, "GB83 WEST 1234 5698 7654 32", 4), (3, "ssn 123-45-6789", 5), (4, "no. 123-45-6789", 6), (5, None, None)], "doc_id long, text string, n_chars long")
    spans = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert spans == {1: "iban:5:32", 2: "", 3: "ssn:4:15", 4: "", 5: ""}
    masked = {r.doc_id: r for r in pii.redact(df).collect()}
    assert masked[1].text == "iban [IBAN] ok" and masked[1].n_chars == len(masked[1].text)
    assert masked[4].text == "no. 123-45-6789" and masked[4].n_chars == 6 and masked[5].text is None


def test_pii_scores_and_bounds(spark):
    texts = ["IBAN BE68 5390 0754 7034 PLEASE", "XBE68539007547034", "BE68539007547034X", "GB82WEST12345698765432,GB82WEST12345698765432", "a script 10.0.0.1", "the ip 10.0.0.1", "QQ68 5390 0754 7034", "ssn 1123-45-6789", "9BE68 5390 0754 7034"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.spans, r.scores) for r in pii.report(df).collect()}
    assert got == {0: ("iban:5:24", "90"), 1: ("", ""), 2: ("iban:0:16", "70"), 3: ("iban:0:22,iban:23:45", "70,70"), 4: ("ip:9:17", "60"), 5: ("ip:7:15", "80"), 6: ("", ""), 7: ("", ""), 8: ("", "")}


def test_redact_difficult_rows(docs, rows, nothing):
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == len(rows) and pii.redact(nothing).count() == 0
    plain = ordered(tuple(r) for r in rows if not base_spans(r[1]) and "GB82" not in (r[1] or ""))
    assert set(map(repr, plain)) <= {repr(tuple(r)) for r in out.collect()}


# -- packing ---------------------------------------------------------------------------


def test_packing(docs, rows, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        starts = [0, *range(first, len(ids), 1024)] if len(ids) > 1024 else [0]
        for k, s in enumerate(starts):
            part = ids[s : starts[k + 1] if k + 1 < len(starts) else None]
            want.append((r[0], k, s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    got = packing.pack(docs).collect()
    assert ordered(x[:5] for x in got) == ordered(want)
    by = defaultdict(list)
    for x in got:
        by[x.sequence_id].append((x.offset, x.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(by) <= 1.05 * -(-sum(x.length for x in got) // 1024) + 1  # several pieces are over half
    assert packing.pack(nothing).count() == 0


def histograms() -> dict[str, Counter]:
    r = np.random.default_rng(3)
    return {
        "short": Counter(r.integers(5, 120, 100_000).tolist()),
        "few short": Counter(r.integers(5, 120, 2000).tolist()),
        "lognormal": Counter(np.minimum(1024, r.lognormal(5.8, 1.0, 40_000).astype(int) + 1).tolist()),
        "any": Counter(r.integers(1, 1025, 50_000).tolist()),
        "one word": Counter({2: 70_000}),
        "full": Counter({1024: 500, 1: 3}),
        "over half": Counter({600: 1000}),
    }


@pytest.mark.parametrize("name", sorted(histograms()))
def test_packing_plan_uses_every_length(name):
    h = histograms()[name]
    plan = packing.plan(h)
    used = Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 1024 and times > 0
        for n in lengths:
            used[n] += times
    assert used == h
    sequences, least = sum(t for _, t in plan), -(-sum(n * c for n, c in h.items()) // 1024)
    least = max(least, sum(c for n, c in h.items() if n > 512))
    assert sequences <= least * 1.015 + 1
    assert len(plan) < 6000  # bounded by lengths, not by documents


@pytest.mark.parametrize("name", ["short", "few short", "lognormal", "any", "one word"])
def test_most_sequences_are_fitted_patterns(name):
    left = np.zeros(1025, np.int64)
    for n, c in histograms()[name].items():
        left[n] += c
    planned = sum(t for slack in (0, 0, 0, packing.SLACK, packing.SLACK) for _, t in packing.fitted(left, 1024, slack))
    rest = sum(t for _, t in packing.best_fit(left))
    assert planned / (planned + rest) > 0.9


# -- mixing ----------------------------------------------------------------------------


def fair_targets(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    total = sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in names if s not in open_)
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return {s: share[s] if s in open_ else 3 * sizes[s] for s in names}
        open_ -= over


def plain_queue(rows: list[tuple]) -> list[int]:
    """How often each row is taken: the queue in plain Python."""
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    by = defaultdict(list)
    for i, r in enumerate(rows):
        text = hashlib.md5((r[1] or "").encode()).hexdigest()
        by[r[3]].append((hashlib.md5(f"17:{'null' if r[0] is None else r[0]}:{text}".encode()).hexdigest(), i))
    total = {s: sum(size[i] for _, i in x) for s, x in by.items()}
    target, names = fair_targets(total), sorted(by, key=lambda s: (s is None, s or ""))
    queue = []
    for s, x in by.items():
        upto = 0
        for _, i in sorted(x):
            upto += size[i]
            queue += [((k * total[s] + upto) / target[s], names.index(s), k, k * total[s] + upto, i) for k in range(3) if size[i]]
    times, spent = [0] * len(rows), 0
    for *_, i in sorted(queue):
        spent += size[i]
        if spent > sum(size):
            break
        times[i] += 1
    return times


def test_mixing(spark, docs, rows, nothing):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    target = fair_targets(sizes)
    s = mixing.schedule(docs)
    got = s.collect()
    assert len(got) == len(rows)
    words_ = [len(WORD.findall(r[1] or "")) for r in rows]
    want = [(r[0], n, sizes[r[3]], n * k) for r, n, k in zip(rows, words_, plain_queue(rows), strict=True)]
    assert ordered((r["doc_id"], r["size"], r.source_size, r["size"] * len(r.copies)) for r in got) == ordered(want)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and len(r.copies) <= 3
    assert sum(r["size"] * len(r.copies) for r in got) <= sum(words_)
    assert ordered(mixing.taken(s).collect()) == ordered(mixing.taken(mixing.schedule(docs.repartition(7))).collect())
    assert mixing.schedule(nothing).count() == 0 and mixing.mix(nothing).count() == 0
    wordless = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.target, r.taken) for r in mixing.taken(mixing.schedule(wordless)).collect()} == {(0.0, 0)}


def test_mixed_rows(docs, rows):
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    whole = Counter()
    for r, k in zip(rows, plain_queue(rows), strict=True):
        whole[r[:4]] += k
    assert Counter(tuple(r)[:4] for r in out.collect()) == +whole


def test_mixing_is_near_its_targets(spark):
    r = np.random.default_rng(2)
    data = [(i, "w " * int(r.integers(1, 60)), f"s{i % 7 if i % 3 else 0}") for i in range(6000)]
    got = mixing.taken(mixing.schedule(spark.createDataFrame(data, "doc_id long, text string, source string"))).groupBy("target", "source_size").agg(F.sum("taken").alias("t")).collect()
    assert len(got) == 7 and all(abs(x.t - x.target) <= 2 * 60 for x in got)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 0, "b": 0}, {"a": 7}, {None: 3, "": 900, "z": 30, "y": 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(fair_targets(sizes))


# -- near-duplicates -------------------------------------------------------------------


def plain_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    s = [" ".join(w)] if len(w) < 4 else [" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps: list[int], near: int = 4) -> list[int]:
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= near:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash(docs, rows, nothing):
    fps = [plain_fingerprint(r[1]) for r in rows]
    of = groups(fps)
    name = {}
    for g, r in zip(of, rows, strict=True):
        if r[0] is not None:
            name[g] = min(name.get(g, r[0]), r[0])
    want = [(r[0], f"{f:016x}", name.get(g)) for r, f, g in zip(rows, fps, of, strict=True)]
    assert ordered(simhash.near_duplicates(docs).collect()) == ordered(want)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(of))
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.deduplicate(nothing).count() == 0


def test_ball_links_find_all(spark):
    r = np.random.default_rng(5)
    centres = r.integers(0, 2**63, 300, dtype=np.uint64)
    fps = set(centres.tolist())
    for c in centres[:60].tolist():
        for _ in range(6):  # chains of near steps
            for b in r.choice(64, r.integers(1, 6), replace=False):
                c ^= 1 << int(b)
            fps.add(c)
    for k in range(600):  # one large tight group
        fps.add(0xF0F0 ^ (1 << (k % 64)) ^ (1 << (k * 7 % 64)))
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    found = {r.node: r.root for r in components.components(simhash.links(df, len(fps))).collect()}
    got = [found.get(simhash._signed(x), simhash._signed(x)) for x in fps]
    of = groups(fps)
    assert len(set(got)) == len(set(of)) == len(set(zip(got, of, strict=True)))


def test_large_cell_is_dealt_on(monkeypatch):
    monkeypatch.setattr(simhash, "AT_ONCE", 200)
    fp = np.array([1 << 40 | 1 << (20 + k) for k in range(12)] + [7], np.uint64)
    m = 8
    low = fp & np.uint64(255)
    a, b = simhash._collide(low, fp, m)
    assert {*a.tolist(), *b.tolist()} == set(fp[:12].tolist()) and len(set(b.tolist())) == 1


def test_components_of_a_chain(spark):
    n = 60
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r.node: r.root for r in components.components(e).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 101: 100}


# -- search ----------------------------------------------------------------------------


def test_topk(spark):
    r = np.random.default_rng(1)
    data = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    data += [(400 + i, data[0][1]) for i in range(40)] + [(20, data[3][1]), (20, data[3][1])]
    data += [(500, None), (520, [1.0, None, *[0.0] * 6]), (540, [float("nan")] * 8), (560, [float("inf")] * 8), (None, data[5][1]), (580, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in data], "vec_id long, embedding array<float>, score int, uid int")
    live = [(i, np.floor(np.array(v, np.float32).astype(float) * 64).astype(int)) for i, v in data if v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for a, (i, v) in enumerate(live):
        if i is not None and i % 20 == 0:
            s = sorted((-int(v @ w), j is None, j or 0) for b, (j, w) in enumerate(live) if b != a)
            want += [(i, k + 1, None if n else j, -x) for k, (x, n, j) in enumerate(s[:20])]
    assert ordered(topk.search(df).collect()) == ordered(want)
    assert topk.search(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(x) for x in topk.search(few).collect()] == [(0, 1, 1, 8192)]


@pytest.mark.parametrize("at_once, block", [(64, 32), (7, 3)])
def test_topk_in_rounds(spark, monkeypatch, at_once, block):
    monkeypatch.setattr(topk, "QUERIES_AT_ONCE", at_once)
    monkeypatch.setattr(topk, "ROW_BLOCK", block)
    r = np.random.default_rng(4)
    data = [(i, [float(x) for x in r.integers(-3, 4, 3)]) for i in range(220)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    want = []
    for i, v in data[::5]:
        s = sorted((-int(64 * 64 * np.dot(v, w)), j) for j, w in data if j != i)
        want += [(i, k + 1, j, -x) for k, (x, j) in enumerate(s[:6])]
    assert ordered(topk.search(df, k=6, every=5).collect()) == ordered(want)


def test_topk_of_huge_components(spark):
    """Exact for any finite component; a score beyond a long is shown as the nearest long."""
    import math
    from fractions import Fraction

    data = [(0, [1e200, 1.0]), (1, [1e-200, 3.0]), (2, [1e30, -1e30]), (3, [1e30, 1.0]), (4, [-1e308, 0.5]), (5, [2.0**40, 2.0**41]), (6, [0.25, 0.5]), (20, [1e30, 1e30]), (40, [2.0**20 + 0.5, 2.0**25]), (60, [2.0, 3.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(Fraction(x) * 64) for x in v] for i, v in data}
    want = []
    for i in (0, 20, 40, 60):
        s = sorted((-min(max(sum(a * b for a, b in zip(whole[i], w, strict=True)), -(2**63)), 2**63 - 1), j) for j, w in whole.items() if j != i)
        want += [(i, k + 1, j, -x) for k, (x, j) in enumerate(s)]
    assert ordered(topk.search(df).collect()) == ordered(want)


# -- quality ---------------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    at = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(at) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(at), failed


def test_quality(docs, rows, nothing):
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = quality.judge(docs)
    assert ordered(got.select(*cols).collect()) == ordered((r[0], *plain_counts(r[1])) for r in rows)
    assert got.where("base_failed and kept").count() == 0
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()
    assert quality.judge(nothing).count() == 0 and quality.keep(nothing).count() == 0


def test_quality_reasons(spark):
    prose = "and the cat of the house was in a room that is for it " * 1
    good = " ".join(words(i, 6) + " of the" for i in range(20))
    df = spark.createDataFrame([(1, good), (2, good.replace(" ", "### ")), (3, words(9, 200)), (4, prose)], "doc_id long, text string")
    got = {r.doc_id: (r.kept, list(r.reasons)) for r in quality.judge(df).collect()}
    assert got[1] == (True, []) and "symbols" in got[2][1] and got[3] == (False, ["few_stop_words"]) and not got[4][0]


# -- licenses --------------------------------------------------------------------------


def test_licenses(spark, docs, nothing):
    mit = licenses.TEMPLATES["MIT-text"]
    torn = mit.split()
    torn[30], torn[60] = "changed", "altered"
    texts = {
        1: words(1, 50) + "\n" + mit + "\n" + words(2, 30),
        2: words(3, 11) + " " + " ".join(torn),
        3: words(4, 100) + " Released under\nthe MIT License. " + words(5, 3),
        4: "This work is licensed under the GNU General Public License, version 3.",
        5: words(6, 400),
        6: " ".join(mit.split()[:30]) + words(7, 80),
        7: "licensed under cc by-nc 4.0!",
    }
    df = spark.createDataFrame([*texts.items(), (8, None), (9, "")], "doc_id long, text string")
    got = defaultdict(list)
    for r in licenses.scan(df).collect():
        got[r.doc_id].append((r.license, r.share))
    assert {d: [x[0] for x in v] for d, v in got.items()} == {1: ["MIT-text"], 2: ["MIT-text"], 3: ["MIT"], 4: ["GPL-3.0"], 7: ["CC-BY-NC-4.0"]}
    assert got[1][0][1] == 1.0 and 0.8 <= got[2][0][1] < 1.0
    assert licenses.scan(docs).count() == 0 and licenses.scan(nothing).count() == 0


def test_license_index_misses_no_window():
    """Every template, alone in other words at any phase, is found."""
    index = licenses.Index(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        for phase in range(6):
            w = licenses.words((words(phase, 20 + phase) + " " + text + " " + words(9, 20)).encode())
            best = index.matches(w, license_places(index, w))
            assert any(m[3] == 1.0 and (m[0] == name or m[2] - m[1] >= len(licenses.words(text.encode()))) for m in best), (name, phase, best)


def license_places(index, w):
    codes = np.array([zlib.crc32(x) for x in w] + [0] * licenses.WINDOW, np.uint32)
    return [(p, t, o) for p, hits in index.places(codes).items() for t, o in hits]


def plain_license_share(w: list, template: list) -> float:
    """The largest share of a template's shingles in any stretch of a text, one and a half times its length."""
    size = min(licenses.SHINGLE, len(template))
    need = {tuple(template[k : k + size]) for k in range(len(template) - size + 1)}
    here = [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
    reach = len(template) - size + 1 + 2 * ((len(template) - size + 1) // 4)
    return max((len(need & set(here[k : k + reach])) / len(need) for k in range(max(1, len(here) - reach + 1))), default=0.0)


def test_license_recall_against_brute_force():
    """Edited copies of every template: of those that plain counting finds, nearly all are found."""
    index = licenses.Index(licenses.TEMPLATES)
    r = np.random.default_rng(8)
    hits = all_ = 0
    for name, text in licenses.TEMPLATES.items():
        template = licenses.words(text.encode())
        for rate in (0.0, 0.01, 0.02, 0.03, 0.04):
            for _ in range(4):
                w = [b"zq%d" % k if r.random() < rate else x for k, x in enumerate(template)]
                w = licenses.words(words(int(r.integers(1e6)), int(r.integers(5, 60))).encode()) + w + [b"tail"] * 9
                if plain_license_share(w, template) < licenses.SHARE:
                    continue
                all_ += 1
                # A longer template that holds this one may stand in its place.
                hits += any(m[0] == name or m[2] - m[1] >= 0.75 * len(template) for m in index.matches(w, license_places(index, w)))
    assert all_ > 300 and hits / all_ >= 0.98


def test_licenses_parted_and_short(spark):
    mit = licenses.TEMPLATES["MIT-text"].split()
    texts = {1: " ".join([*mit[:40], *words(1, 60).split(), *mit[40:]]), 2: " ".join([*mit, *mit]), 3: "so: all rights reserved, then", 4: "all rights", 5: "Public domain"}
    df = spark.createDataFrame([*texts.items(), (5, "Public domain")], "doc_id long, text string")
    own = {"MIT-text": licenses.TEMPLATES["MIT-text"], "ARR": "All rights reserved.", "PD": "public domain", "none": " . "}
    got = ordered((r.doc_id, r.license, r.start, r.stop) for r in licenses.scan(df, templates=own).collect())
    n = len(licenses.words(" ".join(mit).encode()))
    assert got == ordered([(1, "MIT-text", 0, n + 60), (2, "MIT-text", 0, n), (2, "MIT-text", n, 2 * n), (3, "ARR", 1, 4), (5, "PD", 0, 2), (5, "PD", 0, 2)])


# -- passages --------------------------------------------------------------------------


def test_passages(spark, nothing, docs):
    p, q, short = words(50, 60), words(51, 90), words(52, 30)
    fuzzy = q.split()
    fuzzy[20], fuzzy[55:56] = "other", ["two", "words"]
    texts = {
        1: words(1, 80) + " " + p + " " + words(2, 40),
        2: p + " " + words(3, 100),
        3: words(4, 33) + " " + q + " " + words(5, 20),
        4: words(6, 71) + " " + " ".join(fuzzy),
        5: words(7, 60) + " " + short + " " + words(8, 60),
        6: short + " " + words(9, 90),
        7: words(10, 300),
        8: words(11, 10) + " " + p.upper(),
        9: None,
        10: "",
        11: words(12, 20),
        12: words(12, 20),
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = substring.passages(df).collect()
    pairs = {frozenset((r.doc_id, r.other_doc_id)) for r in got}
    flagged = {x for s in pairs for x in s}
    assert flagged == {1, 2, 3, 4, 8} and frozenset((3, 4)) in pairs
    for r in got:
        if {r.doc_id, r.other_doc_id} <= {1, 2, 8}:
            assert r.stop - r.start == 60 and r.same == 1.0
            w = texts[r.doc_id].lower().split()[r.start : r.stop]
            assert w == p.split()
    assert substring.passages(nothing).count() == 0
    assert {5, 8, 19} <= {x for r in substring.passages(docs).collect() for x in (r.doc_id, r.other_doc_id)}


@pytest.mark.parametrize("seed", range(5))
def test_chains_are_best(seed):
    """The Fenwick tree finds the same best score as trying all predecessors."""
    r = np.random.default_rng(seed)
    p, q = r.integers(0, 60, 40), r.integers(0, 60, 40)
    order = np.lexsort((q, p))
    pts = list(zip(p[order].tolist(), q[order].tolist(), strict=True))
    score = []
    for j, (x, y) in enumerate(pts):
        best = max((score[i] - substring.GAP * (x - a + y - b) for i, (a, b) in enumerate(pts[:j]) if a < x and b < y), default=0)
        score.append(substring.SHINGLE + max(0, best))
    assert substring.chains(p, q)[0][4] == pytest.approx(max(score))


def test_winnowing_gives_shared_passages_the_same_seeds():
    p = words(70, 51)
    docs = [substring.word_codes((words(s, s) + " " + p + " " + words(s + 9, 30)).encode()) for s in range(1, 40)]
    doc, _, h = substring.seeds(docs)
    shared = set.intersection(*[set(h[doc == d].tolist()) for d in range(len(docs))])
    assert len(shared) >= 2


# -- classifier ------------------------------------------------------------------------


def test_classifier(spark, docs, nothing):
    good = [(i, " ".join(words(i * 9 + k, 5) + " and the" for k in range(12)) + ".") for i in range(200)]
    bad = [(i + 200, words(i + 5000, 60).replace(" ", "### ")) for i in range(200)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i < 200)) for i in range(400)] + [(None, 1), (9999, 0), (3, None)], "doc_id long, quality int")
    m = classifier.train(d, lab)
    assert m.rules and m == classifier.train(d, lab)
    got = classifier.score(d, m).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == (r.doc_id < 200) for r in held) / len(held) > 0.97
    out = classifier.score(docs, m).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert classifier.score(nothing, m).count() == 0
    many = d.unionByName(d.select("doc_id", F.concat("text", F.lit(" again")).alias("text"), F.explode(F.sequence(F.lit(1), F.lit(30))).alias("n")).drop("n"))
    assert classifier.train(many, lab, sample=5).bias == classifier.train(many.repartition(5), lab, sample=5).bias
    empty = classifier.train(d, lab.limit(0))
    assert {r.score for r in classifier.score(d, empty).collect()} == {0.5}


def test_classifier_learns_no_held_out_label(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2]
    d = spark.createDataFrame([(i, words(i, 30)) for i in held], "doc_id long, text string")
    assert classifier.train(d, d.select("doc_id", F.lit(1).alias("quality"))) == classifier.Model(0.0, ())


# -- sharding --------------------------------------------------------------------------


def plain_jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(docs, rows, nothing):
    got = sharding.place(docs).collect()
    key = lambda d: xxhash.xxh64_intdigest("0" if d is None else f"1{d}", 42)
    want = []
    for r in rows:
        t = (r[1] or "").encode()
        want.append((r[0], len(t) + 8, zlib.crc32(t), "key", plain_jump(key(r[0]), 24), plain_jump(key(r[0]), 25)))
    assert ordered((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == ordered(want)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert all(r.grown_shard in (r.shard, 24) for r in got)
    assert sharding.place(nothing).count() == 0


def test_hot_keys_are_in_several_partitions(spark, monkeypatch):
    """Rows of one doc_id (null, with different texts or the same) are numbered in more than one task."""
    from quillspark.llm import ordering

    seen = []
    real = ordering.in_order
    monkeypatch.setattr(ordering, "in_order", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for text in (F.col("id").cast("string"), F.lit("same")):
            df = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"), F.lit("s").alias("source"))
            got = sharding.place(df)
            assert sorted(r.slot for r in got.collect()) == list(range(2000))
            assert mixing.taken(mixing.schedule(df)).agg(F.sum("taken")).first()[0] == 2000
            assert packing.pack(df).count() == 2000
            assert mixing.mix(df).count() == 2000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(seen) >= 6 and all(x.select("__part").distinct().count() > 1 for x in seen)


def test_written_shards(spark, docs, nothing, tmp_path):
    sharding.write(docs, f"{tmp_path}/s")
    sharding.write(nothing, f"{tmp_path}/n")
    got = spark.read.parquet(f"{tmp_path}/s")
    want = {(r.doc_id, r.shard) for r in sharding.place(docs).collect()}
    assert got.count() == docs.count() and {(r.doc_id, r.shard) for r in got.select("doc_id", "shard").distinct().collect()} == want


def test_jump_moves_few():
    keys = np.array([int(hashlib.md5(str(i).encode()).hexdigest()[:16], 16) for i in range(20000)], np.uint64)
    a, b = sharding.jump(keys, 24), sharding.jump(keys, 25)
    assert set(b[a != b]) == {24} and abs((a != b).mean() - 1 / 25) < 0.006
    assert np.bincount(a, minlength=24).min() > 700


# -- all -------------------------------------------------------------------------------


def test_empty_schema_constant(docs):
    assert docs.schema.simpleString().count(":") == len(SCHEMA.split(","))


def test_passages_split_among_other_documents(spark):
    """Two documents share a passage; a seed's first and last documents have only parts of it."""
    p = words(500, 56).split()
    texts, d = {}, 0
    for k in range(12):  # many documents with the first or the second half, before and after by any order
        for half in (p[:30], p[26:]):
            texts[d] = words(600 + d, 40) + " " + " ".join(half) + " " + words(700 + d, 40)
            d += 1
    texts[100] = words(800, 25) + " " + " ".join(p) + " " + words(801, 20)
    texts[101] = words(802, 70) + " " + " ".join(p)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = substring.passages(df).collect()
    assert {frozenset((r.doc_id, r.other_doc_id)) for r in got} == {frozenset((100, 101))}
    for r in got:
        assert texts[r.doc_id].split()[r.start : r.stop] == p == texts[r.other_doc_id].split()[r.other_start : r.other_stop]


def test_open_places():
    m = np.arange(0, 200, 10)
    assert substring.open_places(m, [(0, 300)]) == []
    assert substring.open_places(np.array([3, 9, 12]), []) == []
    (a, b), = substring.open_places(m, [(0, 100), (90, 300)])
    assert a <= 80 <= b and b < 110


@pytest.mark.parametrize("first, foreign, second", [(200, 150, 200), (300, 200, 300), (150, 100, 150), (60, 40, 60)])
def test_passages_apart_in_one_chain(first, foreign, second):
    """Two edited passages on one diagonal, foreign words between them: neither dilutes the other."""
    p = words(900, first + second).split()
    edited = [f"x{k}" if k % 40 == 25 else w for k, w in enumerate(p)]
    sides = []
    for k, w in enumerate((p, edited)):
        text = " ".join([words(910 + k, 30), *w[:first], words(920 + k, foreign), *w[first:], words(930 + k, 30)])
        sides.append(substring.word_codes(text.encode()))
    doc, at, h = substring.seeds(sides)
    there = dict(zip(h[doc == 1].tolist(), at[doc == 1].tolist(), strict=True))
    p_, q_ = zip(*[(x, there[y]) for x, y in zip(at[doc == 0].tolist(), h[doc == 0].tolist(), strict=True) if y in there], strict=True)
    (p0, p1, q0, q1, _), *rest = substring.chains(np.array(p_), np.array(q_))
    assert not rest  # one chain over the foreign words
    got = substring.align(*sides, (p0, p1 + substring.SHINGLE), (q0, q1 + substring.SHINGLE))
    shown = {x for a0, a1, *_ in got for x in range(a0, a1)}
    assert {*range(30, 30 + first), *range(30 + first + foreign, 30 + first + foreign + second)} <= shown
    assert len(shown) <= first + second + foreign // 4 and all(x[4] >= substring.MIN_SAME for x in got)


@pytest.mark.parametrize("seed", range(6))
def test_alignment_against_difflib(seed):
    """Of edited copies (words changed, left out, put in) the alignment finds nearly all that difflib finds."""
    import difflib

    r = np.random.default_rng(seed)
    a = r.integers(0, 400, 600).astype(np.uint32)
    b = []
    for x in a[5:-5]:
        dice = r.random()
        b += [int(r.integers(400, 900))] if dice < 0.04 else [] if dice < 0.07 else [int(x), 901] if dice < 0.1 else [int(x)]
    b = np.array([*a[:5], *b, *a[-5:]], np.uint32)
    got = substring.matched(a, b)
    assert all((a[x : x + n] == b[y : y + n]).all() and n > 0 for x, y, n in got)
    assert all(x + n <= x2 and y + n <= y2 for (x, y, n), (x2, y2, _) in zip(got, got[1:], strict=False))
    best = sum(m.size for m in difflib.SequenceMatcher(None, a.tolist(), b.tolist(), autojunk=False).get_matching_blocks())
    assert sum(n for *_, n in got) >= 0.97 * best


def test_alignment_of_long_texts_is_quick():
    import time

    r = np.random.default_rng(1)
    a = (r.zipf(1.3, 120_000) % 5000).astype(np.uint32)
    b = np.delete(a, r.integers(5, len(a) - 5, 3000))
    began = time.perf_counter()
    got = substring.matched(a, b)
    assert sum(n for *_, n in got) > 0.9 * len(b) and time.perf_counter() - began < 20


def test_passages_recall_against_brute_force(spark):
    """Exact and edited passages of all lengths in groups of several sizes, among passages that
    others quote in part: every pair with 50 words alike, found by trying all windows, is
    linked (as members of one group), and most of its words are shown."""
    r = np.random.default_rng(12)
    texts, d, groups = {}, 0, []
    for g in range(40):
        n, edit = int(r.integers(50, 260)), int(r.choice([0, 40, 20, 12]))
        p = words(3000 + g, n).split()
        size = int(r.choice([2, 3, 5, 9]))
        members = []
        for _ in range(size):
            q = [f"e{int(r.integers(1e6))}" if edit and r.random() < 1 / edit else w for w in p]
            texts[d] = " ".join([words(4000 + d, int(r.integers(5, 80))), *q, words(5000 + d, int(r.integers(5, 80)))])
            members.append(d)
            d += 1
        if g % 3 == 0:  # 25 words of it stand in two others
            for k in range(0, n - 25, 25):
                for _ in range(2):
                    texts[d] = " ".join([words(6000 + d, 60), *p[k : k + 25], words(7000 + d, 60)])
                    d += 1
        groups.append((members, edit))
    got = substring.passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).collect()
    shown = defaultdict(set)
    for x in got:
        shown[x.doc_id] |= set(range(x.start, x.stop))
        shown[x.other_doc_id] |= set(range(x.other_start, x.other_stop))
    want = found = full = have = 0
    for members, edit in groups:
        for i in members:
            a = texts[i].split()
            at = defaultdict(set)
            for k in range(len(a) - 49):
                at[tuple(a[k : k + 50])].add(k)
            for j in members:
                b = texts[j].split()
                same = {w for k in range(len(b) - 49) if j != i for w in at.get(tuple(b[k : k + 50]), ())}
                cover = {x for k in same for x in range(k, k + 50)}
                full, have = full + len(cover), have + len(cover & shown[i])
            if edit in (0, 40, 20):
                want, found = want + 1, found + bool(shown[i])
    assert have / full >= 0.99 and found / want >= 0.9
    plain = {i for members, _ in groups for i in members}
    wrong = [i for i in texts if i not in plain and shown[i]]
    assert len(wrong) <= 0.02 * len(texts)


def test_passages_that_repeat_one_line(spark):
    """A line over and over is a repeated passage too; rows that repeat are one document."""
    line = "the same short line of text " * 12
    rows_ = [(1, words(20, 30) + " " + line), (2, line + words(21, 40)), (3, words(22, 90)), (3, words(22, 90))]
    got = substring.passages(spark.createDataFrame(rows_, "doc_id long, text string")).collect()
    assert {frozenset((r.doc_id, r.other_doc_id)) for r in got} == {frozenset((1, 2))}
    assert all(r.stop - r.start >= 50 for r in got)


def test_parts_show_all_that_is_alike():
    r = np.random.default_rng(5)
    for _ in range(200):
        a = b = 0
        blocks = []
        for _ in range(r.integers(1, 12)):
            a, b, n = a + int(r.integers(0, 30)), b + int(r.integers(0, 30)), int(r.integers(1, 60))
            blocks.append((a, b, n))
            a, b = a + n, b + n
        want = set()
        for i in range(len(blocks)):
            for j in range(i, len(blocks)):
                x, y = blocks[j][0] + blocks[j][2] - blocks[i][0], blocks[j][1] + blocks[j][2] - blocks[i][1]
                if min(x, y) >= substring.MIN_WORDS and sum(z[2] for z in blocks[i : j + 1]) >= substring.MIN_SAME * max(x, y):
                    want |= set(range(blocks[i][0], blocks[j][0] + blocks[j][2]))
        assert {x for p in substring.parts(blocks) for x in range(p[0], p[1])} == want


def test_passages_whose_partner_is_shown(spark):
    """One document quotes what two others show already; its seeds' first and last documents are others."""
    p = words(950, 60).split()
    d_text = [*words(951, 200).split(), *p, *words(952, 200).split()]
    x_text = list(d_text)
    texts = {200: " ".join(d_text), 201: words(953, 20) + " " + " ".join(x_text)}
    n = 0
    for k in range(14):  # halves of the quoted passage, in many documents before and after by any order
        for half in (p[:32], p[28:]):
            texts[n] = words(960 + n, 40) + " " + " ".join(half) + " " + words(1000 + n, 40)
            n += 1
    texts[202] = words(954, 50) + " " + " ".join(p) + " " + words(955, 50)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = substring.passages(df).collect()
    pairs = {frozenset((r.doc_id, r.other_doc_id)) for r in got}
    assert frozenset((200, 201)) in pairs and pairs & {frozenset((200, 202)), frozenset((201, 202))}
    assert {x for s in pairs for x in s} == {200, 201, 202}
    for r in got:
        if 202 in (r.doc_id, r.other_doc_id):
            a, b = texts[r.doc_id].split()[r.start : r.stop], texts[r.other_doc_id].split()[r.other_start : r.other_stop]
            assert a == b == p


@pytest.mark.parametrize("case", range(3))
def test_edited_passages_whose_seeds_are_frequent(spark, case):
    """Two edited copies of a passage whose seeds are all in many other documents, a few words in each;
    no 50 words in a row are equal, and the first and the last document of its seeds are others."""
    p = words(1200 + case, 120).split()
    sides = [[f"e{k}" if k % 40 == at else w for k, w in enumerate(p)] for at in (10, 30)]
    texts = {900 + k: " ".join([words(1210 + 2 * case + k, 40), *side, words(1220 + 2 * case + k, 40)]) for k, side in enumerate(sides)}
    for n in range(12 * 16):
        k = n // 12 * 7
        texts[n] = words(1300 + 1000 * case + n, 30) + " " + " ".join(p[k : k + 15]) + " " + words(1700 + 1000 * case + n, 30)
    got = substring.passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()
    assert {frozenset((x.doc_id, x.other_doc_id)) for x in got} == {frozenset((900, 901))}
    for x in got:
        assert x.same >= substring.MIN_SAME and min(x.stop - x.start, x.other_stop - x.other_start) >= substring.MIN_WORDS
    assert max(x.stop - x.start for x in got) >= 100


def test_across_gives_all_pairs_of_different_classes():
    r = np.random.default_rng(6)
    for _ in range(100):
        n = int(r.integers(2, 12))
        key = r.permutation(40)[:n]
        shown = r.choice(key, n)
        low, high, lead = np.minimum(key, shown), np.maximum(key, shown), r.random(n) < 0.7
        near = r.integers(15, 40, n)
        label = {k: {int(k)} for k in key.tolist()}
        for a, b in [*zip(low.tolist(), high.tolist(), strict=True)]:
            both = label[a] | label[b]
            for x in both:
                label[x] = both
        want = set()
        for i in range(n):
            for j in range(i):
                a, b = int(key[i]), int(key[j])
                if b not in label[a] and (lead[i] or lead[j]) and abs(int(near[i] - near[j])) <= substring.SLACK:
                    want.add((max(a, b), min(a, b)) if lead[i] == lead[j] else (b, a) if lead[i] else (a, b))
        got = [x for s in substring.across(key, low, high, lead, near, near) for x in zip(*(y.tolist() for y in s), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want
        classes = {frozenset(x) for x in label.values()}
        one = [x for s in substring.across(key, low, high, lead, near, near, False) for x in zip(*(y.tolist() for y in s), strict=True)]
        assert len(one) < len(classes) and all(b not in label[a] for a, b in one)


def test_texts_too_short_for_a_passage_are_not_paired(spark, monkeypatch):
    """A line of thirty words in many texts of forty: none can have a passage, so none is chained;
    longer texts that quote it in an edited passage are still found."""
    p = words(2100, 100).split()
    texts = {n: " ".join(p[20:50]) + " " + words(2200 + n, 10) for n in range(60)}
    for k, at in enumerate((7, 22)):
        side = [f"e{i}" if i % 30 == at else w for i, w in enumerate(p)]
        texts[100 + k] = " ".join([words(2400 + k, 30), *side, words(2500 + k, 30)])
    tried = []
    cut = substring.cut

    def counted(df):
        out = cut(df)
        if out.columns == ["key", "other"]:
            tried.append(out.count())
        return out

    monkeypatch.setattr(substring, "cut", counted)
    got = substring.passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()
    assert {frozenset((x.doc_id, x.other_doc_id)) for x in got} == {frozenset((100, 101))}
    assert sum(tried) <= len(texts)
