"""Golden values of single functions and operators."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.functions import evidence as ev
from quillspark.functions import metrics as M
from quillspark.functions import text as T
from quillspark.operators import cdc, chunking, diff, evaluation, fusion, graph, windows
from quillspark.sources import documents as sources


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("0.306149", "0.31", 1), ("0.304", "0.31", 0), ("1000.4", "1000", 0), ("Revenue: 1,000", "1000", 1), ("no number", "No  number", 1), ("yes", "no", 0)],
)
def test_numeric_equal(spark, a, b, want):
    assert one(spark, M.numeric_equal(F.lit(a), F.lit(b))) == want


def test_answers(spark):
    assert one(spark, M.plain_answer(F.lit("Revenue: 1,000"))) == one(spark, M.plain_answer(F.lit("revenue 1000"))) == "revenue1000"
    assert M.normalise_answer("ＡＢＣ  ①") == "abc1"
    assert one(spark, M.nfkc_answer(F.lit("ﬁne"))) == "fine"
    assert one(spark, M.error_rate(F.lit("abxd"), F.lit("abcd"))) == 0.25
    assert one(spark, M.error_rate(F.lit(""), F.lit(""))) == 0 and one(spark, M.error_rate(F.lit("a"), F.lit(""))) == 1


def test_set_metrics(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    assert one(spark, F.struct(*M.evidence(arr("a", "x"), arr("a", "b"))))[:] == (0.5, 0.0)
    assert one(spark, F.struct(*M.evidence(arr("a"), arr())))[:] == (1.0, 1.0)
    assert one(spark, F.struct(*M.citations(arr("a", "x"), arr("a", "b"))))[:2] == (0.5, 0.5)
    assert one(spark, F.struct(*M.citations(arr(), arr())))[:] == (None, None, None)


def test_binary_f1_and_percentile(spark):
    df = spark.createDataFrame([(1, True, True), (1, False, True), (1, True, False)], "k int, p boolean, a boolean")
    assert evaluation.binary_f1(df, ["k"], "p", "a").first().f1 == 0.5
    assert spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double").agg(F.percentile("x", F.lit(0.5))).first()[0] == 2.5


@pytest.mark.parametrize(("e", "want"), [("(10 + 2) * 3 / 4", 9), ("2 ** 8", 256), ("-7 // 2", -4), ("__import__('os')", None), ("1/0", None), ("9**9**9", None), (None, None), ("1" * 201, None)])
def test_calculator(e, want):
    assert M.calculate(e) == want


@pytest.mark.parametrize(("d", "want"), [("2024", "2024-01-01"), ("2024/3", "2024-03-01"), ("2024-3-5", "2024-03-05"), ("2024-13-99", None), ("soon", None)])
def test_dates(spark, d, want):
    got = one(spark, ev.evidence_date(F.lit(d)))
    assert (str(got) if got else None) == want


@pytest.mark.parametrize(
    ("q", "relation"),
    [("Was it not inconsistent?", "same_claim"), ("was it not consistent", "changed_claim"), ("is it inconsistent", "same_claim"), ("what came after", "after"), ("之前", "before"), ("who", "none"), ("what changed", "changed_claim")],
)
def test_fallback_plan(spark, q, relation):
    p = one(spark, ev.fallback_plan(F.lit(q)))
    assert p.target_relation == relation and len(p.queries) == (1 if relation == "none" else 2) == len(p.slots)


def test_lexical_tokens(spark):
    assert one(spark, T.lexical_tokens(F.lit("Foo foo v1.2-b 数据库 库"))) == ["foo", "v1.2-b", "数据库", "数据", "据库", "库"]


def test_windows_and_stable_ids(spark):
    u = spark.createDataFrame([(1, "u", " ".join(f"w{i}" for i in range(25))), (2, "u", "a b"), (3, "u", " ")], "doc_id int, unit_id string, content string")
    w = chunking.windows(u, ["doc_id", "unit_id"], "content", 10, 3)
    got = sorted((r.doc_id, r.token_start, r.token_end) for r in w.collect())
    assert got == [(1, 0, 10), (1, 7, 17), (1, 14, 24), (1, 21, 25), (2, 0, 2)]
    twice = spark.createDataFrame([(1, "u", "x y x y")], "doc_id int, unit_id string, content string")
    ids = chunking.identified(chunking.windows(twice, ["doc_id", "unit_id"], "content", 2, 0), "doc_id", "unit_id")
    assert sorted(r.occurrence for r in ids.collect()) == [0, 1] and ids.select("chunk_id").distinct().count() == 2


def test_fusion_ignores_native_scales(spark):
    rows = [(1, "v", "vector", 0.01), (1, "g", "graph", 999.0)]
    df = spark.createDataFrame(rows, "q int, c string, s string, score double")
    got = fusion.fuse_sources(df, "q", "c", "s", "score", {"vector": 1.0, "graph": 0.5}).orderBy("rank")
    assert [r.c for r in got.collect()] == ["v", "g"]


def test_diversity(spark):
    df = spark.createDataFrame([(1, "a1", "a", 1), (1, "a2", "a", 2), (1, "b1", "b", 3)], "q int, c string, d string, rank int")
    pick = lambda k: [r.c for r in fusion.diverse(df, "q", "d", "rank", 1, k).orderBy("position").collect()]
    assert pick(2) == ["a1", "b1"] and pick(3) == ["a1", "b1", "a2"]


def test_packing_fills_slots_first(spark):
    rows = [(1, c, c[0], i + 1, s, ["left", "right"]) for i, (c, s) in enumerate([("a1", ["left"]), ("a2", ["right"]), ("b1", ["right"]), ("c1", []), ("d1", [])])]
    df = spark.createDataFrame(rows, "q int, chunk_id string, doc_id string, rank int, slot_ids array<string>, required array<string>")
    got = [r.chunk_id for r in fusion.pack_slots(df, "q", 4).orderBy("position").collect()]
    assert got == ["a1", "b1", "a2", "c1"]


def test_slot_rerank(spark):
    c = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "q int, c string, rank int")
    s = spark.createDataFrame([(1, "c", "left", 0.9), (1, "b", "left", 0.8), (1, "a", "left", 0.7), (1, "a", "right", 0.9), (1, "b", "right", 0.8), (1, "c", "right", 0.7)], "q int, c string, slot string, score double")
    got = fusion.rerank(c, s, "q", "c").orderBy(F.col("score").desc(), "c").collect()
    assert [r.c for r in got] == ["a", "b", "c"] and got[0].slot_ids == ["left", "right"]


def test_char_budget(spark):
    df = spark.createDataFrame([(1, 1, "x" * 8), (1, 2, "y" * 8), (1, 3, "z")], "q int, rank int, content string")
    got = windows.char_budget(df, "q", "rank", "content", 10).orderBy("rank").collect()
    assert [len(r.packed) for r in got] == [8, 2]


def test_diff_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "doc_id int, chunk_id string")
    new = spark.createDataFrame([(1, "a"), (1, "b"), (1, "new")], "doc_id int, chunk_id string")
    assert diff.diff_counts(diff.chunk_diff(old, new)).first()[1:] == (1, 1, 2)
    assert diff.diff_counts(diff.chunk_diff(new, new)).first()[1:] == (0, 0, 3)


def test_debounce_keeps_the_leading_edge(spark):
    at = [0.0, 1.0, 1.9, 2.0, 3.5, 4.0, 9.0]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(at)], "path int, event_id long, s double").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.event_id for r in cdc.debounce(df, "path", "ts", "event_id").collect()) == [0, 3, 5, 6]


def test_bfs_levels_and_limits(spark):
    rel = spark.createDataFrame([("a", "p", "b", "c1", 0.9), ("b", "p", "c", "c2", 0.5), ("c", "p", "d", "c3", None)], "head_key string, predicate string, tail_key string, chunk_id string, confidence double")
    men = spark.createDataFrame([("a", "A"), ("b", "B"), ("b", "A"), ("c", "C"), ("d", "D")], "key string, chunk_id string")
    start = spark.createDataFrame([(1, "a")], "question_id int, key string")
    got = lambda h, n: sorted((r.chunk_id, r.hops) for r in graph.bounded_bfs(start, rel, men, h, n).collect())
    assert got(0, 9) == [("A", 0)] and got(2, 9) == [("A", 0), ("B", 1), ("C", 2)] and got(99, 9)[-1] == ("D", 3)
    assert got(1, 2) == [("A", 0)]  # the chunk already found uses up what is left



def test_embedding_text_equals_sql_on_odd_texts(spark, tmp_path):
    """White space at the end, empty texts and fields, nulls."""
    import duckdb
    from compare import differences

    from quillspark.plans import chunked
    from quillspark.plans.registry import SQL

    texts = ["a", "", " ", "a\n", "a \n", "a\n ", "a\t", "a\r\n", "\n", " a", "a\u00a0", "a\u3000 ", "a\u200b", "a\x1c", "a\u2028", "b\nc\n\n", None]
    odd = [(t, "en", "web") for t in texts] + [("a", "", "web"), ("a", None, "web"), ("a", "de", ""), ("a", "de", None), ("a", "en", " \n"), ("", "de", "")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(odd)], "doc_id long, text string, lang string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert differences(chunked.embedding_text(spark, str(tmp_path)), con, SQL["embedding_text"]) == []


def _hubs(spark):
    """Three hubs of 260 leaves each, leaves with up to two hubs, hubs linked; the mentions of all."""
    import random

    g = random.Random(7)
    rel = {(f"leaf{i:04}", f"hub{i % 3}"): g.choice([None, 0.1, 0.5, 0.9]) for i in range(780)}
    rel |= {(f"leaf{i:04}", f"hub{(i + 1) % 3}"): g.choice([None, 0.3, 0.9]) for i in range(0, 780, 13)}
    rel |= {("hub0", "hub1"): 0.4, ("hub2", "hub2"): 0.2, ("leaf0001", "leaf0002"): 0.7}
    keys = sorted({k for r in rel for k in r})
    men = {(k, f"c{g.randrange(900)}") for k in keys for _ in range(g.randrange(4))} | {(f"hub{i}", f"h{j}") for i in range(3) for j in range(4)}
    rows = spark.createDataFrame([(h, "p", t, "x", c) for (h, t), c in rel.items()], "head_key string, predicate string, tail_key string, chunk_id string, confidence double")
    return rel, men, rows, spark.createDataFrame(sorted(men), "key string, chunk_id string")


def _plain_bfs(keys, rel, men, hops, limit):
    """The search of one question, one key after the other."""
    near, told = {}, {}
    for (h, t), c in rel.items():
        for a, b in ((h, t), (t, h)):
            near.setdefault(a, []).append((b, c or 0.0))
    for k, c in men:
        told.setdefault(k, set()).add(c)
    front, seen, found = set(keys), set(keys), {}
    for depth in range(hops + 1):
        hits = {}
        for k in front:
            for c in told.get(k, ()):
                hits.setdefault(c, set()).add(k)
        for c in sorted(hits, key=lambda c: (-len(hits[c]), c))[: max(limit - len(found), 0)]:
            found.setdefault(c, (c, depth, len(hits[c]), tuple(sorted(hits[c]))))
        best = {}
        for k in front:
            for b, c in near.get(k, ()):
                if b not in seen:
                    best[b] = max(best.get(b, 0.0), c)
        front = set(sorted(best, key=lambda b: (-best[b], b))[: max(20 * limit, 200)])
        seen |= front
    return sorted(found.values())


def test_bfs_of_many_questions_equals_the_plain_search(spark):
    """Shared hubs, frontiers cut by the cap, starting keys within them, hubs to start from, equal questions."""
    rel, men, rows, mentions = _hubs(spark)
    asked = {i: [f"leaf{i * 19:04}"] for i in range(20)} | {20: ["hub1"], 21: ["leaf0000", "leaf0003"], 22: ["leaf0000"], 23: ["leaf0001", "hub0", "none"], 24: ["hub1"]}
    start = spark.createDataFrame([(q, k) for q, ks in asked.items() for k in ks], "question_id int, key string")
    for limit in (6, 60):
        got = {}
        for r in graph.bounded_bfs(start, rows, mentions, 3, limit).collect():
            got.setdefault(r.question_id, []).append((r.chunk_id, r.hops, r.matched, tuple(r.entities)))
        assert {q: sorted(x) for q, x in got.items()} == {q: x for q, ks in asked.items() if (x := _plain_bfs(ks, rel, men, 3, limit))}


def test_bfs_keeps_no_frontier_for_each_question(spark, monkeypatch):
    """Questions around one hub share its frontier: nothing of questions times neighbours is written."""
    rel = spark.createDataFrame([(f"leaf{i:03}", "p", "hub", "x", 0.5) for i in range(150)], "head_key string, predicate string, tail_key string, chunk_id string, confidence double")
    men = spark.createDataFrame([(f"leaf{i:03}", f"c{i:03}") for i in range(150)], "key string, chunk_id string")
    start = spark.createDataFrame([(i, f"leaf{i:03}") for i in range(150)], "question_id int, key string")
    seen = []

    def counted(df):
        df = df.localCheckpoint()
        seen.append(df.count())
        return df

    for name in ("cut", "written"):
        monkeypatch.setattr(graph, name, counted, raising=False)
    assert graph.bounded_bfs(start, rel, men, 2, 3).count() == 3 * 150 and max(seen) <= 3 * 150


def test_bootstrap_is_seeded(spark):
    p = spark.createDataFrame([(i, float(i % 3 - 1)) for i in range(30)], "sample_id int, gain double")
    a, b = evaluation.bootstrap(p).first(), evaluation.bootstrap(p.repartition(5)).first()
    assert a == b and a.lower < a.estimate < a.upper
    h = evaluation.hashed_bootstrap(p, iterations=400).first()
    assert abs(h.lower - a.lower) < 0.2 and abs(h.upper - a.upper) < 0.2


def test_bootstrap_draws_as_the_plain_generator():
    """Blocks of draws are the generator's own, sums rounded once; a million draws take no second each."""
    import random
    import statistics
    import time

    import numpy as np

    for n in (1, 2, 7, 8, 1000):
        for gains in ([float(i % 3 - 1) for i in range(n)], [i / 7 - 0.1 for i in range(n)], [1e16, 1.0, -1e16][:n] * max(1, n // 3)):
            g, m = random.Random(5), len(gains)
            want = [statistics.fmean(gains[g.randrange(m)] for _ in range(m)) for _ in range(300)]
            assert evaluation._resampled(np.array(gains), 300, 5) == want
    began = time.perf_counter()
    evaluation._resampled(np.arange(100_000) % 3 - 1.0, 200, 42)
    assert time.perf_counter() - began < 3  # 20 million; a plain loop takes more than that


# -- sources ---------------------------------------------------------------------------

HTML = "<h1>Title</h1><p>one</p><script>no</script><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td>lost</tr></table><h2>Next</h2>two &amp; three"


def office(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


W = "xmlns:w='w'"
FILES = {
    "a.html": HTML.encode(),
    "b.json": b'{"a": {"b": [1, "x"]}, "e": {}, "q\'r": null}',
    "c.jsonl": b'{"a": 1}\n\n{"b": 2}\n',
    "d.xml": b"<r k='1'><s>t</s><s z='2' y='3'/></r>",
    "e.csv": "\n".join(f"{i},v{i}" for i in range(45)).encode(),
    "f.md": b"intro\n# One\ntext\n## Two ##\n\n# one\nagain\n",
    "g.txt": "数据".encode("gb18030"),
    "h.docx": office({"word/document.xml": f"<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"}),
    "i.xlsx": office({"xl/workbook.xml": "<workbook><sheets><sheet name='S'/><sheet name='T'/></sheets></workbook>", "xl/sharedStrings.xml": "<sst><si><t>hi</t></si></sst>", "xl/worksheets/sheet1.xml": "<worksheet><sheetData><row><c t='s'><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>", "xl/worksheets/sheet2.xml": "<worksheet><sheetData><row><c><v>7</v></c></row></sheetData></worksheet>"}),
    "j.pptx": office({"ppt/slides/slide1.xml": "<p:sld xmlns:p='p' xmlns:a='a'><p:sp><a:p><a:r><a:t>hello</a:t></a:r></a:p></p:sp></p:sld>"}),
    "k.png": b"\x89PNG\r\n",
    "l.exe": b"MZ",
    "m.xml": b"<!DOCTYPE x [<!ENTITY e SYSTEM 'file:///etc/passwd'>]><x>&e;</x>",
    "n.txt": b"  ",
}


def test_formats(spark, tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    got: dict[str, list] = {}
    for r in sources.read_units(spark, str(tmp_path)).orderBy("path", "unit_seq").collect():
        got.setdefault(r.path.rpartition("/")[2], []).append(r)
    text = {k: [r.content for r in v] for k, v in got.items()}
    assert text["a.html"] == ["Title\none", "A | B\n1 | 2", "Next\ntwo & three"] and got["a.html"][2].section == "h2:Next"
    assert text["b.json"] == ["$['a']['b'][0] = 1", "$['a']['b'][1] = \"x\"", "$['q\\'r'] = null"]
    assert text["c.jsonl"] == ["$[0]['a'] = 1", "$[2]['b'] = 2"]
    assert text["d.xml"] == ["/r[1] = @k=1", "/r[1]/s[1] = t", "/r[1]/s[2] = @y=3 @z=2"]
    assert [(r.row_start, r.row_end) for r in got["e.csv"]] == [(1, 20), (21, 40), (41, 45)]
    assert [r.section for r in got["f.md"]] == ["preamble", "One", "Two", "one"] and got["f.md"][3].unit_id.endswith(":1")
    assert text["g.txt"] == ["数据"]
    assert text["h.docx"] == ["x | y", "Head\nbody"] and text["j.pptx"] == ["hello"]
    assert [(r.sheet, r.row_start, r.content) for r in got["i.xlsx"]] == [("S", 1, "hi | 5"), ("T", 2, "7")]
    assert text["k.png"] == ["[image without text]"]
    assert "unsupported" in got["l.exe"][0].error and "entities" in got["m.xml"][0].error and got["n.txt"][0].error == "no content"


def test_upload_rejects(spark):
    df = spark.createDataFrame([("a.pdf", b"%PDF-1"), ("b.pdf", b"nope"), ("c.exe", b"x"), ("d.txt", b""), ("e.txt", b"fine")], "path string, content binary")
    got = {r.path: r.reason for r in sources.upload_rejects(df).collect()}
    assert got == {"b.pdf": "signature mismatch", "c.exe": "unsupported type", "d.txt": "empty"}


def test_stream_equals_batch(spark):
    from quillspark.plans import streamed

    sf = "/root/testdata/sf0.001"
    batch = cdc.debounce(spark.read.parquet(f"{sf}/events.parquet"), "user_id", "ts", "event_id", 86400.0)
    assert sorted(r.event_id for r in streamed.stream_debounce(spark, sf).collect()) == sorted(r.event_id for r in batch.collect())


def test_stream_equals_batch_when_a_quarter_has_many_files(spark, tmp_path):
    """Files of one quarter hold mixed times; the number of batches doesn't grow with them."""
    from quillspark.plans import streamed

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"))  # a task for each file
    try:
        got = sorted(r.event_id for r in streamed.stream_debounce(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
    assert got == sorted(r.event_id for r in cdc.debounce(e, "user_id", "ts", "event_id", 86400.0).collect())


def test_stream_applies_events_once(spark, tmp_path):
    from quillspark.streaming import changes

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.limit(50).write.parquet(f"{tmp_path}/in/a")
    e.limit(80).write.parquet(f"{tmp_path}/in/b")
    seen = []
    for run in range(2):
        stream = changes.read_events(spark, f"{tmp_path}/in/*")
        changes.apply_once(stream, f"{tmp_path}/ledger", lambda df: seen.extend(r.event_id for r in df.select("event_id").collect()), f"{tmp_path}/state{run}").awaitTermination()
    assert len(seen) == len(set(seen)) > 0


def test_directory_watch_and_publish(spark, tmp_path):
    from quillspark.streaming import changes

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x")
    q = changes.watch(spark, f"{tmp_path}/in").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 1 and out.first().path.endswith("a.txt")
    changes.publish(out, f"{tmp_path}/pub", "path")
    assert spark.read.json(f"{tmp_path}/pub").columns == ["key", "value"]


def test_preparation(spark):
    from quillspark.operators import preparation as P

    a = P.articles(spark.createDataFrame([(0, "", "T", "http://x/1", "b", "s"), (1, "", "T2", "http://x/1", "b", "s"), (2, "id 9", "", "", "b", "s")], "n int, id string, title string, url string, body string, source string"))
    ids = {r.n: r.doc_id for r in a.collect()}
    assert ids == {0: "http-x-1", 1: "http-x-1-0001", 2: "id-9"}
    cases = spark.createDataFrame([("q1", "x", [("T", ""), ("?", "http://x/1")]), ("q2", "null_query", [("T", "")]), ("q3", "x", [])], "sample_id string, category string, evidence array<struct<title:string,url:string>>")
    r = {x.sample_id: x for x in P.resolve_evidence(cases, a).collect()}
    assert r["q1"].evidence_doc_ids == ["http-x-1", "http-x-1-0001"] and r["q2"].unanswerable and r["q3"].unanswerable
    top = P.evidence_documents(P.resolve_evidence(cases, a), 1)
    assert top.first()[:] == ("http-x-1", 2)
    assert [x.sample_id for x in P.contained(P.resolve_evidence(cases, a), top).collect()] == ["q2"]
    est = P.estimate(spark.createDataFrame([(700,), (20,)], "tokens int"), spark.createDataFrame([(30, "retrieval"), (35, "answer")], "tokens int, kind string")).first()
    assert (est.chunks, est.chat_calls, est.embedding_calls, est.embedding_tokens) == (3, 6, 4, 850)
    files = spark.createDataFrame([("b", bytearray(b"2")), ("a", bytearray(b"1"))], "path string, content binary")
    assert P.tree_hash(files).first() == P.tree_hash(files.orderBy("path")).first()
    rec = spark.createDataFrame([(f"{i:03}", 1.0, 0.9 if i < 10 else 0.1, 5.0) for i in range(40)], "sample_id string, em double, recall double, ms double")
    g = spark.createDataFrame([("em", "min", 0.5), ("recall", "min", 0.5), ("p95", "max", 9.0)], "name string, direction string, limit double")
    e = {(x.stage, x.name): (x.passed, x.open) for x in P.experiment(rec, g, (10, 20, 40)).collect()}
    assert e[10, "recall"] == (True, True) and e[20, "recall"][1] and e[40, "recall"] == (False, e[40, "em"][1])
    assert "| --- |" in P.report(g, "Gates")


@pytest.mark.parametrize(("supported", "claimed", "want"), [([True, True], "yes", "yes"), ([True, False], "yes", "abstain"), ([True, None], "no", "abstain"), ([True, True], "no", "no"), ([], "yes", "abstain"), ([True], "unknown", "abstain")])
def test_verdict(spark, supported, claimed, want):
    df = spark.createDataFrame([(supported, claimed)], "s array<boolean>, c string")
    assert df.select(ev.verdict(F.col("s"), F.col("c")).alias("v")).first().v == want


def test_cer_query_against_plain_python(spark):
    """Whole answers, normalised, of all neighbouring pairs."""
    import re
    import unicodedata

    from quillspark.plans import catalog

    def plain(t):
        return re.sub(r"[^\w\u3400-\u9fff.%-]+", "", unicodedata.normalize("NFKC", t).lower())

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    sf = "/root/testdata/sf0.001"
    texts = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {i: round(distance(t, texts[i + 1]) / len(texts[i + 1]), 6) for i, t in texts.items() if i + 1 in texts}
    assert {r.item_id: r.cer for r in catalog.queries()["cer"](spark, sf).collect()} == want


@pytest.mark.parametrize("text, value", [("2 + 3 * 4", 14), ("(2 + 3) * 4", 20), ("-2 ** 2", -4), ("2 ** -1", 0.5), ("2 ** 3 ** 2", 512), ("7 // 2 % 2", 1), ("10 - 3 - 4", 3), ("- - 2", 2), (".5 + 1e3", 1000.5), ("2 * -3 + 1", -5), ("8 / 4 / 2", 1)])
def test_calculate_binds_as_arithmetic_does(text, value):
    from quillspark.functions.metrics import calculate

    assert calculate(text) == value == eval(text)  # noqa: S307


@pytest.mark.parametrize("text", ["", None, "2 +", "(2", "2)", "2 3", "a + 1", "1 / 0", "2 ** 999", "10 ** 101", "2,3", "()", "*2", "__import__('os')", "1" * 201, "(-8) ** 0.5"])
def test_calculate_refuses(text):
    from quillspark.functions.metrics import calculate

    assert calculate(text) is None


def test_html_events():
    from quillspark.sources.documents import html_units

    page = "<p>lead</p><script>x</script><h1>A <b>B</b></h1>one<h2>C</h2><table><tr><th>h</th><td>v <i>w</i></td></tr><tr><td></td><td>z</td></tr></table>after<style>s<svg>t</svg></style>end"
    got = [(u["unit_id"], u["content"], u.get("section")) for u in html_units(page)]
    assert got == [("section:1", "lead", ""), ("section:2", "A B\none", "h1:A B"), ("section:3", "C", "h2:C"), ("table:1", "h | v w\n | z", None), ("section:4", "after\nend", "h2:C")]


def test_word_counts_are_those_of_str_count():
    import random

    import numpy as np

    from quillspark.operators.lexical import counter

    r = random.Random(3)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 4))) for _ in range(14)})
    count = counter(words)
    for _ in range(300):
        text, into = "".join(r.choice("abc") for _ in range(r.randint(0, 30))), np.zeros(len(words))
        count(text, into)
        assert into.tolist() == [text.count(w) for w in words]
