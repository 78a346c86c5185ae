"""Benchmark suites: a generator of files to parse, runners, and all of them with an integrity check.

A suite is a function that returns records (sample_id, mode, category and metrics), which
``operators.evaluation`` sums up and gates. Runners call the engine once for all cases of a
mode, not case by case.
"""

from __future__ import annotations

import io
import json
import time
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.engine import Engine, doc_id_of
from quillspark.functions import metrics as M
from quillspark.operators import evaluation, preparation
from quillspark.shared import cut
from quillspark.sources import documents as sources

FORMATS = ("txt", "md", "csv", "json", "html", "xml", "xlsx")
ATTEMPTS = 3


def _sheet(rows: list[list[str]]) -> bytes:
    """A spreadsheet of inline strings."""
    cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{c}</t></is></c>' for c in r) + "</row>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="Facts"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def parse_files(spark: SparkSession, each: int = 10) -> DataFrame:
    """(path, content, format, condition, expected): ``each`` files of every format, two in ten of
    them disturbed (other line ends, broken spacing); ``expected`` are the facts to be found."""
    rows = []
    for kind in FORMATS:
        for k in range(each):
            facts = [[f"item-{kind}-{k}-{i}", f"value {k * 10 + i}"] for i in range(3)]
            text = {
                "txt": "\n".join(" ".join(f) for f in facts),
                "md": f"# Facts {k}\n" + "\n".join(" ".join(f) for f in facts),
                "csv": "\n".join(",".join(f) for f in facts),
                "json": json.dumps([{"name": a, "value": b} for a, b in facts]),
                "html": f"<h1>Facts {k}</h1><table>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in facts) + "</table>",
                "xml": "<facts>" + "".join(f'<fact name="{a}">{b}</fact>' for a, b in facts) + "</facts>",
            }
            disturbed = k % 10 >= 8
            data = _sheet(facts) if kind == "xlsx" else (text[kind].replace("\n", "\r\n  ") if disturbed and kind in ("txt", "md") else text[kind]).encode("utf-16" if disturbed and kind == "csv" else "utf-8")
            rows.append((f"/parse/{kind}-{k}.{kind}", bytearray(data), kind, "disturbed" if disturbed else "clear", [a for a, _ in facts]))
    return spark.createDataFrame(rows, "path string, content binary, format string, condition string, expected array<string>")


def run_parse(files: DataFrame) -> DataFrame:
    """(sample_id, mode, category, recall, em): the share of each file's facts that its units hold."""
    found = sources.units(files).groupBy("path").agg(F.concat_ws("\n", F.collect_list("content")).alias("__all"))
    j = files.select("path", "format", "condition", "expected").join(found, "path", "left")
    hits = F.size(F.filter("expected", lambda x: F.contains(F.coalesce("__all", F.lit("")), x)))
    recall = hits / F.size("expected")
    return j.select(F.col("path").alias("sample_id"), F.col("condition").alias("mode"), F.col("format").alias("category"), F.round(recall, 6).alias("recall"), (recall == 1).cast("double").alias("em"))


def _by_mode(cases: DataFrame, modes: tuple[str, ...], run: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The results of a run for each mode, over all cases, with the time of one case."""
    asked = cut(cases.select(F.col("sample_id").alias("question_id"), "question"))
    n, out = max(1, asked.count()), None
    for mode in modes:
        began = time.perf_counter()
        got = cut(run(asked, mode))
        part = got.withColumn("mode", F.lit(mode)).withColumn("ms", F.lit((time.perf_counter() - began) * 1000 / n))
        out = part if out is None else out.unionByName(part)
    return out


def run_retrieval(engine: Engine, cases: DataFrame, modes: tuple[str, ...] = ("vector", "graph", "hybrid"), top_k: int = 8) -> DataFrame:
    """(sample_id, mode, category, recall, all_hit, ms) of cases (sample_id, question, category, expected)."""
    found = _by_mode(cases, modes, lambda q, mode: engine.retrieve(q, top_k, mode).groupBy("question_id").agg(F.collect_set("doc_id").alias("docs")))
    grid = cases.select("sample_id", "category", "expected", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
    j = grid.join(found.withColumnRenamed("question_id", "sample_id"), ["sample_id", "mode"], "left")
    recall, hit = M.evidence(F.coalesce("docs", F.array().cast("array<string>")), F.col("expected"))
    return j.select("sample_id", "mode", "category", F.round(recall, 6).alias("recall"), hit.alias("all_hit"), "ms")


def run_answers(engine: Engine, cases: DataFrame, modes: tuple[str, ...] = ("vector", "hybrid"), top_k: int = 8) -> DataFrame:
    """(sample_id, mode, category, em, f1, answerable, ms) of cases that have an ``answer`` too."""
    said = _by_mode(cases, modes, lambda q, mode: engine.ask(q, top_k, mode).select("question_id", "answerable", F.col("answer").alias("said")))
    j = cut(cases.select("sample_id", "category", "answer").join(said.withColumnRenamed("question_id", "sample_id"), "sample_id"))
    j = j.withColumn("key", F.concat_ws("#", F.col("sample_id").cast("string"), "mode"))
    f1 = evaluation.token_f1(j.select("key", M.metric_tokens(F.col("said")).alias("a"), M.metric_tokens(F.col("answer")).alias("b")), "key", "a", "b")
    em = (M.nfkc_answer(F.col("said")) == M.nfkc_answer(F.col("answer"))).cast("double")
    return j.withColumn("em", em).join(f1, "key").select("sample_id", "mode", "category", "em", "f1", "answerable", "ms")


def run_changes(engine: Engine, versions: list[DataFrame], now: float = 0.0) -> DataFrame:
    """(sample_id, mode, committed, chunks): each version (path, content) of all documents is
    applied as one batch of events; a document that is missing in a version is deleted."""
    spark, out = engine.spark, None
    for k, files in enumerate(versions):
        old = engine.documents().select(F.col("file_path").alias("path"), "content_hash")
        new = files.select("path", F.sha2("content", 256).alias("content_hash"))
        from quillspark.operators.diff import captured

        events = cut(captured(old, new).select(F.concat(F.lit(f"v{k}:"), "path").alias("event_id"), "operation", doc_id_of(F.col("path")).alias("doc_id"), F.col("path").alias("file_path"), F.lit("").alias("observed_hash")))
        engine.submit_events(events, now + k)
        ledger = engine.apply_events(files, now + k).join(events.select("event_id"), "event_id", "left_semi")
        done = ledger.agg(F.avg((F.col("status") == "COMMITTED").cast("double")).alias("committed"))
        part = cut(done.select(F.lit(f"v{k}").alias("sample_id"), F.lit("changes").alias("mode"), "committed", F.lit(engine.store.read("chunks").count()).cast("long").alias("chunks")))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "sample_id string, mode string, committed double, chunks long")


def run_all(suites: dict[str, Callable[[], DataFrame]], files: DataFrame, expected_tree: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Records of every suite, and (suite, attempts, error): nothing runs if the prepared files
    aren't those expected (by their tree's hash); a suite that fails is tried three times and
    doesn't keep the others from running."""
    spark = files.sparkSession
    if expected_tree is not None and preparation.tree_hash(files).first()["tree"] != expected_tree:
        raise ValueError("the prepared files aren't those that were expected")
    records, log = {}, []
    for name, suite in suites.items():
        error = None
        for attempt in range(1, ATTEMPTS + 1):
            try:
                records[name], error = cut(suite()), None
                break
            except Exception as e:
                error = f"{type(e).__name__}: {e}"[:300]
        log.append((name, attempt, error))
    return records, spark.createDataFrame(log, "suite string, attempts int, error string")
