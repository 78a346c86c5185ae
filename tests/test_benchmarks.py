"""Benchmark suites on small cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark import benchmarks as B
from quillspark.engine import Engine, doc_id_of
from quillspark.operators import preparation


def test_parse_suite(spark):
    files = B.parse_files(spark)
    assert files.count() == 70 and files.where("condition = 'disturbed'").count() == 14
    got = B.run_parse(files).groupBy("category").agg(F.avg("recall").alias("r")).collect()
    assert len(got) == 7 and all(x.r == 1.0 for x in got)


def test_suites_run_and_fail_apart(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}", buckets=3)
    versions = [{"/d/a.txt": "Ada Works sells lamps.", "/d/b.txt": "Bob Works sells pans."}, {"/d/a.txt": "Ada Works sells red lamps."}]
    frames = [spark.createDataFrame([(p, bytearray(t.encode())) for p, t in v.items()], "path string, content binary") for v in versions]
    cases = spark.createDataFrame([(1, "who sells lamps", "factoid", "Ada Works sells red lamps.", "/d/a.txt")], "sample_id int, question string, category string, answer string, path string").withColumn("expected", F.array(doc_id_of(F.col("path"))))
    tree = preparation.tree_hash(frames[0]).first()["tree"]

    def broken():
        raise OSError("down")

    suites = {"changes": lambda: B.run_changes(e, frames), "broken": broken, "retrieval": lambda: B.run_retrieval(e, cases, ("vector",)), "answers": lambda: B.run_answers(e, cases, ("vector",))}
    records, log = B.run_all(suites, frames[0], tree)
    assert {r.suite: (r.attempts, r.error) for r in log.collect()} == {"changes": (1, None), "broken": (3, "OSError: down"), "retrieval": (1, None), "answers": (1, None)}
    assert [(r.sample_id, r.committed, r.chunks) for r in records["changes"].orderBy("sample_id").collect()] == [("v0", 1.0, 2), ("v1", 1.0, 1)]
    assert records["retrieval"].first()["recall"] == 1.0 and records["answers"].first()["em"] == 1.0
    with pytest.raises(ValueError):
        B.run_all(suites, frames[1], tree)
