"""The pipeline's stages, each judged on its own input, and its queries' SQL."""

from __future__ import annotations

import corpus_pipeline as P
import pytest
from compare import differences, duck
from pyspark.sql import functions as F

from quillspark.llm import catalog, mixing, pii, quality, simhash

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in P.STAGES:
        stage(spark, seen[-1], SF).write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
    raw, good, single, masked, mixed, packed = seen
    for df in seen[1:-1]:
        assert df.columns == COLUMNS
    kept = quality.judge(raw).where("kept").select("doc_id")
    assert {r[0] for r in good.select("doc_id").collect()} == {r[0] for r in kept.collect()}
    groups = simhash.near_duplicates(good)
    assert {r[0] for r in single.select("doc_id").collect()} == {r[0] for r in groups.select("component_id").collect()}
    assert single.count() == single.select("doc_id").distinct().count()
    assert masked.count() == single.count()
    assert pii.report(masked).where("spans <> ''").count() == 0
    assert masked.where(F.col("n_chars") != F.length("text")).count() == 0
    taken = mixing.taken(mixing.schedule(masked)).agg(F.sum("taken")).first()[0]
    assert mixed.agg(F.sum(mixing.n_words(F.col("text")))).first()[0] == taken
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    assert packed.where("piece = 0").count() == mixed.count()


def test_run_is_the_stages(spark):
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    a, b = (sorted(tuple(r) for r in P.run(spark, SF).select(*cols).collect()) for _ in range(2))
    assert a == b and a


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, name):
    assert differences(catalog.queries()[name](spark, SF), duck(SF), catalog.oracle_sql()[name]) == []


@pytest.mark.parametrize("kind", ["nothing", "difficult"])
def test_run_on_difficult_tables(spark, docs, nothing, tmp_path, kind):
    """Nulls in every column, repeated rows, clashing column names; and a table without rows."""
    (nothing if kind == "nothing" else docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    if kind == "nothing":
        assert got == []
    else:
        kept = simhash.deduplicate(quality.keep(docs))
        assert kept.columns == docs.columns and {r.doc_id for r in got} <= {r.doc_id for r in kept.collect()}
