"""Jump consistent hashing: a stable key gets its shard without a table of the ring.

The law is ``key``: only doc_id and the number of shards decide. With one shard more, a
row either stays or goes to the new shard, and the fraction 1 / (n + 1) goes. The key is
the 64-bit hash (XXH64, seed 42) of "1" and doc_id, of "0" alone for a null doc_id.

Slots come from a range-sort by (shard, hash of the row, number of the row), so neither a
shard nor a doc_id that a third of all rows share is numbered in one task.

Defined results: a null doc_id is a key like any other; a null text has no bytes and the
checksum of an empty one; rows that repeat get the same shard and slots of their own;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.ordering import running
from quillspark.shared import cut, text_or_empty

SHARDS = 24
# Fixed value: the multiplier of the published generator.
MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key."""
    key = keys.astype(np.uint64).copy()
    last = np.full(len(key), -1, np.int64)
    nxt = np.zeros(len(key), np.int64)
    with np.errstate(over="ignore"):
        while (live := nxt < shards).any():
            last[live] = nxt[live]
            key[live] = key[live] * MULTIPLIER + np.uint64(1)
            step = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
            nxt[live] = ((last[live] + 1) * step).astype(np.int64)
    return last


def stable_key(doc_id: Column) -> Column:
    return F.xxhash64(F.coalesce(F.concat(F.lit("1"), doc_id.cast("string")), F.lit("0")))


def _places(shards: int):
    """An Arrow function of keys: the shard among ``shards``, and among one more."""

    @F.pandas_udf(T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("grown", T.IntegerType())]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = b.to_numpy(np.int64).view(np.uint64)
            yield pd.DataFrame({"shard": jump(keys, shards).astype(np.int32), "grown": jump(keys, shards + 1).astype(np.int32)})

    return run


def place(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot in the shard, and the shard if there were one more."""
    t = text_or_empty(text)
    slim = df.select(
        F.col(doc_id).alias("__doc_id"),
        (F.octet_length(t) + 8).cast("long").alias("__size"),
        F.crc32(t.cast("binary")).cast("long").alias("__crc"),
    )
    slim = slim.withColumn("__place", _places(shards)(stable_key(F.col("__doc_id")))).select("__doc_id", "__size", "__crc", "__place.*")
    slim = cut(slim)  # texts are read once
    out = running(slim.withColumn("__hash", F.xxhash64("__doc_id", "__crc", "__size")), "shard", ["__hash"], "slot")
    return out.select(
        F.col("__doc_id").alias("doc_id"),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        F.col("grown").alias("grown_shard"),
    )


def write(df: DataFrame, path: str, doc_id: str = "doc_id", shards: int = SHARDS) -> None:
    """The rows of ``df`` as Parquet, one folder for each shard."""
    shard = _places(shards)(stable_key(F.col(doc_id)))["shard"]
    df.withColumn("shard", shard).write.partitionBy("shard").parquet(path)
