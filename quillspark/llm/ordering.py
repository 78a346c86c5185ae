"""Positions in a stable order, without gathering a group in one task.

Rows are range-sorted through all partitions by (group, key, a number of the row). The
number parts rows that are equal in all else, so not even a key that a third of all rows
share is one range: Spark's range partitioner samples the whole tuple. Each partition then
runs a sum of its own; what stood before a partition comes from a table with one row for
each (partition, group), of which there are at most partitions + groups.

The order of unlike rows depends on their keys alone, so reruns and other cluster sizes
agree; rows that are alike in group and key are interchangeable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.shared import cut, small

#: How many low bits of monotonically_increasing_id number a partition's rows.
ROW_BITS = 33


def key_of(*ids: Column, seed: int = 0) -> Column:
    """32 hexadecimal digits; nulls have a place of their own."""
    parts = [F.coalesce(x.cast("string"), F.lit("null")) for x in ids]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def in_order(df: DataFrame, order: list[Column], value: Column | None = None) -> DataFrame:
    """``df``, cut, sorted through all partitions by ``order``, with __part (the partition),
    __value and __run: the sum of ``value`` (1 where none is given) over the partition's rows before."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    if value is None:
        at = F.col("__at")
        numbered = ordered.withColumn("__at", F.monotonically_increasing_id())
        counted = numbered.select("*", F.shiftright(at, ROW_BITS).cast("int").alias("__part"), F.lit(1).cast("long").alias("__value"), at.bitwiseAND((1 << ROW_BITS) - 1).alias("__run"))
        return cut(counted.drop("__at"))
    valued = ordered.withColumn("__value", value.cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            v = b.column("__value").to_numpy()
            upto = before + np.cumsum(v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(v), part, np.int32)), pa.array(upto - v)], names=[*b.schema.names, "__part", "__run"])
            before = int(upto[-1]) if len(v) else before

    more = T.StructType([*valued.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__run", T.LongType())])
    return cut(valued.mapInArrow(run, more))


def running(df: DataFrame, group: str, keys: list[str], into: str, value: Column | None = None) -> DataFrame:
    """Adds ``into``: the sum of ``value`` (not negative; the number, where none is given) over
    the rows of ``group`` that stand before the row in the order of ``keys``. ``df`` is cut: its
    rows' numbers come from its partitions."""
    numbered = df.withColumn("__uid", F.monotonically_increasing_id())
    rows = in_order(numbered, [F.col(c) for c in (group, *keys, "__uid")], value)
    # A group that is null has a name too, so that the join finds it.
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("null")).alias("__g")
    sums = rows.groupBy(named, "__part").agg(F.min("__run").alias("__first"), F.sum("__value").alias("__sum"))
    before = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(sums.select("__g", "__part", (F.coalesce(F.sum("__sum").over(before), F.lit(0)) - F.col("__first")).alias("__offset")))
    joined = rows.select("*", named).join(small(offsets), ["__g", "__part"])
    return joined.withColumn(into, (F.col("__run") + F.col("__offset")).cast("long")).drop("__g", "__part", "__value", "__run", "__offset", "__uid")
