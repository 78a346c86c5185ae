"""The change stream: debounce as keyed state, and an idempotent sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, schema: str = EVENT, files: int | None = 1) -> DataFrame:
    """Events from a folder of Parquet files, ``files`` at a time or all that are there; the
    schema is fixed, never inferred."""
    stream = spark.readStream.schema(schema)
    return (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(folder)


def debounced(events: DataFrame, path: str = "user_id", seconds: float = 2.0) -> DataFrame:
    """Leading-edge debounce: the state of a path is the time last emitted."""
    gap = int(seconds * 1_000_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else None
        out = []
        for event, ts in zip(rows["event_id"], rows["ts"].astype("datetime64[us]").astype("int64"), strict=True):
            if last is None or ts - last >= gap:
                last = int(ts)
                out.append(int(event))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({path: [key[0]] * len(out), "event_id": out})

    return events.groupBy(path).applyInPandasWithState(step, f"{path} bigint, event_id bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def debounce_into(events: DataFrame, at: str, checkpoint: str, path: str = "user_id", seconds: float = 2.0):
    """``debounced`` for many paths: the state is a table beside what was passed on, so that a
    path costs its rows and no call of its own.

    Batch n is sorted by path and time, the path's last time before its events, folded in one
    run through each task and written as a whole to folder n, where a repeat replaces it. Read
    the result with ``passed_on``."""
    gap = int(seconds * 1_000_000)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = now = object()
        last = None
        for b in batches:
            out = []
            for p, event, ts, state in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if p != now:
                    if now is not none:
                        out.append((now, None, last, True))
                    now, last = p, None
                if state:
                    last = ts
                elif last is None or (ts is not None and ts - last >= gap):
                    last = ts
                    out.append((p, event, ts, False))
            yield made(out)
        if now is not none:
            yield made([(now, None, last, True)])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [(path, pa.int64()), ("event_id", pa.int64()), ("at", pa.int64()), ("state", pa.bool_())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[k for k, _ in kinds])

    schema = f"{path} bigint, event_id bigint, at bigint, state boolean"

    def batch(df: DataFrame, number: int) -> None:
        rows = df.select(path, "event_id", F.unix_micros("ts").alias("at"), F.lit(False).alias("state"))
        if number:
            rows = rows.unionByName(df.sparkSession.read.schema(schema).parquet(f"{at}/{number - 1}").where("state"))
        rows = rows.repartition(path).sortWithinPartitions(path, F.col("state").desc(), "at", "event_id")
        rows.mapInArrow(fold, schema).write.mode("overwrite").parquet(f"{at}/{number}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def passed_on(spark: SparkSession, at: str, path: str = "user_id") -> DataFrame:
    """(path, event_id) of all batches that ``debounce_into`` has written."""
    return spark.read.schema(f"{path} bigint, event_id bigint, state boolean").parquet(f"{at}/*").where("not state").select(path, "event_id")


def apply_once(stream: DataFrame, ledger: str, apply: Callable[[DataFrame], None], checkpoint: str, key: str = "event_id"):
    """Runs ``apply`` on the events of each micro-batch that the ledger doesn't have yet.

    The ledger is a table that only grows; a batch's events are added after ``apply``. A
    batch that is repeated after a failure applies only what isn't committed; ``apply``
    itself has to be safe to repeat."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        once = df.dropDuplicates([key])
        try:
            done = spark.read.parquet(ledger)
            once = once.join(done.select(key), key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        once = once.persist()
        try:
            apply(once)
            once.select(key).write.mode("append").parquet(ledger)
        finally:
            once.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Events from Kafka, where its connector is installed: earliest offsets, JSON values."""
    schema = "event_id string, operation string, doc_id string, file_path string, observed_hash string, timestamp double"
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*")


def publish(events: DataFrame, path: str, key: str = "event_id") -> None:
    """Events as (key, JSON value), the shape that a Kafka sink takes, to a folder."""
    events.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*events.columns)).alias("value")).write.mode("append").json(path)


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """New and changed files below a folder as a stream (path, content_hash, ts); deletes come
    from comparing listings."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return files.select("path", F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("ts"))
