"""Change events: leading-edge debounce, idempotent replay, the claim machine, recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.settings import DEFAULTS

OPERATIONS = {"signup": "INSERT", "purchase": "UPDATE", "view": "UPDATE", "click": "UPDATE", "error": "DELETE"}


def operation(kind):
    """The operation of a change type; others aren't changes."""
    return F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv])[kind]


def debounce(events: DataFrame, path: str, at: str, event_id: str, seconds: float = DEFAULTS.debounce_seconds) -> DataFrame:
    """(path, event_id): an event is emitted if none was in the ``seconds`` before it.

    A fold over a path's events in time order; the state is the last emitted time. A path's
    events meet in one task as (time, id) pairs; long paths belong on the streaming form."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    g = events.groupBy(path).agg(F.array_sort(F.collect_list(F.struct(micros.alias("t"), F.col(event_id).alias("id")))).alias("__e"))
    gap = int(seconds * 1_000_000)
    zero = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("out"))

    def step(acc, e):
        go = acc["last"].isNull() | (e["t"] - acc["last"] >= gap)
        return F.struct(F.when(go, e["t"]).otherwise(acc["last"]).alias("last"), F.when(go, F.concat(acc["out"], F.array(e["id"]))).otherwise(acc["out"]).alias("out"))

    return g.select(path, F.explode(F.aggregate("__e", zero, step, lambda a: a["out"])).alias(event_id))


def fresh(batch: DataFrame, ledger: DataFrame, event_id: str = "event_id") -> DataFrame:
    """Events of a batch that no COMMITTED ledger row has, each once."""
    done = ledger.where("status = 'COMMITTED'").select(event_id)
    return batch.dropDuplicates([event_id]).join(done, event_id, "left_anti")


def claim(events: DataFrame, retries: int = DEFAULTS.retries) -> DataFrame:
    """Ledger rows after a claim: (event_id, status, attempts, claimed)."""
    can = ~F.col("status").isin("COMMITTED", "APPLYING") & (F.col("attempts") < retries)
    return events.select("event_id", F.when(can, "APPLYING").otherwise(F.col("status")).alias("status"), (F.col("attempts") + can.cast("int")).cast("long").alias("attempts"), can.alias("claimed"))


def fold_ledger(attempts: DataFrame, retries: int = DEFAULTS.retries) -> DataFrame:
    """Status of each event after its attempts (event_id, attempt, ok): the first success
    commits, attempts after it don't count; ``retries`` failures fail; else PENDING."""
    first = F.min(F.when(F.col("ok"), F.col("attempt")))
    a = attempts.groupBy("event_id").agg(first.alias("__ok"), F.count("*").alias("__n"))
    committed = F.col("__ok").isNotNull() & (F.col("__ok") <= retries)
    status = F.when(committed, "COMMITTED").when(F.col("__n") >= retries, "FAILED").otherwise("PENDING")
    return a.select("event_id", status.alias("status"), F.least(F.when(committed, F.col("__ok")).otherwise(F.col("__n")), F.lit(retries)).cast("long").alias("attempts"))


def recover(ledger: DataFrame, cutoff) -> DataFrame:
    """APPLYING rows older than the cutoff become FAILED."""
    stale = (F.col("status") == "APPLYING") & (F.col("updated_at") < cutoff)
    return ledger.withColumn("error", F.when(stale, "interrupted").otherwise(F.col("error"))).withColumn("status", F.when(stale, "FAILED").otherwise(F.col("status")))


def last_snapshot(events: DataFrame, doc: str, sequence: str, value: str) -> DataFrame:
    return events.groupBy(doc).agg(F.max_by(value, sequence).alias(value), F.max(sequence).alias(sequence))


def retained(changes: DataFrame) -> DataFrame:
    """(retained, expected, retention) over per-event unchanged counts and what was expected."""
    return changes.agg(F.sum(F.least("unchanged", "expected")).cast("long").alias("retained"), F.sum("expected").cast("long").alias("expected")).withColumn("retention", F.round(F.when(F.col("expected") > 0, F.col("retained") / F.col("expected")).otherwise(1.0), 6))


def ordinal_of(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    return events.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))
