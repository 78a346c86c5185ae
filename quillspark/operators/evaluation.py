"""Evaluation analytics: summaries, gains, gates, samples, the bootstrap."""

from __future__ import annotations

import math
import random
import statistics
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean(c: Column) -> Column:
    """Mean without nulls, 0 if there is nothing."""
    return F.coalesce(F.avg(c), F.lit(0.0))


def summary(records: DataFrame, mode: str, category: str, metrics: list[str], latency: str) -> DataFrame:
    """By mode and by category and mode in one pass: cases, means, p50 and p95."""
    m, c = F.col(mode), F.col(category)
    numbers = [F.count("*").alias("cases"), *[F.round(mean(F.col(x)), 6).alias(f"mean_{x}") for x in metrics]]
    numbers += [F.round(F.percentile(latency, F.lit(q)), 6).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95))]
    return records.groupingSets([[m], [c, m]], c, m).agg(*numbers)


def binary_f1(rows: DataFrame, key: list[str], predicted: str, actual: str) -> DataFrame:
    from quillspark.functions.metrics import f1_from_counts

    p, a = F.col(predicted), F.col(actual)
    g = rows.groupBy(*key).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"))
    return g.withColumn("f1", F.round(f1_from_counts(F.col("tp"), F.col("fp"), F.col("fn")), 6))


def token_f1(pairs: DataFrame, key: str, predicted: str, expected: str) -> DataFrame:
    """(key, f1) of token arrays, as multisets."""
    one = lambda c: pairs.select(key, F.explode(c).alias("t")).groupBy(key, "t").agg(F.count("*").alias("n"))
    both = one(predicted).withColumnRenamed("n", "a").join(one(expected).withColumnRenamed("n", "b"), [key, "t"])
    shared = both.groupBy(key).agg(F.sum(F.least("a", "b")).alias("shared"))
    j = pairs.select(key, F.size(predicted).alias("na"), F.size(expected).alias("nb")).join(shared, key, "left")
    s = F.coalesce("shared", F.lit(0))
    p, r = s / F.col("na"), s / F.col("nb")
    none = (F.col("na") == 0) & (F.col("nb") == 0)
    return j.select(key, F.round(F.when(none, 1.0).when((F.col("na") == 0) | (F.col("nb") == 0) | (s == 0), 0.0).otherwise(2 * p * r / (p + r)), 6).alias("f1"))


def paired(records: DataFrame, key: str, mode: str, value: str, baseline: str, candidate: str) -> DataFrame:
    """(key, baseline, candidate, gain) for samples that both modes have."""
    p = records.groupBy(key).pivot(mode, [baseline, candidate]).agg(F.first(value))
    p = p.select(key, F.col(baseline).alias("baseline"), F.col(candidate).alias("candidate")).where("baseline is not null and candidate is not null")
    return p.withColumn("gain", F.col("candidate") - F.col("baseline"))


def changes(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count_if(F.col("gain") > 0).alias("improved"), F.count_if(F.col("gain") == 0).alias("tied"), F.count_if(F.col("gain") < 0).alias("worse"), F.round(mean(F.col("gain")), 6).alias("mean_gain"))


def _resampled(gains: np.ndarray, iterations: int, seed: int) -> list[float]:
    """Means of gains drawn with ``random.Random(seed).randrange``, the same draws in the same order.

    ``randrange(n)`` takes the first bits of the generator's next 32, as often as it needs to
    get below n; here blocks of them are taken at once. Sums are rounded once, as ``fmean`` does:
    few different gains are counted and added as fractions."""
    n = len(gains)
    state = random.Random(seed).getstate()[1]
    twister = np.random.MT19937()
    twister.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], dtype=np.uint32), "pos": state[-1]}}
    bits, shift = np.random.Generator(twister), np.uint32(32 - n.bit_length())
    values, codes = np.unique(gains, return_inverse=True)
    counted = len(values) <= 256 and bool(np.isfinite(values).all())
    known, exact = codes.astype(np.uint8), [Fraction(x) for x in values.tolist()] if counted else []
    means, drawn = [], np.empty(0, dtype=np.uint32)
    for _ in range(iterations):
        left, counts, sample = n, np.zeros(len(values), dtype=np.int64), []
        while left:
            if not len(drawn):
                drawn = bits.integers(0, 0xFFFFFFFF, size=1 << 17, dtype=np.uint32, endpoint=True) >> shift
                drawn = drawn[drawn < n]
            now, drawn = drawn[:left], drawn[left:]
            left -= len(now)
            if counted:
                counts += np.bincount(known[now], minlength=len(values))
            else:
                sample += gains[now].tolist()
        means.append((float(sum(x * c for x, c in zip(exact, counts.tolist(), strict=True))) if counted else math.fsum(sample)) / n)
    return means


def bootstrap(pairs: DataFrame, key: str = "sample_id", iterations: int = 2000, seed: int = 42) -> DataFrame:
    """(estimate, lower, upper, samples): the seeded resampling of paired gains.

    The sequence of a seeded generator is sequential by nature; a benchmark's gains (one
    double for each case) go to one task in key order, which draws them in blocks."""

    def run(batches):
        parts = [b["gain"].to_numpy(dtype=np.float64) for b in batches]
        gains = np.concatenate(parts) if parts else np.empty(0)
        if not len(gains):
            return
        means = sorted(_resampled(gains, iterations, seed))
        at = lambda q: (lambda x, i: means[i] + (means[min(i + 1, len(means) - 1)] - means[i]) * (x - i))((len(means) - 1) * q, int((len(means) - 1) * q))
        yield pd.DataFrame({"estimate": [statistics.fmean(gains)], "lower": [at(0.025)], "upper": [at(0.975)], "samples": [len(gains)]})

    return pairs.select(key, "gain").orderBy(key).coalesce(1).mapInPandas(run, "estimate double, lower double, upper double, samples long")


def hashed_bootstrap(pairs: DataFrame, key: str = "sample_id", iterations: int = 2000, seed: int = 42) -> DataFrame:
    """The distributed form: Poisson weights from a hash of (iteration, key), summed map-side."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "it", F.col(key)), F.lit(1 << 30)) / float(1 << 30)).alias("u")
    w = pairs.select(key, "gain", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("it")).select("it", "gain", u)
    steps = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]
    weight = sum((F.when(F.col("u") >= s, 1).otherwise(0) for s in steps), F.lit(0))
    means = w.groupBy("it").agg((F.sum(F.col("gain") * weight) / F.sum(weight)).alias("m"))
    return means.agg(F.avg("m").alias("estimate"), F.percentile("m", F.lit(0.025)).alias("lower"), F.percentile("m", F.lit(0.975)).alias("upper"))


def gates(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """(name, value, limit, passed): limits say the direction; a missing value is null."""
    j = limits.join(metrics, "name", "left")
    ok = F.when(F.col("direction") == "min", F.col("value") >= F.col("limit")).otherwise(F.col("value") <= F.col("limit"))
    return j.select("name", "value", "limit", ok.alias("passed"))


def round_robin(rows: DataFrame, stratum: str, order: list[Column], n: int) -> DataFrame:
    """n rows, one of each stratum in turn."""
    r = rows.withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)).cast("long"))
    return r.orderBy("turn", stratum).limit(n)


def pending(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")
