"""A quality classifier: a sparse ensemble of rules over statistics of the text.

Statistics are Spark columns. On a bounded sample of labelled rows (SAMPLE, drawn by a
hash of doc_id) small trees are boosted; every path from a root is a rule, a conjunction
of comparisons; a lasso-penalised logistic regression gives the rules weights, most of
them zero; those left are compiled into one Spark column expression. Scoring thus runs
no Python. Labels, lang, source and doc_id are no inputs of a score.

Defined results: a null text counts as empty; empty texts have a score too; labels that
are null, or whose document is missing, teach nothing; with no labels, or labels of one
kind, every score is that share (0.5 with none); of documents that share a labelled doc_id
the one with the least statistics teaches; rows that repeat are scored one by one; an
empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.quality import GAPS, SPACES, STOP_FORMS
from quillspark.shared import text_or_empty

#: The most labelled rows that are learnt from.
SAMPLE = 20_000
TREES, DEPTH, BINS, PENALTY = 40, 3, 48, 0.0015
PREDICT = 0.7

FEATURES = ("words", "word_length", "distinct", "stops", "capitals", "digits", "symbols", "bars", "bangs", "stops_marks", "commas", "lines", "repeated_lines", "ascii")


def statistics(df: DataFrame, text: str) -> DataFrame:
    """``df`` with one double for each of FEATURES, named ``__f_...``."""
    count = lambda chars: F.regexp_count("__t", F.lit(f"[{chars}]")).cast("double")
    df = df.withColumn("__t", text_or_empty(text))
    df = df.select("*", F.array_remove(F.split("__t", GAPS, -1), "").alias("__w"), F.filter(F.split("__t", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("__l"))
    n = F.greatest(F.size("__w"), F.lit(1)).cast("double")
    chars = F.greatest(F.length(F.array_join("__w", "")), F.lit(1)).cast("double")
    lines = F.greatest(F.size("__l"), F.lit(1)).cast("double")
    made = {
        "words": F.size("__w").cast("double"),
        "word_length": chars / n,
        "distinct": F.size(F.array_distinct("__w")) / n,
        "stops": F.size(F.filter("__w", lambda w: w.isin(STOP_FORMS))) / n,
        "capitals": count("A-Z") / chars,
        "digits": count("0-9") / chars,
        "symbols": count(r"#*$%&<>@\^~=+_\\{}\[\]") / n,
        "bars": count("|") / n,
        "bangs": count("!?") / n,
        "stops_marks": count(".;:") / n,
        "commas": count(",") / n,
        "lines": lines / n,
        "repeated_lines": (F.size("__l") - F.size(F.array_distinct("__l"))) / lines,
        "ascii": F.octet_length("__t") / F.greatest(F.length("__t"), F.lit(1)),
    }
    keep = [c for c in df.columns if c not in ("__t", "__w", "__l")]
    return df.select(*keep, *[made[f].cast("double").alias(f"__f_{f}") for f in FEATURES])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Rule:
    """All of (feature, above, threshold): the value is above the threshold or not."""

    parts: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, t in self.parts:
            out &= (x[:, f] > t) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for f, above, t in self.parts:
            c = F.col(f"__f_{FEATURES[f]}")
            out = out & ((c > t) if above else (c <= t))
        return F.when(out, F.lit(self.weight)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule in self.rules:
            total = total + rule.column()
        return 1 / (1 + F.exp(-total))


def _grow(binned: np.ndarray, edges: list[np.ndarray], x_grad: np.ndarray, x_hess: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """One tree: the paths to all of its nodes, and each row's value."""
    paths, value = [], np.zeros(len(binned))
    todo = [(np.arange(len(binned)), ())]
    while todo:
        rows, path = todo.pop()
        g, h = x_grad[rows].sum(), x_hess[rows].sum()
        value[rows] = -g / (h + 1.0)
        if path:
            paths.append(path)
        if len(path) >= DEPTH or len(rows) < 20:
            continue
        best = (1e-6, -1, -1)
        for f in range(binned.shape[1]):
            k = len(edges[f]) + 1
            gs = np.cumsum(np.bincount(binned[rows, f], x_grad[rows], k))[:-1]
            hs = np.cumsum(np.bincount(binned[rows, f], x_hess[rows], k))[:-1]
            if not len(gs):
                continue
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), f, i)
        _, f, i = best
        if f < 0:
            continue
        above = binned[rows, f] > i
        if not above.any() or above.all():
            continue
        t = float(edges[f][i])
        todo += [(rows[above], (*path, (f, True, t))), (rows[~above], (*path, (f, False, t)))]
    return paths, value


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost, take the paths as rules, and weigh them with a lasso."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.02, 0.98)) if len(y) else 0.5
        return Model(float(np.log(share / (1 - share))), ())
    edges = []
    for f in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        edges.append(q[q < x[:, f].max()])
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    at = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[tuple, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-at))
        paths, value = _grow(binned, edges, p - y, p * (1 - p))
        rules |= dict.fromkeys(paths)
        at += 0.3 * value
    made = [Rule(p) for p in rules]
    m = np.stack([r.holds(x) for r in made], axis=1).astype(np.float64) if made else np.zeros((len(y), 0))
    mean = m.mean(axis=0)
    use = np.flatnonzero((mean > 0) & (mean < 1))
    made, m = [made[i] for i in use], m[:, use]
    # Accelerated proximal gradients; the bias has no penalty.
    w, b = np.zeros(m.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    v, vb, t = w.copy(), b, 1.0
    u = np.ones(m.shape[1] + 1)
    for _ in range(20):  # the largest curvature, by power iteration
        z = m @ u[:-1] + u[-1]
        u = np.append(m.T @ z, z.sum())
        top = np.linalg.norm(u)
        u /= top
    step = 4.0 * len(y) / (top * 1.05)
    for _ in range(600):
        r = (1 / (1 + np.exp(-(m @ v + vb))) - y) / len(y)
        new = v - step * (m.T @ r)
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        new_b = vb - step * r.sum()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return Model(float(b), tuple(Rule(r.parts, float(x)) for r, x in zip(made, w, strict=True) if abs(x) > 1e-6))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled rows that aren't held out."""
    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("double").alias("__y")).where(F.col("__y").isNotNull() & F.col("__id").isNotNull() & ~held_out(F.col("__id")))
    known = known.distinct().orderBy(F.md5(F.col("__id").cast("string")), "__id", "__y").limit(sample)
    some = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text"))
    # The sample's rows are bounded by a parameter, so they may be sent to all executors.
    found = statistics(some.join(F.broadcast(known), F.col("__doc") == F.col("__id")), "__text")
    # A label whose doc_id repeats among the documents teaches one of them: at most ``sample`` rows come back.
    one = found.groupBy("__id", "__y").agg(F.min(F.struct(*[f"__f_{f}" for f in FEATURES])).alias("x")).select("__id", "__y", "x.*")
    rows = one.toPandas().sort_values(["__id", "__y"])
    return fit(rows[[f"__f_{f}" for f in FEATURES]].to_numpy(float), rows["__y"].to_numpy(float))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    s = statistics(docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text")), "__text")
    s = s.select("__doc", model.score().alias("__score"))
    return s.select(
        F.col("__doc").alias("doc_id"),
        held_out(F.col("__doc")).alias("held_out"),
        F.col("__score").alias("score"),
        F.when(F.col("__score") >= PREDICT, 1).otherwise(0).alias("predicted"),
    )
