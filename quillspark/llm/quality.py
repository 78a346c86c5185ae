"""Quality rules: a table of thresholds compiled into one projection.

Everything is built from Spark's own functions; there is no user function on the
path. Ratios are compared as integers (``100 * a > p * b``), so no rounding decides.

Defined results: a null text has no words and fails; an empty text likewise; rows that
repeat are judged one by one; an empty table gives an empty table; columns of the input
that carry the name of a result are not read and not returned by ``judge``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.shared import text_or_empty

GAPS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for it with as was on be by are this from at or an he "
    "der die und das ist nicht ein eine mit von zu den auf für im sich des dem auch "
    "le la les de et des est une un que en du dans pour qui sur pas au "
    "el los las y del se con por una es lo como más su al o"
).split()
#: As they stand in a sentence and at its start.
STOP_FORMS = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})


@dataclass(frozen=True)
class Rule:
    """A document fails when ``100 * part > percent * whole`` (``most``) or, for a
    floor, when ``100 * part < percent * whole``."""

    name: str
    part: str
    whole: str
    percent: int
    floor: bool = False

    def failed(self) -> Column:
        part, limit = F.col(self.part) * 100, F.col(self.whole) * self.percent
        return part < limit if self.floor else part > limit


#: The production thresholds. Lengths come first, then symbols, stop words and lines.
RULES = (
    Rule("words_too_short", "__word_chars", "__n_words", 200, floor=True),
    Rule("words_too_long", "__word_chars", "__n_words", 1500),
    Rule("symbols", "__n_symbols", "__n_words", 50),
    Rule("few_stop_words", "__n_stop", "__n_words", 3, floor=True),
    Rule("repeated_lines", "__n_dup_lines", "__n_lines", 50),
)


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts, in columns whose names begin with two underscores.

    Arrays that several expressions use stand in a projection of their own, so that
    they are made once for each row.
    """
    t = text_or_empty(text)
    df = df.withColumn("__text", t)
    lines = F.filter(F.split("__text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = df.select(
        "*",
        F.array_remove(F.split("__text", GAPS, -1), "").alias("__words"),
        lines.alias("__lines"),
        F.regexp_count("__text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("__n_symbols"),
    )
    words, n = F.col("__words"), F.size("__words")
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    windows = F.slice(hashes, 1, F.greatest(n - 2, F.lit(0)))
    df = df.select(
        *[c for c in df.columns if c not in ("__words", "__lines", "__text")],
        n.cast("long").alias("__n_words"),
        F.size(F.filter("__words", lambda w: w.isin(STOP_FORMS))).cast("long").alias("__n_stop"),
        F.length(F.array_join("__words", "")).cast("long").alias("__word_chars"),
        F.size("__lines").cast("long").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__n_dup_lines"),
        windows.alias("__windows"),
    )
    # Windows are told apart by 64-bit hashes: for a text of 20,000 words the chance of a
    # wrong count is about 1e-11. Only texts in which a window comes twice are sorted.
    again = F.size(F.array_distinct("__windows")) < F.size("__windows")
    order = F.when(again, F.sort_array(F.transform("__windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    df = df.select(*[c for c in df.columns if c != "__windows"], order.alias("__sorted"))
    s = F.col("__sorted")
    near = lambda i: F.get(s, i)["w"]
    twice = F.filter(s, lambda e, i: F.coalesce(near(i - 1) == e["w"], F.lit(False)) | F.coalesce(near(i + 1) == e["w"], F.lit(False)))
    df = df.select(*[c for c in df.columns if c != "__sorted"], F.sort_array(F.transform(twice, lambda e: e["i"])).alias("__at"))
    at = F.col("__at")
    covered = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    # A column that isn't deterministic keeps later filters above this projection; below it
    # they would hold all of these expressions within each other.
    hold = F.monotonically_increasing_id().alias("__hold")
    return df.select(*[c for c in df.columns if c != "__at"], F.coalesce(total, F.lit(0)).cast("long").alias("__n_repeat_words"), hold)


def verdict(rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(base_failed, kept) over the columns of ``measured``."""
    base = (F.col("__n_words") < 50) | (F.col("__n_repeat_words") * 100 > F.col("__n_words") * 50) | (F.col("__hold") < 0)
    failed = base
    for rule in rules:
        failed = failed | rule.failed()
    return base, ~failed


def judge(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, kept, and the names of the rules that failed."""
    m = measured(df.select(F.col(doc_id).alias("__doc_id"), F.col(text).alias("__in")), "__in")
    base, kept = verdict(rules)
    names = F.filter(F.array(*[F.when(r.failed(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop", "n_lines")
    return m.select(F.col("__doc_id").alias(doc_id), *[F.col(f"__{c}").alias(c) for c in counts], base.alias("base_failed"), kept.alias("kept"), names.alias("reasons"))


def keep(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns as they were."""
    columns = df.columns
    inner = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), F.col(text).alias("__in"))
    return measured(inner, "__in").where(verdict(rules)[1]).select("__row.*")
