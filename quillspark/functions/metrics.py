"""Evaluation metrics as column expressions, and the few that need Python."""

from __future__ import annotations

import operator
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"[-+]?[0-9][0-9,]*(?:\.[0-9]+)?"


def plain_answer(c: Column) -> Column:
    """Lower case, only word characters, CJK, dot, percent and hyphen. (Full NFKC: ``nfkc_answer``.)"""
    return F.regexp_replace(F.lower(c), r"(?U)[^\w\x{3400}-\x{9fff}.%-]+", "")


def normalise_answer(value: str | None) -> str:
    text = unicodedata.normalize("NFKC", str(value or "")).lower()
    return re.sub(r"[^\w㐀-鿿.%-]+", "", text)


@F.pandas_udf(T.StringType())
def nfkc_answer(values: pd.Series) -> pd.Series:
    """Compatibility-normalised answers; Spark has no such function of its own."""
    return values.map(normalise_answer)


def metric_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\x{3400}-\x{9fff}]|[a-z0-9]+(?:[.%-][a-z0-9]+)*"), F.lit(0))


def overlap_accuracy(a: Column, b: Column) -> Column:
    one = lambda c: F.array_remove(F.split(F.lower(c), r"\s+"), "")
    return F.arrays_overlap(one(a), one(b)).cast("double")


def error_rate(prediction: Column, reference: Column) -> Column:
    """Edit distance of the answers, normalised beforehand, over the reference's length; an empty
    reference gives 0 or 1."""
    return F.when(F.length(reference) == 0, F.when(F.length(prediction) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(prediction, reference) / F.length(reference))


def numeric_equal(prediction: Column, reference: Column, tolerance: float = 1e-4) -> Column:
    """First numbers equal within half a unit of the reference's last decimal; else equal as answers."""
    raw = lambda c: F.replace(F.regexp_extract(c, NUMBER, 0), F.lit(","), F.lit(""))
    a, b = raw(prediction).try_cast("double"), raw(reference).try_cast("double")
    decimals = F.length(F.regexp_extract(raw(reference), r"\.([0-9]+)$", 1))
    absolute = F.greatest(F.lit(tolerance), F.when(decimals > 0, 0.5 * F.pow(F.lit(10.0), -decimals)).otherwise(tolerance))
    close = F.abs(a - b) <= F.greatest(absolute, F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b)))
    return F.when(a.isNull() | b.isNull(), (plain_answer(prediction) == plain_answer(reference)).cast("double")).otherwise(close.cast("double"))


def evidence(retrieved: Column, expected: Column) -> tuple[Column, Column]:
    """(recall, all hit) of sets; 1 and 1 where nothing is expected."""
    want = F.array_distinct(expected)
    hits = F.size(F.array_intersect(retrieved, want))
    none = F.size(want) == 0
    return F.when(none, 1.0).otherwise(hits / F.size(want)), F.when(none | (hits == F.size(want)), 1.0).otherwise(0.0)


def citations(cited: Column, expected: Column) -> tuple[Column, Column, Column]:
    """(precision, recall, F1) of sets; null where nothing is expected."""
    have, want = F.array_distinct(cited), F.array_distinct(expected)
    hits, gold = F.size(F.array_intersect(have, want)), F.size(want) > 0
    p = F.when(gold, F.when(F.size(have) > 0, hits / F.size(have)).otherwise(0.0))
    r = F.when(gold, hits / F.size(want))
    return p, r, F.when(gold, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def f1_from_counts(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(2 * tp + fp + fn == 0, 1.0).otherwise(2.0 * tp / (2 * tp + fp + fn))


# What an expression may hold, and how tightly operators bind (the sign of a number
# binds tighter than a product and less than a power).
NUMBER_OR_SIGN = re.compile(r"\s*(?:(\d+(?:\.\d*)?(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?)|(\*\*|//|[-+*/%()]))", re.ASCII)
BINDING = {"+": 1, "-": 1, "*": 2, "/": 2, "//": 2, "%": 2, "sign+": 3, "sign-": 3, "**": 4}
APPLY = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "//": operator.floordiv, "%": operator.mod, "**": operator.pow}


def _tokens(expression: str) -> list[float | int | str]:
    out, at, text = [], 0, expression.rstrip()
    while at < len(text):
        m = NUMBER_OR_SIGN.match(text, at)
        if m is None:
            raise ValueError("not arithmetic")
        out.append(m[2] if m[1] is None else (int(m[1]) if m[1].isdigit() else float(m[1])))
        at = m.end()
    return out


def calculate(expression: str | None) -> float | None:
    """Plain arithmetic on numbers; null for anything else, or for values beyond 1e100.

    Two stacks: numbers wait for operators, operators for others that bind tighter."""
    if not expression or len(expression) > 200:
        return None
    numbers: list[float | int] = []
    waiting: list[str] = []

    def apply() -> None:
        sign = waiting.pop()
        right = numbers.pop()
        if sign.startswith("sign"):
            numbers.append(-right if sign == "sign-" else right)
        elif sign == "(" or (sign == "**" and abs(right) > 400):
            raise ValueError("not arithmetic")
        else:
            numbers.append(APPLY[sign](numbers.pop(), right))
        if isinstance(numbers[-1], complex) or abs(numbers[-1]) > 1e100:
            raise ValueError("range")

    try:
        operand = True  # whether a number is due
        for t in _tokens(expression):
            if not isinstance(t, str):
                if not operand:
                    raise ValueError("not arithmetic")
                numbers.append(t)
                operand = False
            elif operand and t in "+-":
                waiting.append("sign" + t)
            elif operand and t == "(":
                waiting.append(t)
            elif operand or t == "(":
                raise ValueError("not arithmetic")
            elif t == ")":
                while waiting[-1] != "(":
                    apply()
                waiting.pop()
            else:
                # Powers group from the right, all else from the left.
                while waiting and waiting[-1] != "(" and BINDING[waiting[-1]] + (t != "**") > BINDING[t]:
                    apply()
                waiting.append(t)
                operand = True
        if operand:
            raise ValueError("not arithmetic")
        while waiting:
            apply()
        return float(numbers[0])
    except (ValueError, ZeroDivisionError, OverflowError, IndexError):
        return None


@F.pandas_udf(T.DoubleType())
def calculated(expressions: pd.Series) -> pd.Series:
    return expressions.map(calculate).astype("float64")
