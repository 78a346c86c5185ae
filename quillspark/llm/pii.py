"""Personal data: regular expressions propose spans, checksums confirm, context scores.

All of it is built from Spark's own functions. A kind's spans are the leftmost
non-overlapping matches of its pattern; those that fail the kind's check are dropped
and the text is not searched again inside them. Positions count code points.

The four base kinds (email, ip, card, phone) always stay, whatever their score. The
method adds two kinds: ``iban``, as long as its country's numbers and confirmed by mod-97,
and ``ssn``, which needs a context word. Possessive quantifiers and ``\\G`` keep every search linear in the text's length
and give the same matches as the plain patterns.

Defined results: a null text counts as empty; rows that repeat are searched one by one;
an empty table gives an empty table; input columns named like results are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.shared import text_or_empty

SPAN = "struct<kind:string,start:bigint,stop:bigint,score:int>"
NEAR = 40
#: Scores are percents; spans of the added kinds need so much.
THRESHOLD = 50

# The lengths of account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    odd = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 1, F.pmod(c.cast("int") * 2, F.lit(10)) + F.when(c.cast("int") > 4, 1).otherwise(0)).otherwise(c.cast("int")),
    )
    return F.aggregate(odd, F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(iban: Column) -> Column:
    """Whether letters and digits of an IBAN leave 1 on division by 97."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    fold = lambda a, v: F.pmod(a * F.when(v > 9, 100).otherwise(10) + v, F.lit(97))
    return F.aggregate(F.transform(F.split(moved, ""), value), F.lit(0), fold) == 1


def _card(hit: Column) -> Column:
    digits = F.translate(hit, " -", "")
    return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))


def _iban_part(hit: Column) -> Column:
    """As much of a match as the country's numbers are long; null for too short ones and other countries."""
    lengths = F.create_map(*[F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv])
    n = F.try_element_at(lengths, F.left(hit, F.lit(2)))
    return F.when(F.length(F.translate(hit, " ", "")) >= n, F.regexp_substr(hit, F.concat(F.lit(r"^(?:[A-Z0-9]\x20?){"), (n - 1).cast("string"), F.lit("}[A-Z0-9]"))))


def _iban(hit: Column) -> Column:
    return _mod97(F.translate(hit, " ", ""))


def _whole(hit: Column) -> Column:
    return hit


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    """``holds``: a cheap test of the text; a text that fails it has no match. ``part``: what of
    a match is the span. ``apart``: no letter or digit may stand before it. ``context``: words."""

    name: str
    pattern: str
    holds: Callable[[Column], Column]
    check: Callable[[Column], Column]
    score: int
    context: str
    bonus: int = 20
    base: bool = True
    part: Callable[[Column], Column] = _whole
    apart: bool = False

    def nearby(self) -> str:
        """The pattern of a context word in a lower-cased text."""
        return f"(?:^|[^a-z0-9])(?:{self.context})(?:[^a-z0-9]|$)"


KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: F.contains(t, F.lit("@")),
        lambda h: F.lit(True),
        80,
        "e-?mail|mail|contact|write|kontakt|correo",
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda t: t.rlike(r"[0-9]\.[0-9]"),
        lambda h: h.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        60,
        "ip|host|server|address|adresse",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
        _card,
        80,
        "card|visa|credit|karte|carte|tarjeta",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda t: F.contains(t, F.lit("+")),
        lambda h: F.length(F.regexp_replace(h, "[^0-9]", "")).between(8, 15),
        60,
        "phone|call|tel|fax|mobile|anruf|appel",
    ),
    Kind(
        "iban",
        r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
        lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
        _iban,
        70,
        "iban|bank|account|konto|compte|cuenta",
        base=False,
        part=_iban_part,
        apart=True,
    ),
    Kind(
        "ssn",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
        lambda h: ~h.rlike("^(?:000|666|9)|-00-|-0000$"),
        30,
        "ssn|social security|sozialversicherung",
        base=False,
        apart=True,
    ),
)


def kind_spans(kind: Kind, text: Column) -> Column:
    """The spans of one kind, by start: an array of kind, start, stop and score.

    A fold over (gap, match) pairs; only matches that pass stay in it.
    """
    pairs = F.zip_with(
        F.split(text, kind.pattern, -1),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)),
        lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")),
    )
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        part = kind.part(pair["hit"])
        span = F.struct(F.lit(kind.name).alias("kind"), start.cast("long").alias("start"), (start + F.length(part)).cast("long").alias("stop"), F.lit(kind.score).alias("score"))
        good = part.isNotNull() & F.coalesce(kind.check(part), F.lit(False))
        if kind.apart:
            good = good & F.when(pair["gap"] == "", start == 0).otherwise(~F.right(pair["gap"], F.lit(1)).rlike("[A-Za-z0-9]"))
        at = start + F.coalesce(F.length(pair["hit"]), F.lit(0))
        return F.struct(at.cast("long").alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(pairs, zero, step, lambda acc: acc["out"])
    return F.when(kind.holds(text), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _scored(kind: Kind, spans: Column, text: Column) -> Column:
    """Adds the bonus where a context word stands within NEAR code points of the span."""

    def near(s: Column) -> Column:
        around = F.substr(text, F.greatest(s["start"] - NEAR, F.lit(0)).cast("int") + 1, (s["stop"] - s["start"] + F.least(s["start"], F.lit(NEAR)) + NEAR).cast("int"))
        return F.lower(around).rlike(kind.nearby())

    out = F.transform(
        spans,
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), F.when(near(s), s["score"] + kind.bonus).otherwise(s["score"]).alias("score")),
    )
    return out if kind.base else F.filter(out, lambda s: s["score"] >= THRESHOLD)


def find(df: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``df`` with one column more: all spans by kind as listed in KINDS, then by start."""
    names = [f"__pii_{k.name}" for k in KINDS]
    t = F.col("__pii_text")
    found = df.withColumn("__pii_text", text_or_empty(text)).select("*", *[kind_spans(k, t).alias(n) for k, n in zip(KINDS, names, strict=True)])
    scored = F.concat(*[_scored(k, F.col(n), t) for k, n in zip(KINDS, names, strict=True)])
    return found.withColumn(into, scored).drop("__pii_text", *names)


def said(spans: Column) -> Column:
    """``kind:start:stop`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, the number of spans of each base kind, their digest, all spans and, in
    the same order, their scores: a kind's own, and more where a context word stands near."""
    f = find(df.select(F.col(doc_id).alias("__doc_id"), F.col(text).alias("__in")), "__in", "__spans")
    count = lambda k: F.size(F.filter("__spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = [k.name for k in KINDS if k.base]
    return f.select(
        F.col("__doc_id").alias(doc_id),
        *[count(k) for k in base],
        F.sha2(said(F.filter("__spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        said(F.col("__spans")).alias("spans"),
        F.array_join(F.transform("__spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
        F.col("__spans").alias("found"),
    )


def redact(df: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``df`` with every span in ``text`` replaced by its kind in brackets.

    Spans that overlap are replaced as one, under the kind that begins first. A null text
    stays null. ``n_chars``, where the table has it, gets the new length of changed texts.
    """
    columns = df.columns
    inner = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), F.col(text).alias("__in"))
    by_start = F.array_sort(
        F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    )
    f = find(inner, "__in", "__spans").withColumn("__spans", by_start)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    text_in = F.col("__in")

    def step(acc: Column, s: Column) -> Column:
        piece = F.substr(text_in, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        more = F.concat(acc["out"], F.array(piece, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, more).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("__spans", zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text_in, (a["at"] + 1).cast("int"))))
    f = f.withColumn("__new", F.when(F.size("__spans") > 0, done).otherwise(text_in))
    changed = F.size("__spans") > 0

    def out(c: str) -> Column:
        if c == text:
            return F.col("__new").alias(c)
        if c == n_chars:
            return F.when(changed, F.length("__new")).otherwise(F.col(f"__row.`{c}`")).cast(df.schema[c].dataType).alias(c)
        return F.col(f"__row.`{c}`").alias(c)

    return f.select(*[out(c) for c in columns])
