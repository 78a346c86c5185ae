"""Scalar functions over text: pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "\\x{3400}-\\x{9fff}"


def squeeze(c: Column) -> Column:
    """White space (Unicode) to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def digest(c: Column, n: int = 64) -> Column:
    return F.left(F.sha2(c, 256), F.lit(n))


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, r"(?U)\s+"), "")


def bigrams(run: Column) -> Column:
    """All neighbouring pairs of a run of characters; a single one stays."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2)))


def lexical_tokens(c: Column, most: int = 32) -> Column:
    """Query tokens: ASCII words with inner ``_.-`` or CJK runs and their bigrams; distinct, the first ``most``."""
    found = F.regexp_extract_all(F.lower(c), F.lit(rf"[A-Za-z0-9_][A-Za-z0-9_.-]*|[{CJK}]+"), F.lit(0))
    wide = lambda t: t.rlike(rf"^[{CJK}]+$") & (F.length(t) > 2)
    parts = F.transform(found, lambda t: F.when(wide(t), F.concat(F.array(t), bigrams(t))).otherwise(F.array(t)))
    return F.slice(F.array_distinct(F.flatten(parts)), 1, most)


def search_text(content: Column, *headers: Column) -> Column:
    """Header fields, content and CJK bigrams: what lexical search indexes."""
    head = F.concat_ws(" ", *[F.nullif(h.cast("string"), F.lit("")) for h in headers]) if headers else F.lit("")
    plain = F.trim(F.concat(head, F.lit("\n"), content))
    plain = F.regexp_replace(plain, r"^\s+|\s+$", "")
    grams = F.flatten(F.transform(F.regexp_extract_all(plain, F.lit(rf"[{CJK}]+"), F.lit(0)), bigrams))
    return F.regexp_replace(F.concat(plain, F.lit("\n"), F.array_join(grams, " ")), r"^\s+|\s+$", "")


def embedding_text(content: Column, fields: dict[str, Column], raw: bool = False) -> Column:
    """``name=value`` of the fields that aren't empty, a newline and the content, trimmed. With
    ``raw`` only null fields are left out and nothing is trimmed."""
    told = lambda v: v.isNotNull() if raw else v.isNotNull() & (v.cast("string") != "")
    parts = [F.when(told(v), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in fields.items()]
    text = F.concat(F.concat_ws(" ", *parts), F.lit("\n"), content)
    return text if raw else F.regexp_replace(text, r"^\s+|\s+$", "")


def rtrim_spaces(c: Column) -> Column:
    """Without the spaces at its end, of all kinds that Unicode has (not tabs or newlines)."""
    return F.rtrim(c, F.lit("\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"))


def entity_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def word_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)[\w-]+"), F.lit(0)))


def json_path_key(c: Column) -> Column:
    """A key as a JSONPath step, backslash and quote escaped."""
    return F.concat(F.lit("['"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("']"))


def identifier(c: Column, fallback: str = "item", most: int = 100) -> Column:
    """Runs of other characters become a hyphen; ends stripped, cut, never empty."""
    clean = F.left(F.btrim(F.regexp_replace(c, r"[^a-zA-Z0-9_.-]+", "-"), F.lit("-")), F.lit(most))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback))


def token_count(c: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(c) / 3)).cast("long")


def json_object_in(c: Column) -> Column:
    """The outermost ``{...}`` of a model's answer, fences stripped; null if there is none."""
    bare = F.regexp_replace(F.trim(c), r"^```(?:json)?\s*|\s*```$", "")
    found = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.nullif(found, F.lit(""))


def joined_parts(parts: Column) -> Column:
    """The text parts of a model's answer as one string."""
    return F.array_join(F.transform(parts, lambda p: p["text"]), "")
