"""The queries of this subpackage and, where SQL can say the same, their SQL for DuckDB.

Each reads its whole table with production parameters. What null, empty, long, equal and
repeated rows, empty tables and clashing column names give is defined in the operator's
module; the queries add nothing to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import classifier, licenses, mixing, packing, pii, quality, sharding, simhash, substring, topk
from quillspark.shared import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: counts, digest and spans of the base kinds, all spans and their scores."""
    return pii.report(table(spark, sf_dir, "documents")).drop("found")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, with its source's size and target."""
    return mixing.taken(mixing.schedule(table(spark, sf_dir, "documents")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows of every row whose vec_id is divisible by 20."""
    return topk.search(table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document."""
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All license matches of all documents; documents without one have no row."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages that repeat across documents; documents without one have no row."""
    return substring.passages(table(spark, sf_dir, "documents"))


def op9_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, from rules learnt on at most SAMPLE labels."""
    docs = table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot and the shard among one more of every document."""
    return sharding.place(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the five stages over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (op1_pii, op2_packing, op3_mixing, op4_simhash, op5_topk, op6_quality, op7_licenses, op8_substring, op9_classifier, op10_sharding, pipeline)
    return {f.__name__: f for f in all_}


_GAPS = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(string_split_regex(text, '{_GAPS}'), lambda x: x <> '')"


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _quality_sql() -> str:
    chars = "[" + "".join(f"\\x{ord(c):02X}" for c in quality.SYMBOLS) + "]"
    measure = {"__n_words": "n_words", "__word_chars": "word_chars", "__n_symbols": "n_symbols", "__n_stop": "n_stop", "__n_dup_lines": "n_dup_lines", "__n_lines": "n_lines"}
    failed = " OR ".join(f"100 * {measure[r.part]} {'<' if r.floor else '>'} {r.percent} * {measure[r.whole]}" for r in quality.RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, {_WORDS} AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
m AS (SELECT r, doc_id, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '{_GAPS}', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '{chars}', '', 'g')))::BIGINT AS n_symbols,
        len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        len(list_filter(words, lambda x: x IN ({_quoted(quality.STOP_FORMS)})))::BIGINT AS n_stop FROM w),
t AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM t),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
p AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS pos FROM h) GROUP BY r),
x AS (SELECT m.*, coalesce(p.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN p USING (r)),
y AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {failed}) AS kept FROM y
"""


#: The plain patterns of the kinds; the Spark side has possessive forms of them.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split({_DIGITS}, ''), lambda c, i: CASE WHEN (length({_DIGITS}) - i) % 2 = 1 THEN (c::INT * 2) % 10 + (c::INT > 4)::INT ELSE c::INT END)) % 10 = 0"
_PLAIN_IBAN = "replace(part, ' ', '')"
_VALUES = f"list_transform(string_split(substr({_PLAIN_IBAN}, 5) || substr({_PLAIN_IBAN}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"
_CHECKS = {
    "email": "true",
    "ip": r"regexp_full_match(hit, '0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}')",
    "card": f"CASE WHEN length({_DIGITS}) BETWEEN 16 AND 19 THEN {_LUHN} ELSE false END",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
    "iban": f"CASE WHEN part IS NOT NULL THEN list_reduce(list_prepend(0, {_VALUES}), lambda a, v: (a * (CASE WHEN v > 9 THEN 100 ELSE 10 END) + v) % 97) = 1 ELSE false END",
    "ssn": "NOT regexp_matches(hit, '^(?:000|666|9)|-00-|-0000$')",
}
_LENGTHS = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in pii.IBAN_LENGTHS.items()) + "}"
_PARTS = {"iban": f"CASE WHEN length(replace(hit, ' ', '')) >= n_part THEN regexp_extract(hit, '^(?:[A-Z0-9] ?){{' || (n_part - 1) || '}}[A-Z0-9]') END"}


def _pii_sql() -> str:
    parts = []
    for k, kind in enumerate(pii.KINDS):
        near = f"CASE WHEN regexp_matches(lower(substr(text, greatest(start - {pii.NEAR}, 0) + 1, stop - start + least(start, {pii.NEAR}) + {pii.NEAR})), '{kind.nearby()}') THEN {kind.bonus} ELSE 0 END"
        apart = " AND CASE WHEN gap = '' THEN start = 0 ELSE NOT regexp_matches(right(gap, 1), '[A-Za-z0-9]') END" if kind.apart else ""
        enough = "" if kind.base else f" WHERE score >= {pii.THRESHOLD}"
        parts.append(f"""
SELECT * FROM (SELECT r, {k} AS k, '{kind.name}' AS kind, start, stop, {kind.score} + {near} AS score FROM (
  SELECT *, (start + length(part))::BIGINT AS stop FROM (SELECT *, {_PARTS.get(kind.name, 'hit')} AS part FROM (
  SELECT r, text, hits[i] AS hit, gaps[i] AS gap, ({_LENGTHS if kind.name == 'iban' else 'MAP {}'})[left(hits[i], 2)] AS n_part, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
  FROM (SELECT r, text, hits, gaps, unnest(range(1, len(hits) + 1)) AS i
        FROM (SELECT r, text, regexp_extract_all(text, '{_PLAIN[kind.name]}') AS hits, string_split_regex(text, '{_PLAIN[kind.name]}') AS gaps FROM d) WHERE len(hits) > 0)))
) WHERE {_CHECKS[kind.name]}{apart}){enough}""")
    base = [k.name for k in pii.KINDS if k.base]
    counts = ", ".join(f"coalesce(count(*) FILTER (WHERE kind = '{b}'), 0)::BIGINT AS n_{b}" for b in base)
    said = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({' UNION ALL '.join(parts)})
SELECT d.doc_id, {counts},
  sha256(coalesce({said} FILTER (WHERE kind IN ({_quoted(base)})), '')) AS base_sha256,
  coalesce({said} FILTER (WHERE kind IS NOT NULL), '') AS spans,
  coalesce(string_agg(score::VARCHAR, ',' ORDER BY k, start) FILTER (WHERE kind IS NOT NULL), '') AS scores
FROM d LEFT JOIN s USING (r) GROUP BY r, d.doc_id
"""


def _mixing_sql() -> str:
    last = len(mixing.WEIGHTS)
    weights = "[" + ", ".join(f"{w}.0" for w in mixing.WEIGHTS) + "]::DOUBLE[]"
    key = f"md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '{_GAPS}'), lambda x: x <> ''))::BIGINT AS size, {key} AS k FROM documents),
z AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
v AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, ({weights})[(place % {last} + 1)::INT] AS weight, ({mixing.ROUNDS} * source_size)::DOUBLE AS lim FROM z),
f AS (SELECT *, row_number() OVER o AS turn, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
      sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM v WINDOW o AS (ORDER BY lim / weight, place)),
c AS (SELECT rest, open FROM f WHERE rest * weight <= lim * open ORDER BY turn LIMIT 1),
t AS (SELECT f.source, place, source_size, least(lim, c.rest * weight / c.open) AS target FROM f, c),
q AS (SELECT d.r, d.doc_id, d.size, t.place, t.source_size, t.target,
      (sum(size) OVER (PARTITION BY d.source ORDER BY k, r ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT r, size, place, i, i * source_size + upto AS upto, (i * source_size + upto) / target AS finish FROM q, (SELECT unnest(range({mixing.ROUNDS})) AS i) WHERE size > 0),
g AS (SELECT r, size, sum(size) OVER (ORDER BY finish, place, i, upto ROWS UNBOUNDED PRECEDING) AS spent FROM e),
n AS (SELECT r, count(*) AS times FROM g WHERE spent <= (SELECT sum(size) FROM d) GROUP BY r)
SELECT doc_id, size, source_size, target, (size * coalesce(times, 0))::BIGINT AS taken FROM q LEFT JOIN n USING (r)
"""


def _topk_sql() -> str:
    return f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= {topk.K}
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_pii": _pii_sql(), "op3_mixing": _mixing_sql(), "op5_topk": _topk_sql(), "op6_quality": _quality_sql()}
