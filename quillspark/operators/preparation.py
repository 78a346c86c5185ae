"""Benchmark preparation: corpora, questions and their evidence as tables; estimates; hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import identifier


def articles(rows: DataFrame) -> DataFrame:
    """From (n, id, title, url, body, source): the same with a safe doc_id; one that is taken gets the row's number."""
    named = rows.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("article-"), F.lpad(F.col("n").cast("string"), 4, "0"))))
    wanted = identifier(F.coalesce(F.nullif("id", F.lit("")), F.nullif("url", F.lit("")), F.col("title")))
    named = named.withColumn("__w", wanted)
    first = F.row_number().over(Window.partitionBy("__w").orderBy("n")) == 1
    number = F.concat(F.lit("-"), F.lpad(F.col("n").cast("string"), 4, "0"))
    return named.withColumn("doc_id", F.when(first, F.col("__w")).otherwise(F.concat("__w", number))).drop("__w")


def resolve_evidence(cases: DataFrame, known: DataFrame) -> DataFrame:
    """Cases (sample_id, category, evidence: array of title and url) with evidence_doc_ids,
    by url, else by title; ``unanswerable`` where there are none or the category says so."""
    e = cases.select("sample_id", F.explode("evidence").alias("e")).select("sample_id", "e.title", "e.url")
    by_url = known.where("url <> ''").groupBy("url").agg(F.max_by("doc_id", "n").alias("by_url"))
    by_title = known.groupBy("title").agg(F.max_by("doc_id", "n").alias("by_title"))
    e = e.join(by_url, "url", "left").join(by_title, "title", "left")
    ids = e.groupBy("sample_id").agg(F.array_sort(F.collect_set(F.coalesce("by_url", "by_title"))).alias("evidence_doc_ids"), F.array_sort(F.collect_set(F.nullif("title", F.lit("")))).alias("evidence_titles"))
    out = cases.drop("evidence").join(ids, "sample_id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("evidence_doc_ids", F.coalesce("evidence_doc_ids", none)).withColumn("evidence_titles", F.coalesce("evidence_titles", none))
    return out.withColumn("unanswerable", (F.col("category") == "null_query") | (F.size("evidence_doc_ids") == 0))


def evidence_documents(cases: DataFrame, limit: int = 100) -> DataFrame:
    """The documents that most cases need; ties by id."""
    n = cases.select(F.explode("evidence_doc_ids").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    return n.orderBy(F.col("n").desc(), "doc_id").limit(limit)


def contained(cases: DataFrame, selected: DataFrame) -> DataFrame:
    """Cases with evidence, all of it among the selected documents."""
    e = cases.select("sample_id", F.explode("evidence_doc_ids").alias("doc_id")).join(selected.select("doc_id", F.lit(True).alias("__in")), "doc_id", "left")
    good = e.groupBy("sample_id").agg(F.bool_and(F.coalesce("__in", F.lit(False))).alias("ok")).where("ok").select("sample_id")
    return cases.join(good, "sample_id", "left_semi")


def flattened_tables(records: DataFrame, formats: tuple[str, ...] = ("pdf", "docx", "csv")) -> DataFrame:
    """Questions of table documents (doc: n, table, paragraphs, questions): one row each, the
    document's format taken in turn."""
    kind = F.element_at(F.array(*[F.lit(x) for x in formats]), (F.col("n") % len(formats)).cast("int") + 1)
    table = F.array_join(F.transform("table", lambda r: F.array_join(r, " | ")), "\n")
    q = records.select("n", kind.alias("format"), F.concat_ws("\n\n", table, F.array_join("paragraphs", "\n")).alias("body"), F.posexplode("questions").alias("k", "q"))
    return q.select(F.concat_ws("-", F.lit("table"), F.col("n").cast("string"), F.col("k").cast("string")).alias("sample_id"), F.concat(F.lit("table-"), F.col("n").cast("string")).alias("doc_id"), "format", "body", "q.*")


def passage_mix(records: DataFrame, size: int = 5) -> DataFrame:
    """The passages of noisy, refusing, integrating and counterfactual cases (category,
    positive, negative, wrong): good ones first, the rest filled with bad ones."""
    noise = F.concat(F.slice("positive", 1, 2), F.slice("negative", 1, size - 2))
    out = (
        F.when(F.col("category") == "noise", noise)
        .when(F.col("category") == "rejection", F.slice("negative", 1, size))
        .when(F.col("category") == "integration", F.slice(F.concat("positive", "negative"), 1, size))
        .otherwise(F.slice(F.concat("wrong", "negative"), 1, size))
    )
    return records.withColumn("passages", out)


def document_tokens(name: Column, n_bytes: Column, text: Column) -> Column:
    """Tokens of a file: of its text where it is text, else a twelfth of its bytes."""
    plain = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).isin(".txt", ".md", ".csv", ".json", ".jsonl", ".html", ".xml")
    return F.when(plain, F.greatest(F.lit(1), F.ceil(F.length(text) / 3))).otherwise(F.ceil(n_bytes / 12)).cast("long")


def estimate(docs: DataFrame, cases: DataFrame, size: int = 350, overlap: int = 50, batch: int = 10, price: float = 0.0005) -> DataFrame:
    """Chunks, model calls, tokens and cost of a run: docs (tokens), cases (tokens, kind)."""
    d = docs.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("d"))
    c = cases.agg(F.count_if(F.col("kind") == "retrieval").alias("r"), F.count_if(F.col("kind") == "answer").alias("a"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("q"))
    x = d.crossJoin(c).withColumn("chunks", F.ceil(F.col("d") / max(1, size - overlap)))  # one row each
    x = x.withColumn("embedding_calls", F.ceil(F.col("chunks") / batch) + 2 * F.col("r") + F.col("a")).withColumn("embedding_tokens", F.col("d") + 2 * F.col("q"))
    return x.select(
        F.col("chunks").cast("long"),
        (F.col("chunks") + F.col("r") + 2 * F.col("a")).cast("long").alias("chat_calls"),
        F.col("embedding_calls").cast("long"),
        F.col("embedding_tokens").cast("long"),
        F.round(F.col("embedding_tokens") / 1000 * price, 4).alias("cost"),
    )


def tree_hash(files: DataFrame) -> DataFrame:
    """One digest of files (path, content): the ordered lines ``path, digest``."""
    lines = files.select(F.concat_ws(" ", "path", F.sha2("content", 256)).alias("line"))
    return lines.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("tree"))


def reset(table: DataFrame, prepared: DataFrame, key: str) -> DataFrame:
    """``table`` without what a preparation had put there."""
    return table.join(prepared.select(key).distinct(), key, "left_anti")


def experiment(records: DataFrame, gates: DataFrame, stages: tuple[int, ...] = (10, 100, 300)) -> DataFrame:
    """(stage, name, value, limit, passed, open): metrics of the first cases of each stage
    against its gates; a stage is open if all gates of the one before passed."""
    from quillspark.operators.evaluation import gates as judge

    order = F.row_number().over(Window.orderBy("sample_id"))
    r = records.withColumn("__n", order)
    out = None
    for stage in stages:
        m = r.where(F.col("__n") <= stage).agg(F.avg("em").alias("em"), F.avg("recall").alias("recall"), F.percentile("ms", F.lit(0.95)).alias("p95"))
        m = m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("em", "recall", "p95")])).alias("m")).select("m.*")
        part = judge(m, gates).withColumn("stage", F.lit(stage))
        out = part if out is None else out.unionByName(part)
    passed = F.min(F.coalesce("passed", F.lit(False))).over(Window.partitionBy("stage"))
    out = out.withColumn("__all", passed)
    before = F.min(F.when(F.col("name") == "em", F.col("__all"))).over(Window.orderBy("stage").rangeBetween(Window.unboundedPreceding, -1))
    return out.withColumn("open", F.coalesce(before, F.lit(True))).select("stage", "name", "value", "limit", "passed", "open")


def report(summary: DataFrame, title: str) -> str:
    """A summary of a few rows as Markdown."""
    rows = summary.collect()
    head = " | ".join(summary.columns)
    lines = [f"# {title}", "", f"| {head} |", "| " + " | ".join("---" for _ in summary.columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"
