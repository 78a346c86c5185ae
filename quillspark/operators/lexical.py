"""BM25 over an inverted index, and the portable fallback."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.vectors import by_id, first_k
from quillspark.shared import cut

K1, B = 1.2, 0.75
TERM = r"[a-z0-9]+"


def terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0))


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(term, doc_id, tf, len): one row for each term of each document. The counts of a
    document are made where the document is, before anything is shuffled."""
    t = docs.select(F.col(doc_id).alias("doc_id"), terms(F.col(text)).alias("__t"))
    t = t.select("doc_id", F.size("__t").alias("len"), F.explode("__t").alias("term"))
    return t.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.max("len").alias("len"))


def bm25_stored(post: DataFrame, sizes: DataFrame, questions: DataFrame, question_id: str, question: str) -> DataFrame:
    """(question_id, doc_id, bm25) from a stored index: postings (term, doc_id, tf, len) and
    the sizes (doc_id, len) of all documents. Only the questions' terms are read of it."""
    stats = sizes.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    asked = questions.select(F.col(question_id).alias("question_id"), F.explode(F.array_distinct(terms(F.col(question)))).alias("term"))
    return _scored(asked, post.join(asked.select("term").distinct(), "term", "left_semi"), stats)


def _scored(asked: DataFrame, post: DataFrame, stats: DataFrame, restrict: Column | None = None) -> DataFrame:
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    if restrict is not None:
        post = post.where(restrict)
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = asked.join(df, "term").join(post, "term").crossJoin(F.broadcast(stats))  # stats is one row
    return scored.groupBy("question_id", "doc_id").agg(F.round(F.sum(part), 6).alias("bm25"))


def bm25(docs: DataFrame, questions: DataFrame, doc_id: str = "doc_id", text: str = "text", question_id: str = "item_id", question: str = "text", restrict: Column | None = None) -> DataFrame:
    """(question_id, doc_id, bm25): matches of any term. Statistics cover all documents;
    ``restrict`` filters matches only.

    Only postings of the questions' terms leave the scan: the terms are joined before the
    counts are made. idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6."""
    d = docs.select(F.col(doc_id).alias("doc_id"), terms(F.col(text)).alias("__t")).withColumn("len", F.size("__t"))
    stats = d.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    asked = questions.select(F.col(question_id).alias("question_id"), F.explode(F.array_distinct(terms(F.col(question)))).alias("term"))
    vocabulary = asked.select("term").distinct()
    hits = d.select("doc_id", "len", F.explode("__t").alias("term")).join(vocabulary, "term", "left_semi")
    post = hits.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.max("len").alias("len"))
    return _scored(asked, post, stats, restrict)


#: Questions whose terms are sent to all tasks at once.
QUESTIONS_AT_ONCE = 500


def bm25_top(docs: DataFrame, questions: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text", question_id: str = "item_id", question: str = "text", restrict: Column | None = None) -> DataFrame:
    """The best matches of ``bm25``, k for each question and batch of a task at most, and so the
    k best of all; the same scores, never a row for each pair of question and document.

    Document frequencies come first, as one shuffle of the questions' terms. Then each task
    scores its documents against a block of questions, bounded in number, as a product of
    term weights. Ties go to the smaller id."""
    t = terms(F.col(text))
    asked = cut(questions.select(F.col(question_id).alias("question_id"), F.array_distinct(terms(F.col(question))).alias("toks")))
    vocabulary = asked.select(F.explode("toks").alias("term")).distinct()
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size(t)).alias("length")).first()
    seen = docs.select(F.explode(F.array_distinct(t)).alias("term")).join(vocabulary, "term", "left_semi")
    df = cut(seen.groupBy("term").agg(F.count("*").alias("df")))
    kind = docs.schema[doc_id].dataType.simpleString()
    q_kind = asked.schema["question_id"].dataType.simpleString()
    kept = F.coalesce(restrict, F.lit(False)) if restrict is not None else F.lit(True)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"), kept.alias("kept"))
    n = asked.count()
    blocks = max(1, -(-n // QUESTIONS_AT_ONCE))
    out = None
    for i in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == i)
        some = block.toArrow()  # a bounded number
        words = block.select(F.explode("toks").alias("term")).distinct().join(df, "term").orderBy("term").toArrow()  # theirs
        place = {w: j for j, w in enumerate(words.column("term").to_pylist())}
        count = words.column("df").to_numpy().astype(float)
        idf = np.maximum(1e-6, np.log((stats["n"] - count + 0.5) / (count + 0.5)))
        weight = np.zeros((len(place), some.num_rows))
        for j, toks in enumerate(some.column("toks").to_pylist()):
            at = [place[w] for w in toks or [] if w in place]
            weight[at, j] = idf[at]
        held = docs.sparkSession.sparkContext.broadcast((some.column("question_id").combine_chunks(), place, weight, float(stats["length"] or 1.0)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, place, weight, mean = held.value
            find = re.compile(TERM).findall
            for whole in batches:
                for start in range(0, whole.num_rows, 1000):
                    b = whole.slice(start, 1000)
                    s = np.zeros((len(ids), b.num_rows))
                    for j, (low, kept) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                        found = find(low) if kept else []
                        tf = Counter(w for w in found if w in place)
                        if tf:
                            at, times = [place[w] for w in tf], np.fromiter(tf.values(), float, len(tf))
                            s[:, j] = (times * (K1 + 1) / (times + K1 * (1 - B + B * len(found) / mean))) @ weight[at]
                    s = np.round(s, 6)
                    x, y = first_k(s, by_id(b.column(0)), k)
                    good = s[x, y] > 0
                    x, y = x[good], y[good]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), b.column(0).take(pa.array(y)), pa.array(s[x, y])], names=["question_id", "doc_id", "bm25"])

        part = cut(rows.mapInArrow(run, f"question_id {q_kind}, doc_id {kind}, bm25 double"))
        out = part if out is None else out.unionByName(part)
    return out


def top(scored: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, with their rank."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def counter(words: list[str]) -> Callable[[str, np.ndarray], None]:
    """A function that adds to an array how often each word stands in a text, as ``str.count``
    does: one pass of an automaton over the text, where that library is installed."""
    try:
        import ahocorasick
    except ImportError:

        def plain(text: str, into: np.ndarray) -> None:
            for w, word in enumerate(words):
                if word in text:
                    into[w] += text.count(word)

        return plain
    machine = ahocorasick.Automaton()
    lengths = np.array([len(w) for w in words], np.int64)
    # Words that overlap themselves are counted where one ends before the next begins.
    overlaps = np.array([any(w[:k] == w[-k:] for k in range(1, len(w))) for w in words], bool)
    for w, word in enumerate(words):
        machine.add_word(word, w)
    machine.make_automaton()

    def quick(text: str, into: np.ndarray) -> None:
        hits = list(machine.iter(text))
        if not hits:
            return
        end, at = np.array(hits, np.int64).T
        into += np.bincount(at, minlength=len(words))
        mine = overlaps[at]
        e, w = end[mine], at[mine]
        order = np.argsort(w, kind="stable")  # places of a word rise
        e, w = e[order], w[order]
        close = (w[1:] == w[:-1]) & (e[1:] - e[:-1] < lengths[w[1:]])
        for x in np.unique(w[1:][close]):
            free, n, places = -1, 0, e[w == x]
            for y in places.tolist():
                if y - lengths[x] >= free:
                    free, n = y, n + 1
            into[x] += n - len(places)

    return quick


def fallback_top(docs: DataFrame, questions: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """(question_id, doc_id, matched, score) of documents that hold any of a question's ``toks``, as
    parts of words too: the share of tokens found plus a hundredth for each of ten occurrences.
    k for each question and batch of a task at most, and so the k best of all.

    A text is searched once for each different token of a block of questions, bounded in number;
    what a question gets is a product of counts with its tokens, made where the text is."""
    asked = cut(questions.select("question_id", F.array_distinct(F.filter("toks", lambda t: t != "")).alias("toks")).where(F.size("toks") > 0))
    n = asked.count()
    blocks = max(1, -(-n // QUESTIONS_AT_ONCE))
    kind, q_kind = docs.schema[doc_id].dataType.simpleString(), asked.schema["question_id"].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    out = None
    for i in range(blocks):
        some = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == i)).toArrow()  # a bounded number
        toks = some.column("toks").to_pylist()
        words = sorted({w for t in toks for w in t})
        place = {w: j for j, w in enumerate(words)}
        has = np.zeros((len(words), some.num_rows))
        for j, t in enumerate(toks):
            has[[place[w] for w in t], j] = 1.0
        held = docs.sparkSession.sparkContext.broadcast((some.column("question_id").combine_chunks(), words, has))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, words, has = held.value
            size, count_words = has.sum(axis=0), counter(words)
            for whole in batches:
                for start in range(0, whole.num_rows, 500):
                    b = whole.slice(start, 500)
                    times = np.zeros((b.num_rows, len(words)))
                    for j, low in enumerate(b.column(1).to_pylist()):
                        count_words(low, times[j])
                    matched = ((times > 0).astype(float) @ has).T
                    s = np.round(matched / size[:, None] + np.minimum((times @ has).T, 10.0) / 100.0, 6)
                    x, y = first_k(s, by_id(b.column(0)), k)
                    good = matched[x, y] > 0
                    x, y = x[good], y[good]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), b.column(0).take(pa.array(y)), pa.array(matched[x, y].astype(np.int64)), pa.array(s[x, y])], names=["question_id", "doc_id", "matched", "score"])

        part = cut(rows.mapInArrow(run, f"question_id {q_kind}, doc_id {kind}, matched long, score double"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], f"question_id {q_kind}, doc_id {kind}, matched long, score double")
