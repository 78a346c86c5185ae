"""Random short texts of nasty characters against the plain versions, many in one job."""

from __future__ import annotations

import hashlib
import random

import pytest
from test_operators import base_spans, ordered, plain_counts, plain_fingerprint

from quillspark.llm import packing, pii, quality, simhash


def texts(alphabet: list[str], n: int, most: int, seed: int) -> list[tuple[int, str]]:
    r = random.Random(seed)
    return [(i, "".join(r.choice(alphabet) for _ in range(r.randint(0, most)))) for i in range(n)]


PII = ["a", "B", "@", ".", "-", "_", "%", "+", "1", "23", "4567", "0", " ", "(", ")", "é", "😀", "\n", "4111 1111 1111 1111", "10.0.0.1", "+1 212 555 0123", "x@y.z"]
WORDS = ["a", "b", "the", "#", "|", " ", " ", "\n", "\t", "\x0b", "\xa0", "Ä", "a b c ", "漢"]


def test_pii_spans(spark):
    data = texts(PII, 4000, 24, 1)
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = [(i, hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest()) for i, t in data]
    assert ordered(pii.report(df).select("doc_id", "base_sha256").collect()) == ordered(want)


def test_masked_texts_have_no_base_span_left(spark):
    data = texts(PII, 800, 24, 2)
    df = spark.createDataFrame(data, "doc_id long, text string")
    left = [r for r in pii.redact(df).collect() if any(x.startswith(("email", "card")) for x in base_spans(r.text))]
    assert len(left) <= 8  # what stood apart may meet anew where a span is gone


def test_quality_counts(spark):
    data = texts(WORDS, 3000, 90, 3)
    df = spark.createDataFrame(data, "doc_id long, text string")
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert ordered(quality.judge(df).select(*cols).collect()) == ordered((i, *plain_counts(t)) for i, t in data)


@pytest.mark.parametrize("seed", range(3))
def test_fingerprints(seed):
    for _, t in texts(WORDS, 150, 40, seed):
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t)


def test_token_ids_are_those_of_the_tokenizer_as_loaded():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.token_ids("a <|endoftext|> b").tolist() == [64, 220, 50256, 275, 2]
    pool = [" ", "  ", "\n", "\t", "\r\n", "'s", "'ll", "'S", "a", "Z", "é", "1", "½", "漢", "!", "#$", "\xa0", "\x85", "\u3000", "<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "😀", "\x00", "the", "ing"]
    for _, text in texts(pool, 6000, 16, 4):
        assert packing.token_ids(text).tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]


def test_packing_query_counts_the_added_token_once(spark, tmp_path):
    from quillspark.llm import catalog

    spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r["length"] for r in catalog.op2_packing(spark, str(tmp_path)).collect()] == [5]
