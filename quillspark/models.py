"""The model boundary: named functions with deterministic stand-ins that need no network.

Every model is a function over a batch of plain values. ``register`` puts another one in
its place; the engine asks for models by name only. ``vectorised`` wraps one as an Arrow
UDF; calls, errors and latency come back as columns and are summed later.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSION = 8
_models: dict[str, Callable] = {}


def register(name: str, model: Callable) -> None:
    """``text_embedding``, ``vl_embedding``, ``reranker``, ``extractor``, ``planner``, ``answerer``, ``temporal``, ``comparison``,
    ``vision`` or ``ocr``. A model may return (result, usage report)."""
    _models[name] = model


def get(name: str) -> Callable:
    return _models[name]


def names() -> frozenset[str]:
    return frozenset(_models)


def embed(texts: Sequence[str], dimension: int = DIMENSION) -> list[list[float]]:
    """The stand-in embedder: ((sum of the bytes + 17 i) mod 101) / 100."""
    sums = [sum((t or "").encode()) for t in texts]
    return [[((s + 17 * i) % 101) / 100 for i in range(dimension)] for s in sums]


def rerank(query: str, documents: Sequence[str]) -> list[float]:
    """The stand-in reranker: the share of the query's words that a document holds."""
    words = lambda x: set(re.findall(r"[\w-]+", (x or "").lower()))
    asked = words(query)
    return [len(asked & words(d)) / len(asked) if asked else 0.0 for d in documents]


NAME = re.compile(r"\b[A-Z][\w-]+(?:\s+[A-Z][\w-]+)*")


def extract(texts: Sequence[str]) -> list[dict]:
    """The stand-in extractor: runs of capitalised words are entities; those that follow one
    another in a sentence are related."""
    out = []
    for text in texts:
        entities, relations = {}, []
        for sentence in re.split(r"(?<=[.!?])\s+", text or ""):
            names = [m[0] for m in NAME.finditer(sentence)]
            entities |= dict.fromkeys(names)
            relations += [{"head": a, "predicate": "near", "tail": b, "confidence": 0.5} for a, b in zip(names, names[1:], strict=False) if a != b]
        out.append({"entities": [{"name": n, "type": "NAME", "description": ""} for n in entities], "relations": relations})
    return out


def answer(question: str, contexts: Sequence[tuple[str, str]]) -> dict:
    """The stand-in answerer: the first sentence of the first context, citing it."""
    if not contexts:
        return {"answerable": False, "answer": "", "citation_ids": []}
    chunk, text = contexts[0]
    return {"answerable": True, "answer": re.split(r"(?<=[.!?])\s", text.strip())[0][:300], "citation_ids": [chunk]}


def silent(data: bytes) -> str:
    return ""


def date_evidence(question: str, slots: Sequence[str], contexts: Sequence[tuple[str, str, Sequence[str]]]) -> list[dict]:
    """The stand-in of the temporal extractor: each slot's first context (chunk, text, slots) that
    has a date; whether claims changed is told by words."""
    out = []
    for slot in slots:
        for chunk, text, has in contexts:
            date = re.search(r"\b(?:19|20)\d{2}(?:[-/]\d{1,2}(?:[-/]\d{1,2})?)?\b", text or "")
            if slot in has and date and all(e["citation_id"] != chunk for e in out):
                changed = re.search(r"\b(?:changed|changes|no longer|instead)\b", text.lower()) is not None
                out.append({"slot_id": slot, "citation_id": chunk, "date": date[0], "observed": "changed_claim" if changed else "same_claim"})
                break
    return out


def claim_evidence(question: str, slots: Sequence[str], contexts: Sequence[tuple[str, str, Sequence[str]]]) -> list[dict]:
    """The stand-in of the comparison verifier: a slot's first context supports the claim if it has
    half of the question's words."""
    asked = {w for w in re.findall(r"[\w-]+", question.lower()) if len(w) > 2}
    out = []
    for slot in slots:
        chunk, text = next(((c, t) for c, t, has in contexts if slot in has and all(e["citation_id"] != c for e in out)), (None, ""))
        if chunk is not None:
            share = len(asked & set(re.findall(r"[\w-]+", text.lower()))) / max(1, len(asked))
            out.append({"slot_id": slot, "citation_id": chunk, "supported": True if share >= 0.5 else False if share >= 0.25 else None})
    return out


register("text_embedding", embed)
register("vl_embedding", embed)
register("reranker", rerank)
register("extractor", extract)
register("answerer", answer)
register("temporal", date_evidence)
register("comparison", claim_evidence)
register("vision", silent)
register("ocr", silent)

#: Seconds before another try, doubled each time.
BACKOFF = 0.0
RETRIES = 2


class Usage:
    """What calls of a model cost: calls, errors, tokens and the time of each, summed later."""

    ALIASES = {"input": ("input_tokens", "prompt_tokens"), "output": ("output_tokens", "completion_tokens")}

    def __init__(self) -> None:
        self.calls = self.errors = self.input_tokens = self.output_tokens = 0
        self.ms: list[float] = []

    def add(self, reported: dict | None) -> None:
        """Adds a provider's report; its keys have several names, missing ones count 0."""
        for side, names in self.ALIASES.items():
            got = next((reported[n] for n in names if (reported or {}).get(n) is not None), 0)
            setattr(self, f"{side}_tokens", getattr(self, f"{side}_tokens") + int(got))

    def row(self) -> dict:
        ms = sorted(self.ms)
        at = lambda q: ms[min(len(ms) - 1, int(q * len(ms)))] if ms else 0.0
        return {"calls": self.calls, "errors": self.errors, "input_tokens": self.input_tokens, "output_tokens": self.output_tokens, "p50_ms": at(0.5), "p95_ms": at(0.95)}


USAGE = "struct<calls:int,errors:int,input_tokens:int,output_tokens:int,p50_ms:double,p95_ms:double>"


def attempt(call: Callable, usage: Usage, check: Callable = lambda x: x, tries: int = RETRIES + 1, correct: bool = False):
    """The checked result of ``call``; tried again after an error (with its text as an argument,
    where the model can ``correct`` itself). Raises the last error."""
    error: Exception | None = None
    for k in range(tries):
        began = time.perf_counter()
        usage.calls += 1
        try:
            got = call(str(error) if error else "") if correct else call()
            if isinstance(got, tuple) and len(got) == 2 and isinstance(got[1], dict):
                usage.add(got[1])
                got = got[0]
            return check(got)
        except Exception as e:
            error, usage.errors = e, usage.errors + 1
            if BACKOFF and k + 1 < tries:
                time.sleep(BACKOFF * 2**k)
        finally:
            usage.ms.append((time.perf_counter() - began) * 1000)
    raise error


def checked_scores(n: int) -> Callable:
    """A check of a reranker's answer: a finite number for each document, clipped to 0..1."""

    def check(scores):
        out = [float(x) for x in scores]
        if len(out) != n or any(x != x for x in out):
            raise ValueError(f"{len(out)} scores for {n} documents")
        return [min(1.0, max(0.0, x)) for x in out]

    return check


def checked_vectors(n: int, dimension: int | None = None) -> Callable:
    """A check of an embedder's answer: a vector for each text, all of one length."""

    def check(vectors):
        out = [[float(x) for x in v] for v in vectors]
        sizes = {len(v) for v in out}
        if len(out) != n or len(sizes) > 1 or (dimension and sizes - {dimension}):
            raise ValueError(f"{len(out)} vectors of lengths {sorted(sizes)} for {n} texts")
        return out

    return check


def checked_answer(got) -> dict:
    """A check of an answerer's JSON: an object, or text that holds one."""
    if isinstance(got, list):  # parts of a message
        got = "".join(p.get("text", "") if isinstance(p, dict) else str(p) for p in got)
    if isinstance(got, str):
        found = re.search(r"\{.*\}", got, re.DOTALL)
        if found is None:
            raise ValueError("no JSON object in the answer")
        got = json.loads(found[0])
    if not isinstance(got.get("answerable"), bool) or not isinstance(got.get("answer"), str) or not isinstance(got.get("citation_ids"), (list, tuple)):
        raise ValueError("answerable, answer and citation_ids are needed")
    return {"answerable": got["answerable"], "answer": got["answer"], "citation_ids": [str(x) for x in got["citation_ids"]], "calculation": str(got.get("calculation") or "")}


def preflight() -> list[dict]:
    """(check, ok, detail) of the registered models: lengths of vectors, the reranker's direction,
    whether a text and the other modality meet, and the answerer's contract."""

    def score_direction():
        s = attempt(lambda: get("reranker")("red lamp", ["a red lamp", "blue sky"]), Usage(), checked_scores(2))
        return s[0] > s[1], f"{s}"

    def dimensions():
        sizes = [len(attempt(lambda n=n: get(n)(["x"]), Usage(), checked_vectors(1))[0]) for n in ("text_embedding", "vl_embedding")]
        return sizes[0] == sizes[1], f"{sizes}"

    def across():
        a, b = (attempt(lambda n=n: get(n)(["a red lamp"]), Usage(), checked_vectors(1))[0] for n in ("text_embedding", "vl_embedding"))
        dot = sum(x * y for x, y in zip(a, b, strict=True)) / max(1e-12, (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5)
        return dot > 0, f"{dot:.3f}"

    def contract():
        got = attempt(lambda: get("answerer")("who?", [("c1", "Ada did.")]), Usage(), checked_answer)
        return set(got["citation_ids"]) <= {"c1"}, f"{got}"

    out = []
    for check in (dimensions, across, score_direction, contract):
        try:
            ok, detail = check()
        except Exception as e:
            ok, detail = False, f"{type(e).__name__}: {e}"
        out.append({"check": check.__name__, "ok": bool(ok), "detail": detail[:300]})
    return out


def embedding_udf(name: str = "text_embedding", batch: int = 10):
    """An Arrow UDF of an embedding model, called in batches, checked and tried again."""
    model = get(name)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        out: list[list[float]] = []
        for i in range(0, len(texts), batch):
            part = texts.iloc[i : i + batch].tolist()
            out += attempt(lambda part=part: model(part), Usage(), checked_vectors(len(part)))
        return pd.Series(out, index=texts.index)

    return run


def safe_embedding_udf(name: str):
    """As ``embedding_udf``, text by text: one that the model fails on is null."""
    model = get(name)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        out: list = []
        for t in texts:
            try:
                out.append(attempt(lambda t=t: model([t]), Usage(), checked_vectors(1))[0])
            except Exception:
                out.append(None)
        return pd.Series(out, index=texts.index, dtype=object)

    return run


PLAN = "struct<intent:string,answer_type:string,target_relation:string,queries:array<string>,entities:array<string>,needs_calculation:boolean>"


def planner_udf(name: str = "planner"):
    """An Arrow UDF of a planner (question to a dict); null where it fails, so that rules plan."""
    model = get(name)

    @F.pandas_udf(PLAN)
    def run(questions: pd.Series) -> pd.DataFrame:
        rows = []
        for q in questions:
            try:
                got = attempt(lambda q=q: model(q), Usage(), lambda x: json.loads(x) if isinstance(x, str) else dict(x))
                rows.append((got.get("intent"), got.get("answer_type"), got.get("target_relation"), [str(x) for x in got.get("queries") or [q]], [str(x) for x in got.get("entities") or []], bool(got.get("needs_calculation"))))
            except Exception:
                rows.append((None, None, None, None, None, None))
        return pd.DataFrame(rows, columns=["intent", "answer_type", "target_relation", "queries", "entities", "needs_calculation"])

    return run


EXTRACTION = T.StructType(
    [
        T.StructField("entities", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "type", "description")]))),
        T.StructField("relations", T.ArrayType(T.StructType([*[T.StructField(n, T.StringType()) for n in ("head", "predicate", "tail")], T.StructField("confidence", T.DoubleType())]))),
        T.StructField("ms", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)


def extraction_udf(name: str = "extractor", tries: int = 3):
    """An Arrow UDF of an extractor; a text that fails ``tries`` times has no entities and an
    error. Relations whose ends weren't extracted are dropped."""
    model = get(name)

    @F.pandas_udf(EXTRACTION)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            usage, error, found = Usage(), None, {"entities": [], "relations": []}
            try:
                found = attempt(lambda t=t: model([t]), usage, lambda x: {"entities": list(x[0]["entities"]), "relations": list(x[0]["relations"])}, tries)
            except Exception as e:
                error = type(e).__name__
            names = {x["name"] for x in found["entities"]}
            kept = [r for r in found["relations"] if r["head"] in names and r["tail"] in names]
            rows.append((found["entities"], kept, sum(usage.ms), error))
        return pd.DataFrame(rows, columns=["entities", "relations", "ms", "error"])

    return run
