"""Seams for models: protocols, and deterministic defaults that say what they are."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .functions import vectors as V


class Embedder(Protocol):
    """Vectors of passages and of questions; models that tell them apart put ``passage: `` or ``query: `` before the text themselves."""

    dim: int

    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...

    def embed_queries(self, texts: list[str]) -> list[list[float]]: ...


class Prefixed:
    """An encoder as an ``Embedder``: prefixes as such models want them, vectors made unit vectors, texts in batches."""

    def __init__(self, encode: Callable[[list[str]], list[list[float]]], dim: int, batch: int = 32):
        self.encode, self.dim, self.batch = encode, dim, batch

    def _embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for a in range(0, len(texts), self.batch):
            for v in self.encode(texts[a : a + self.batch]):
                length = math.sqrt(sum(x * x for x in v)) or 1.0
                out.append([x / length for x in v])
        return out

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return self._embed([f"passage: {x}" for x in texts])

    def embed_queries(self, texts: list[str]) -> list[list[float]]:
        return self._embed([f"query: {x}" for x in texts])


def embedding(embedder: Embedder | None, text: Column, queries: bool = False) -> Column:
    """An embedder over a column, by Arrow batches; the hashing embedder if none is given."""
    if embedder is None:
        return V.hash_embedding(text)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = embedder.embed_queries if queries else embedder.embed_documents
        for batch in batches:
            yield pd.Series([list(map(float, v)) for v in embed([x or "" for x in batch])], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, ArrayType(DoubleType()))(text)


class Reranker(Protocol):
    """Logits of how well texts answer a query; a higher one is better."""

    def score(self, query: str, texts: list[str]) -> list[float]: ...


def reranked(reranker: Reranker, query: Column, text: Column) -> Column:
    """A reranker's scores from 0 to 1 over a column; null where it fails, so that the lexical score stands in."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, texts in batches:
            out = pd.Series([None] * len(texts), dtype="float64")
            for q in queries.unique():
                at = (queries == q).to_numpy()
                try:
                    out[at] = [1 / (1 + math.exp(-x)) for x in reranker.score(q, texts[at].tolist())]
                except Exception:
                    continue
            yield out

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, DoubleType())(query, text)


class Rewriter(Protocol):
    """Other forms of a question: ``alternatives`` (list), ``corrected`` and ``translated`` (texts, empty if none)."""

    def rewrite(self, question: str, lang: str) -> dict: ...


class Remembering:
    """A rewriter that never raises and keeps its latest answers; what it cannot tell is empty."""

    def __init__(self, rewriter: Rewriter | None, most: int = 512):
        self.rewriter = rewriter
        self._ask = lru_cache(most)(self._fresh)

    def _fresh(self, question: str, lang: str) -> tuple[tuple[str, ...], str, str]:
        said = self.rewriter.rewrite(question, lang) if self.rewriter else {}
        text = lambda k: str(said.get(k) or "").strip()
        return tuple(str(x).strip() for x in said.get("alternatives") or () if str(x).strip()), text("corrected"), text("translated")

    def rewrite(self, question: str, lang: str) -> tuple[list[str], str, str]:
        try:
            alternatives, corrected, translated = self._ask(question, lang)
        except Exception:
            return [], "", ""
        return list(alternatives), corrected, translated


class Planner(Protocol):
    """The next action of a turn as JSON text. Raises ``Rejected`` where the provider refuses its own output."""

    def plan(self, messages: list[dict]) -> str: ...


class Rejected(Exception):
    """A provider's own check refused what its model made."""


class RulePlanner:
    """Looks first, then answers. No model."""

    def plan(self, messages: list[dict]) -> str:
        state = json.loads(messages[-1]["content"]) if messages[-1]["content"].startswith("{") else {}
        question = state.get("question", "")
        if not state.get("retrieved"):
            return json.dumps({"action": "retrieve", "arguments": {"question": question}})
        return json.dumps({"action": "generate", "arguments": {"question": question}})


class Generator(Protocol):
    provider: str

    def invoke(self, prompt: str) -> str: ...

    def stream(self, prompt: str) -> Iterator[str]: ...


class Extractor(Protocol):
    def extract(self, text: str, lang: str) -> dict: ...


class ExtractiveGenerator:
    """Answers with the sentences of a prompt's material that share most words with its last line, each once. No model."""

    provider = "extractive"

    def __init__(self, sentences: int = 3):
        self.sentences = sentences

    def invoke(self, prompt: str) -> str:
        task, *body = [x for x in prompt.strip().split("\n") if x.strip()] or [""]
        question = body.pop() if body else task
        if "[end]" in body:  # the material stands between marks
            end = len(body) - body[::-1].index("[end]") - 1
            start = next((i for i, x in enumerate(body) if x.startswith("[") and x.endswith("]")), -1)
            body = body[start + 1 : end]
        elif question == "[end]":
            body, question = body[1:], task
        wanted = set(re.findall(r"\w+", question.lower()))
        found, seen = [], set()
        for line in body:
            for s in re.split(r"(?<=[.!?؟۔])\s+", line):
                form = " ".join(s.lower().split())
                if form and form not in seen and not (form.startswith("[") and form.endswith("]")):
                    seen.add(form)
                    found.append(s.strip())
        order = sorted(range(len(found)), key=lambda i: (-len(wanted & set(re.findall(r"\w+", found[i].lower()))), i))[: self.sentences]
        return " ".join(found[i] for i in sorted(order))

    def stream(self, prompt: str) -> Iterator[str]:
        for word in self.invoke(prompt).split(" "):
            yield word + " "
