"""What lies outside the engine: parsers, language models, embedders. Deterministic doubles make all of it testable."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lectern.functions.text import canonical_hash


class Parser(Protocol):
    name: str
    version: str

    def run(self, path: str) -> bytes: ...


class LanguageModel(Protocol):
    def complete(self, request: dict) -> dict: ...


class BatchLanguageModel(LanguageModel, Protocol):
    def batch(self, requests: Sequence[dict]) -> Sequence[dict]: ...


class Embedder(Protocol):
    name: str
    dim: int

    def documents(self, texts: Sequence[str]) -> np.ndarray: ...

    def queries(self, texts: Sequence[str], instruction: str) -> np.ndarray: ...


def truncated(vectors: np.ndarray, dim: int) -> np.ndarray:
    """The first ``dim`` numbers of each vector, then unit length; a zero vector stays zero."""
    v = vectors[:, :dim]
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n > 0, n, 1)


class SeededEmbedder:
    """A unit Gaussian vector per text, seeded by its hash; a query is embedded as instruction, line break, query."""

    def __init__(self, dim: int = 64, name: str = "seeded"):
        self.dim, self.name = dim, name

    def documents(self, texts: Sequence[str]) -> np.ndarray:
        seeds = [int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big") for t in texts]
        return truncated(np.array([np.random.default_rng(s).standard_normal(self.dim) for s in seeds]).reshape(len(texts), self.dim), self.dim)

    def queries(self, texts: Sequence[str], instruction: str) -> np.ndarray:
        return self.documents([f"{instruction}\n{t}" for t in texts])


def embed(rows: DataFrame, key: str, text: str, embedder: Embedder, batch: int = 16) -> DataFrame:
    """(key, emb): texts embedded in batches; the embedder is set up once per task. Null texts have no row."""

    def run(parts: Iterable[pd.DataFrame]):
        for pdf in parts:
            done = [embedder.documents(pdf[text].iloc[a : a + batch].tolist()) for a in range(0, len(pdf), batch)]
            emb = np.concatenate(done).astype(np.float32) if done else np.zeros((0, embedder.dim), np.float32)
            yield pd.DataFrame({key: pdf[key], "emb": list(emb)})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).where(rows[text].isNotNull()).mapInPandas(run, f"`{key}` {kind}, emb array<float>")


def request_hash(request: dict) -> str:
    """Key of a recorded reply: everything of the request but how it is cached."""
    return canonical_hash({k: v for k, v in request.items() if k != "cache_prefix"})


class Recorded:
    """Replies from recordings; the key is computed from the stored request, so an edited one is not found."""

    def __init__(self, recordings: Iterable[str]):
        self.replies = {request_hash(r["request"]): r["completion"] for r in map(json.loads, recordings)}

    def complete(self, request: dict) -> dict:
        key = request_hash(request)
        if key not in self.replies:
            raise KeyError(f"no recording of request {key[:12]}")
        return self.replies[key]


class Canned:
    """The same replies in order, with the requests kept."""

    def __init__(self, replies: Sequence[dict]):
        self.left, self.asked = list(replies), []

    def complete(self, request: dict) -> dict:
        self.asked.append(request)
        return self.left.pop(0)


def complete_missing(requests: DataFrame, known: DataFrame, model_of, key: str = "input_hash", attempts: int = 2) -> DataFrame:
    """(key, reply, error): replies of requests that are not known yet. ``model_of()`` makes a client, once per task.

    A client that takes batches gets the requests of an Arrow batch as one, if there is more than one; if the batch fails,
    all of them have its error. Otherwise they are asked one by one: a request that fails ``attempts`` times has an error
    instead of a reply and stops no other.
    """

    def failure(e: Exception) -> str:
        return f"{type(e).__name__}: {e}"[:300]

    def run(parts):
        client = model_of()
        for pdf in parts:
            rows, asked = [], list(zip(pdf[key], map(json.loads, pdf["request"])))
            if len(asked) > 1 and hasattr(client, "batch"):
                try:
                    rows = [(k, json.dumps(r), None) for (k, _), r in zip(asked, client.batch([q for _, q in asked]), strict=True)]
                except Exception as e:  # a client's failures are data here
                    rows = [(k, None, failure(e)) for k, _ in asked]
            else:
                for k, q in asked:
                    reply = error = None
                    for _ in range(attempts):
                        try:
                            reply, error = json.dumps(client.complete(q)), None
                            break
                        except Exception as e:
                            error = failure(e)
                    rows.append((k, reply, error))
            yield pd.DataFrame(rows, columns=[key, "reply", "error"])

    todo = requests.dropDuplicates([key]).join(known.select(key), key, "left_anti")
    return todo.select(key, "request").mapInPandas(run, f"{key} string, reply string, error string")


class OnePerParagraph:
    """A scripted model: a unit for every paragraph of a request, with its first words as gloss."""

    def complete(self, request: dict) -> dict:
        units = []
        for p in request["paragraphs"]:
            start = (p["text"] or "").split()[:12]
            units.append(
                {"first_pos": p["pos"], "last_pos": p["pos"], "anchor_label": None, "anchor_pos": None, "anchor_kind": None, "anchor_term": None, "gloss": " ".join(start), "key_terms": start[:2], "questions": [f"What of {w}?" for w in start[:3]]}
            )
        return {"units": units}


class OnePerParagraphInBatches(OnePerParagraph):
    def batch(self, requests: Sequence[dict]) -> list[dict]:
        return [self.complete(r) for r in requests]
