"""Pluggable models as functions of batches, with stand-ins that need no weights."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Batch = Callable[[list[str]], list]


def _in_batches(load: Callable[[], Batch], size: int, kind: pa.DataType, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                model = model or load()  # once for each task, and only where there is work
                part = batch.slice(at, size)
                out = model(part.column(1).to_pylist())
                if len(out) != part.num_rows:
                    raise ValueError(f"the model returned {len(out)} results for {part.num_rows} rows")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, kind)], names=["id", name])

    return run


def embedder(load: Callable[[], Batch], size: int = 64):
    """A function of a DataFrame (id, text) to one of (id, embedding)."""
    return lambda df: df.select(F.col("id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_in_batches(load, size, pa.list_(pa.float32()), "embedding"), "id string, embedding array<float>")


def generator(load: Callable[[], Batch], size: int = 12):
    """A function of a DataFrame (position, prompt) to one of (position, value)."""
    return lambda df: df.select(F.col("position").cast("string").alias("id"), "prompt").mapInArrow(_in_batches(load, size, pa.string(), "value"), "id string, value string").select(F.col("id").cast("long").alias("position"), "value")


def hashed_words(dims: int = 64) -> Callable[[], Batch]:
    """A stand-in embedder: each word adds a fixed unit vector drawn from its hash."""

    def load() -> Batch:
        def embed(texts: list[str]) -> list:
            out = np.zeros((len(texts), dims), np.float32)
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    out[i] += np.random.default_rng(int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "little")).standard_normal(dims)
            n = np.linalg.norm(out, axis=1, keepdims=True)
            return list(out / np.where(n == 0, 1, n))

        return embed

    return load


def first_words(n: int = 24) -> Callable[[], Batch]:
    """A stand-in generator: the first words of the prompt's last line."""
    return lambda: lambda prompts: [" ".join((p or "").rsplit("\n", 1)[-1].split()[:n]) for p in prompts]


def fixed_judge() -> Callable[[], Batch]:
    """A stand-in judge: a score by the length of the prompt's last line."""
    return lambda: lambda prompts: ['{"score": %d, "reason": "by length"}' % (len((p or "").rsplit("\n", 1)[-1]) % 5) for p in prompts]


def ask(df: DataFrame, embed, template: str = "Find passages that answer: ") -> DataFrame:
    """Embeddings of questions (id, text); queries carry an instruction that passages do not."""
    return embed(df.select("id", F.concat(F.lit(template), "text").alias("text")))
