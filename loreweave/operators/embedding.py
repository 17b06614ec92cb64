"""Embedding of texts by a plugged-in model, with the hash embedding for what it can't do.

A task keeps its model, made once for a worker, and gives it bounded batches. If a
batch fails, its texts are tried one by one; a text that fails alone, and one whose
vector hasn't the model's length, gets the hash embedding. A report says how many
texts each way took.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions.vectors import CELLS, hash_cells

from .answers import EMBEDDERS, Embedder

#: Texts that a model is given at once.
BATCH = 32
HASH = "hash"
#: Models of this worker, by name and what they were made by.
_MODELS: dict[tuple, Embedder] = {}


def _model(name: str, make) -> Embedder:
    key = (name, make.__module__, make.__qualname__)
    if key not in _MODELS:
        _MODELS[key] = make()
    return _MODELS[key]


def _vectors(model: Embedder, texts: list[str], query: bool) -> list[tuple[list[float] | None, str | None]]:
    """A vector or what went wrong, for each text."""
    encode = model.encode_query if query else model.encode

    def checked(v) -> tuple[list[float] | None, str | None]:
        v = [float(x) for x in v]
        if len(v) != model.dimension:
            return None, f"{len(v)} numbers instead of {model.dimension}"
        return (v, None) if all(map(math.isfinite, v)) else (None, "a number that is none")

    def alone(text: str) -> tuple[list[float] | None, str | None]:
        try:
            (v,) = encode([text])
            return checked(v)
        except Exception as e:  # whatever a model raises
            return None, f"{type(e).__name__}: {e}"

    try:
        found = list(encode(texts))
        if len(found) == len(texts):
            return [checked(v) for v in found]
    except Exception:  # found out text by text
        pass
    return [alone(t) for t in texts]


def embedded(docs: DataFrame, key: str, text: str, provider: str = HASH, query: bool = False, batch: int = BATCH) -> DataFrame:
    """key, backend, embedding, cells, error of every row of docs.

    backend says whose vector it is: the provider's, in embedding, or the hash
    embedding's, in cells (idx, weight). error is why a text hasn't the
    provider's. A model that can't be made fails for all texts. Null texts are empty ones, which
    every backend gets like others. Repeated rows are embedded each. No rows: no
    rows. Other columns are ignored. A provider that isn't known is an error.
    """
    if provider != HASH and provider not in EMBEDDERS:
        raise ValueError(f"no embedder {provider}")
    given = F.coalesce(F.col(text).cast("string"), F.lit(""))
    none = F.lit(None)
    if provider == HASH:
        return docs.select(key, F.lit(HASH).alias("backend"), none.cast("array<double>").alias("embedding"), hash_cells(given).alias("cells"), none.cast("string").alias("error"))
    make, kind = EMBEDDERS[provider], docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                model, failed = _model(provider, make), None
            except Exception as e:  # whatever a model raises
                model, failed = None, f"{type(e).__name__}: {e}"
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                found = _vectors(model, part["_t"].tolist(), query) if model else [(None, failed)] * len(part)
                yield pd.DataFrame({"_k": part["_k"], "_t": part["_t"], "embedding": [v for v, _ in found], "error": [e for _, e in found]})

    # The key passes as a text, since pandas would turn numbers with nulls to floats.
    rows = docs.select(F.col(key).cast("string").alias("_k"), given.alias("_t")).mapInPandas(run, "_k string, _t string, embedding array<double>, error string")
    lost = F.col("embedding").isNull()
    return rows.select(F.col("_k").cast(kind).alias(key), F.when(lost, HASH).otherwise(provider).alias("backend"), "embedding", F.when(lost, hash_cells(F.col("_t"))).cast(CELLS).alias("cells"), "error")


def embedding_report(rows: DataFrame) -> DataFrame:
    """backend, error, n: how many texts each way took, and why."""
    return rows.groupBy("backend", "error").agg(F.count(F.lit(1)).alias("n"))


def with_query_prefix(text: Column, prefix: str = "为这个句子生成表示以用于检索中文文档：") -> Column:
    """A question as models want it that tell questions from documents."""
    return F.concat(F.lit(prefix), text)
