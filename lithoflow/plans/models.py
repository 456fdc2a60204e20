"""Places for models: a text embedder and a language model, each a callable; without one, deterministic stand-ins."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

Embedder = Callable[[list[str]], np.ndarray]
LanguageModel = Callable[[str], str]
#: Of the path of an image and a question, what it shows.
VisionModel = Callable[[str, str], str]

DIM = 384
_WORD = re.compile(r"\w+")


def hashed_ngrams(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Vectors of length 1 from words and letter triples, each at a place and with a sign given by its hash; of an empty text zero."""
    out = np.zeros((len(texts), dim), np.float32)
    for row, text in zip(out, texts):
        for w in _WORD.findall(text.lower()):
            padded = f"^{w}$"
            for part in (padded, *(padded[i : i + 3] for i in range(len(padded) - 2))):
                h = xxhash.xxh64_intdigest(part)
                row[h % dim] += 1.0 if h >> 63 else -1.0
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=out, where=size > 0)


def embedded(df: DataFrame, key: str, text: str, embedder: Embedder = hashed_ngrams) -> DataFrame:
    """``key, embedding``: the vectors of texts, batch by batch on the executors; null has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            known = [t for t in texts if t is not None]
            vectors = iter(embedder(known)) if known else iter(())
            rows = [None if t is None else next(vectors).tolist() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float32()))], names=["key", "embedding"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, embedding array<float>").withColumnRenamed("key", key)


def no_model(prompt: str) -> str:
    """Stands in for a language model: says nothing."""
    del prompt
    return ""


def no_vision(path: str, question: str) -> str:
    """Stands in for a model that sees: says nothing."""
    del path, question
    return ""


def replied(model: LanguageModel, prompt: str) -> str:
    """The model's reply, or that it failed and why: one prompt doesn't end a job."""
    try:
        return model(prompt)
    except Exception as error:  # noqa: BLE001
        return f"Error: {error}"


def with_replies(prompts: DataFrame, model: LanguageModel, prompt: str = "prompt") -> DataFrame:
    """``prompts`` with ``reply``; the model is asked on the executors, a prompt a row, null for a null one."""

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index(prompt)).to_pylist()
            replies = pa.array([None if t is None else replied(model, t) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, replies], names=[*b.schema.names, "reply"])

    x = prompts.drop("reply")
    return x.mapInArrow(run, StructType([*x.schema.fields, StructField("reply", StringType())]))


def seen(model: VisionModel, path: str, question: str, context: str | None, ask: LanguageModel = no_model) -> tuple[str, float]:
    """What an image shows and how sure that is: a language model's words on what the vision model sees, if they are any good (0.8), else the latter (0.4)."""
    shown = replied(lambda q: model(path, q), question)
    better = replied(ask, f"Image: {shown}\nContext: {context or ''}\nQuestion: {question}\nAnswer in two or three sentences by the context alone.")
    return (better, 0.8) if len(better) > 50 and not better.startswith("Error: ") else (shown, 0.4)
