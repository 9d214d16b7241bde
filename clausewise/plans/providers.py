"""Models outside Spark, called from tasks in batches; each has a way without a model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a model gets at once, how often a failing call is repeated, and the seconds between.
BATCH, RETRIES, WAIT_S = 64, 3, 1.5


def in_batches(rows: DataFrame, call: Callable[[list[str]], list], schema: str, text: str, batch: int = BATCH, retries: int = RETRIES, wait_s: float = WAIT_S) -> DataFrame:
    """`rows` with the column `result` of `schema`, from calls of `batch` texts each, in every task for itself; a call that fails `retries` times gives nulls."""
    out = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, result {schema}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got: list = []
            for at in range(0, len(pdf), batch):
                texts = pdf[text].iloc[at : at + batch].tolist()
                for turn in range(retries):
                    try:
                        got += call(texts)
                        break
                    except Exception:
                        if turn + 1 == retries:
                            got += [None] * len(texts)
                        else:
                            time.sleep(wait_s * (turn + 1))
            yield pdf.assign(result=pd.Series(got, index=pdf.index, dtype=object))

    return rows.mapInPandas(run, out)


def ngram_matrix(texts: list[str | None], size: int = 256, n: int = 3) -> np.ndarray:
    """A unit vector of hashed character n-grams for each text, all texts at once; blank texts have the zero vector."""
    said = [t or "" for t in texts]
    codes = np.frombuffer("".join(said).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(t) for t in said], dtype=np.int64)
    owner, ends = np.repeat(np.arange(len(said)), lengths), np.repeat(np.cumsum(lengths), lengths)
    at = np.flatnonzero(np.arange(len(codes)) + n <= ends)
    h = np.full(len(at), 2166136261, dtype=np.uint32)
    for k in range(n):
        h = (h ^ codes[at + k]) * np.uint32(16777619)
    v = np.bincount(owner[at] * size + h % size, weights=np.where(h >> 31, 1.0, -1.0), minlength=len(said) * size).reshape(len(said), size)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def embedded(rows: DataFrame, text: str, call: Callable[[list[str]], list] | None = None) -> DataFrame:
    """`rows` with `vector`, by the given model or by hashed n-grams."""
    if call:
        return in_batches(rows, call, "array<double>", text).withColumnRenamed("result", "vector")

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = ngram_matrix(b.column(b.schema.get_field_index(text)).to_pylist())
            yield b.append_column("vector", pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), m.ravel()))

    return rows.mapInArrow(embed, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, vector array<double>")


def refined(chunks: DataFrame, confidence: str, call: Callable[[list[str]], list] | None, below: float = 0.72, most: int = 18) -> DataFrame:
    """Chunks whose least sure rows of each document, up to `most`, were given to a model; without one, as they are."""
    if call is None:
        return chunks
    from pyspark.sql import Window

    w = Window.partitionBy("document_id").orderBy(confidence, "id")
    weak = chunks.withColumn("_n", F.row_number().over(w)).withColumn("_weak", (F.col(confidence) < below) & (F.col("_n") <= most)).drop("_n")
    better = in_batches(weak.where("_weak").drop("_weak"), call, "string", "content", batch=8)
    fixed = better.withColumn("content", F.coalesce("result", "content")).drop("result")
    return weak.where("not _weak").drop("_weak").unionByName(fixed)
