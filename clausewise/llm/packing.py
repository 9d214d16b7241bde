"""Filling containers of fixed capacity with documents, lexical neighbours together.

Documents go to shards of bounded size.  In a shard, an inverted index with BM25 weights over all tokens
returns the unused neighbours of a seed document, which fill its container greedily, the likest first, as
long as what is left can still be closed by another neighbour; if none can, the neighbour that fits best is taken.  What badly filled containers
held is packed again in later rounds, in fewer shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.encoding import encoder, encode_corpus, vocabulary_path
from clausewise.operators.durable import durable

CAPACITY = 2048
#: Containers' worth of tokens in a shard, and texts; with them, the size of the largest group is fixed.
SHARD_CONTAINERS, SHARD_TEXTS = 600, 10_000
#: Usual BM25 parameters.
K1, B = 1.2, 0.75
#: Tokens that may stay empty when a neighbour is preferred to the best fitting one.
SLACK = 8
#: Containers emptier than this share are packed again; rounds of it.
LOOSE, ROUNDS = 0.004, 3

ITEM = "doc_id bigint, piece int, tokens int, terms array<int>, counts array<int>"


def sized(documents: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, tokens, terms, counts): what is to be placed of each document, sized in tokens, with its different tokens and their counts.

    A document over the capacity comes as full pieces, which need no terms, and its rest; one without tokens not at all.
    """
    ids = encode_corpus(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, tokens in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                t = tokens.values.to_numpy()
                for piece in range(0, -(-len(t) // capacity)):
                    part = t[piece * capacity : (piece + 1) * capacity]
                    terms, counts = np.unique(part, return_counts=True) if len(part) < capacity else (part[:0], part[:0])
                    rows.append((doc, piece, len(part), terms.astype(np.int32), counts.astype(np.int32)))
            if rows:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["doc_id", "piece", "tokens", "terms", "counts"]), schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("tokens", pa.int32()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]))

    return ids.mapInArrow(run, ITEM)


def fill(items: pd.DataFrame, idf: np.ndarray, mean: float, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container number, score) of each item of one shard; the score is that under the container's seed, null for the seed itself and 0 for an item that has no token of it."""
    n = len(items)
    sizes = items["tokens"].to_numpy().astype(np.int64)
    terms = [np.asarray(t, dtype=np.int64) for t in items["terms"]]
    # the inverted index: postings sorted by term, each with its BM25 weight
    owner = np.repeat(np.arange(n), [len(t) for t in terms])
    flat = np.concatenate(terms) if n else np.empty(0, dtype=np.int64)
    tf = np.concatenate([np.asarray(c, dtype=np.float64) for c in items["counts"]]) if n else np.empty(0)
    weight = idf[flat] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[owner] / mean))
    order = np.argsort(flat, kind="stable")
    flat, owner, weight = flat[order], owner[order], weight[order]
    starts = np.searchsorted(flat, np.arange(len(idf) + 1))

    indexed = n
    container, points = np.full(n, -1, dtype=np.int64), np.full(n, np.nan)
    free = np.ones(n, dtype=bool)
    usual = int(np.median(sizes)) if n else 0
    number = 0
    for seed in np.argsort(-sizes, kind="stable").tolist():
        if not free[seed]:
            continue
        container[seed], free[seed], room = number, False, capacity - int(sizes[seed])
        score = np.zeros(n)
        if room and (free & (sizes <= room)).any():
            if free.sum() < indexed / 2:
                # what is placed leaves the index
                kept = free[owner]
                flat, owner, weight, indexed = flat[kept], owner[kept], weight[kept], int(free.sum())
                starts = np.searchsorted(flat, np.arange(len(idf) + 1))
            spans = [slice(a, b) for a, b in zip(starts[terms[seed]].tolist(), starts[terms[seed] + 1].tolist())]
            score = np.bincount(np.concatenate([owner[x] for x in spans]), weights=np.concatenate([weight[x] for x in spans]), minlength=n)
        near = np.flatnonzero(free & (score > 0))
        near = near[np.argsort(-score[near], kind="stable")]
        while room:
            near = near[free[near] & (sizes[near] <= room)]
            if len(near):
                size = sizes[near]
                left = room - size
                # is what is left after a neighbour small, or room for several, or would another neighbour close it?
                upto = np.cumsum(np.bincount(size, minlength=room + 1))
                low = left - SLACK - 1
                closing = upto[left] - np.where(low >= 0, upto[low.clip(0)], 0) - ((size <= left) & (size > low))
                good = (left <= SLACK) | (left >= 2 * usual) | (closing > 0)
                i = int(near[np.argmax(good) if good.any() else np.argmax(size)])
            else:
                others = np.flatnonzero(free & (sizes <= room))
                if not len(others):
                    break
                i = int(others[np.argmax(sizes[others])])
            container[i], free[i], points[i], room = number, False, score[i], room - int(sizes[i])
        number += 1
    return container, points


def pack(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, container, tokens, score): each document's container, or one row for each piece of a document over the capacity.

    `score` is what the document got under its container's seed, null for the seed and for what fills a container by itself.

    No container holds more than `capacity` tokens and no document of up to `capacity` is split.
    Null and empty texts take no space: they are listed with 0 tokens, piece 0, in the container with the smallest name, or in 'none' if there is
    no other text.  Equal texts are packed each under its own id; columns besides `doc_id` and `text` are ignored.
    What reaches the driver is bounded by the vocabulary: the document frequency of each token.
    """
    spark = documents.sparkSession
    items = durable(sized(documents, capacity))
    loose = items.where(F.col("tokens") < capacity)
    size = loose.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).first()
    n, total = size["n"] or 0, size["t"] or 0
    df = np.zeros(len(encoder(vocabulary_path()).ranks) + 1)
    for r in loose.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r["term"]] = r["count"]
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    mean = max(1.0, total / max(1, n))
    shared = spark.sparkContext.broadcast(idf)

    placed = items.where(F.col("tokens") == capacity).select("doc_id", "piece", F.format_string("full-%d-%d", "doc_id", "piece").alias("container"), "tokens", F.lit(None).cast("double").alias("score"))
    for turn in range(ROUNDS):
        shards = max(1, -(-total // (SHARD_CONTAINERS * capacity)), -(-n // SHARD_TEXTS))

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            c, points = fill(pdf, shared.value, mean, capacity)
            used = np.bincount(c, weights=pdf["tokens"]) if len(c) else np.empty(0)
            out = pdf[["doc_id", "piece", "tokens", "terms", "counts"]].copy()
            out["container"] = [f"{turn}-{s}-{k}" for s, k in zip(pdf["shard"], c)]
            out["score"] = points
            out["room"] = (capacity - used[c]).astype(np.int32)
            if turn < ROUNDS - 1:
                tight = out["room"] <= LOOSE * capacity
                out.loc[tight, ["terms", "counts"]] = None
            return out

        sharded = loose.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(shards)).cast("int"))
        filled = durable(sharded.groupBy("shard").applyInPandas(one, f"{ITEM}, container string, score double, room int"))
        last = turn == ROUNDS - 1
        done = filled if last else filled.where(F.col("room") <= LOOSE * capacity)
        placed = placed.unionByName(done.select("doc_id", "piece", "container", "tokens", F.nanvl("score", F.lit(None).cast("double")).alias("score")))
        if not last:
            loose = filled.where(F.col("room") > LOOSE * capacity).select("doc_id", "piece", "tokens", "terms", "counts")
            size = loose.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).first()
            n, total = size["n"], size["t"] or 0
            if not total:
                break
    first = placed.agg(F.coalesce(F.min("container"), F.lit("none")).alias("container")).first()["container"]
    nothing = documents.where(F.col("text").isNull() | (F.col("text") == "")).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(0).alias("piece"), F.lit(first).alias("container"), F.lit(0).alias("tokens"), F.lit(None).cast("double").alias("score"))
    return placed.unionByName(nothing)
