"""Encoding a corpus with a public byte-level BPE vocabulary by prefix dynamic programming.

For every byte prefix of a word there is one last token with which its encoding ends: the
token `t` for which the encoding of the rest ends in a token that `t` may follow, that is,
the two tokens' bytes taken together encode as just these two.  The table of last tokens
depends on nothing after the prefix.  So appending leaves it as it is, and words that
share a beginning share its part of the table; an edit needs new entries only from its place on.
"""

from __future__ import annotations

import base64
import importlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.operators.skew import spread

#: Where the vocabulary files lie; a folder, so that a cluster can name its own.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How the vocabulary cuts text into words (fixed value, public pattern of this vocabulary).
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bounds of what a worker keeps between batches; beyond them it starts afresh.
PAIRS_KEPT, WORDS_KEPT = 1_000_000, 150_000


class PrefixEncoder:
    """Encodes words over a table of ranks; keeps pair decisions and encoded words."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.words = regex.compile(WORDS)
        # tokens by their bytes read backwards: {byte: [deeper, token or -1]}
        self.backwards: dict = {}
        for token, rank in self.ranks.items():
            level: dict = self.backwards
            for byte in token[:0:-1]:
                level = level.setdefault(byte, [{}, -1])[0]
            level.setdefault(token[0], [{}, -1])[1] = rank
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, np.ndarray] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The encoding by definition: join the adjacent pair of the lowest rank until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[x] for x in parts]

    def may_follow(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def extend(self, last: list[int], word: bytes) -> None:
        """Add the last token of each prefix of `word` that `last` does not have yet."""
        pairs, top = self.pairs, self.backwards
        for i in range(len(last), len(word)):
            level, j = top, i
            while True:
                entry = level.get(word[j])
                if entry is None:
                    raise ValueError("no token of the vocabulary ends this prefix")
                level, token = entry
                if token >= 0:
                    if j == 0:
                        break
                    left = last[j - 1]
                    ok = pairs.get(left << 20 | token)
                    if ok is None:
                        ok = self.may_follow(left, token)
                    if ok:
                        break
                j -= 1
            last.append(token)

    def read_back(self, last: list[int], size: int) -> list[int]:
        out, i = [], size
        while i:
            token = last[i - 1]
            out.append(token)
            i -= len(self.bytes_of[token])
        out.reverse()
        return out

    def learn(self, words: set[str]) -> None:
        """Encode the words not known yet, in byte order, each from what it shares with the one before."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        last: list[int] = []
        before = b""
        for text, word in sorted(((w, w.encode("utf-8", "surrogatepass")) for w in words if w not in self.known), key=lambda x: x[1]):
            same = len(os.path.commonprefix([before, word]))
            del last[same:]
            self.extend(last, word)
            self.known[text] = np.array(self.read_back(last, len(word)), dtype=np.int32)
            before = word

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.words.findall(t) if t else [] for t in texts]
        self.learn({w for words in cut for w in words})
        known = self.known
        return [np.concatenate([known[w] for w in words]) if words else np.empty(0, dtype=np.int32) for words in cut]


_encoders: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """The encoder of this worker process."""
    if path not in _encoders:
        _encoders[path] = PrefixEncoder(path)
    return _encoders[path]


def vocabulary_path() -> str:
    here = f"{TOKENIZERS}/{VOCABULARY}"
    if os.path.exists(here):
        return here
    return importlib.import_module("public_tokenizers").path(VOCABULARY)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids array<int>): each text as token ids, without special tokens.

    Null and empty texts have the empty list; strings of special tokens are ordinary text.
    Each row is encoded for itself, so ties and repeated rows need nothing; columns besides
    `key` and `text` are ignored.
    """
    path = path or vocabulary_path()
    # executors that do not have the file at this place get it
    documents.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)
    rows = spread(documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path if os.path.exists(path) else SparkFiles.get(name))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            # a batch of long texts goes in parts, so that its ids stay small in memory
            begin, size = 0, 0
            for end, t in enumerate(texts, 1):
                size += len(t or "")
                if size >= 1_000_000 or end == len(texts):
                    ids = enc.encode(texts[begin:end])
                    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                    np.cumsum([len(x) for x in ids], out=offsets[1:])
                    flat = np.concatenate(ids) if ids else np.empty(0, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, end - begin), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))], names=["doc_id", "ids"])
                    begin, size = end, 0

    out = rows.mapInArrow(run, "doc_id bigint, ids array<int>")
    return out if key == "doc_id" else out.withColumnRenamed("doc_id", key)
