import collections
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clausewise.llm import encoding, packing

PATH = encoding.vocabulary_path()
ENCODER = encoding.PrefixEncoder(PATH)


def reference(texts):
    tiktoken = pytest.importorskip("tiktoken")
    own = tiktoken.Encoding("own", pat_str=encoding.WORDS, mergeable_ranks=ENCODER.ranks, special_tokens={})
    return [own.encode_ordinary(t or "") for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("合同条款 应当thereing'sll01 \n")), max_size=80), max_size=6))
def test_same_as_the_tokenizer(texts):
    assert [x.tolist() for x in ENCODER.encode(texts)] == reference(texts)


def test_same_as_the_tokenizer_file():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    texts = ["合同承办人在付款申请提交后不得统一编号", "<|endoftext|> The data controller's", "  \n\n x", "①²ｶﾅ"]
    assert [x.tolist() for x in ENCODER.encode(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_the_table_of_last_tokens_is_appended_to():
    word = " counterproductivelyness".encode()
    whole = []
    ENCODER.extend(whole, word)
    for cut in (1, 5, 12):
        part = whole[:cut]
        ENCODER.extend(part, word)
        assert part == whole
    assert b"".join(ENCODER.bytes_of[t] for t in ENCODER.read_back(whole, len(word))) == word


def test_corpus_edges(spark):
    texts = [None, "", " ", "甲", "甲", "长文" * 20_000]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in encoding.encode_corpus(d).collect()}
    assert [got[i] for i in range(len(texts))] == reference(texts)
    assert encoding.encode_corpus(d.where("doc_id < 0")).count() == 0


def checked(rows, sizes, capacity):
    used, whole, pieces = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        used[r.container] += r.tokens
        whole[r.doc_id] += r.tokens
        pieces[r.doc_id] += 1
    assert dict(whole) == sizes
    assert max(used.values()) <= capacity
    assert all(pieces[d] == max(1, -(-n // capacity)) for d, n in sizes.items())
    return used


def test_packing(spark):
    rng = random.Random(2)
    words = ["合同", "采购", "审计", "仲裁", "the data controller ", "印章", "档案"]
    texts = ["".join(rng.choices(words, k=rng.randint(1, 300))) for _ in range(250)] + [None, "", "合同" * 3000]
    texts += [texts[0]] * 5
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sizes = {i: len(x) for i, x in enumerate(reference(texts))}
    used = checked(packing.pack(d, 512).collect(), sizes, 512)
    least = -(-sum(sizes.values()) // 512)
    assert len([c for c in used if used[c]]) <= least * 1.02 + 2


def test_packing_of_nothing(spark):
    d = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert {(r.doc_id, r.container, r.tokens) for r in packing.pack(d).collect()} == {(1, "none", 0), (2, "none", 0)}
    assert packing.pack(d.where("doc_id < 0")).count() == 0


def test_neighbours_share_a_container():
    import pandas as pd

    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        group = i % 6
        terms = np.unique(rng.integers(group * 50, group * 50 + 50, size=30))
        rows.append((i, 0, 50, terms, np.ones(len(terms))))
    items = pd.DataFrame(rows, columns=["doc_id", "piece", "tokens", "terms", "counts"])
    c, points = packing.fill(items, np.ones(400), 50.0, 200)
    same = sum(len({i % 6 for i in np.flatnonzero(c == k)}) == 1 for k in set(c))
    assert np.bincount(c).max() <= 4 and same >= 20
