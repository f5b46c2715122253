import os
import random

import pytest

from sieveline.llm import tokenize as p7

pytestmark = pytest.mark.skipif(not os.path.exists(f"{p7.TOKENIZERS}/{p7.TOKENIZER}.json"), reason="no tokenizer files")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{p7.TOKENIZERS}/{p7.TOKENIZER}.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


R = random.Random(2)
TEXTS = ["", " ", "Hello  world's\n\nend ", "<|endoftext|> is text", "漢字かな交じり文" * 80, "a" * 1500, "".join(R.choice("aeioust ") for _ in range(900)), "\ufeff naïve Ω 👩\u200d💻 \x1b[31m\u2028", "abab" * 300, "１２３ 456,789.0"]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_and_round_trip(text, reference):
    enc = p7.encoder(p7.TOKENIZER, p7.TOKENIZERS)
    (ids,) = enc.encode([text])
    assert ids == reference(text)
    assert enc.decode(ids) == text


def test_very_long_words(reference):
    enc = p7.encoder(p7.TOKENIZER, p7.TOKENIZERS)
    for word in ("".join(R.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12_000)), "a" * 30_000, "ab" * 9_001):
        (ids,) = enc.encode([word])
        assert ids == reference(word)
        assert enc.decode(ids) == word


def test_rank_files(spark):
    import base64

    import tiktoken

    name = "byte_bpe_multi_50k"
    with open(f"{p7.TOKENIZERS}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=p7.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert list(p7.Encoder(name, p7.TOKENIZERS).encode(TEXTS)) == [other.encode_ordinary(t) for t in TEXTS]


def test_table(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a b", 0), (3, "a b", 0)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, list(r.ids)) for r in p7.encode(df, "doc_id", "text").collect())
    assert got == [(1, []), (2, []), (3, [64, 275]), (3, [64, 275])]
    assert p7.encode(df.limit(0), "doc_id", "text").count() == 0
    assert sorted((r.doc_id, r.text) for r in p7.decode(p7.encode(df, "doc_id", "text"), "doc_id", "ids").collect()) == [(1, ""), (2, ""), (3, "a b"), (3, "a b")]
    assert sorted(map(tuple, p7.count_tokens(df, "text", keep=("doc_id",)).collect())) == [(1, 0), (2, 0), (3, 2), (3, 2)]
