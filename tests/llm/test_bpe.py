"""The numpy encoder against two libraries, and edge cases."""

import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallgrass.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.isdir(bpe.TOKENIZERS), reason="no vocabulary files")


@pytest.fixture(scope="module")
def vocab():
    return bpe.load()


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def ids(vocab, texts):
    ends, flat = bpe.encode(texts, vocab, {})
    return [flat[ends[i] : ends[i + 1]].tolist() for i in range(len(texts))]


def test_hard_texts(vocab, reference):
    rng = random.Random(0)
    texts = ["", " ", "\n \n", "<|endoftext|>", "don't WE'LL 've", "a" * 3001, "ab" * 700, "x" * 49 + "y" * 48, "１２３ ４", "😀😀é\x1c\x85 ok", "  a　b", "１" * 200, "=" * 90 + "-" * 33, "zażółć gęślą"]
    texts += ["".join(rng.choice("ab  \n\té1９'sA-😀") for _ in range(rng.randint(0, 200))) for _ in range(500)]
    assert ids(vocab, texts) == [reference(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(vocab, reference, s):
    s = s.encode("utf-8", "ignore").decode()
    assert "".join(bpe.pretokens(s)) == s
    assert ids(vocab, [s])[0] == reference(s)


def test_rank_file():
    import tiktoken

    name = f"{bpe.TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(name, "rb"))}
    import public_tokenizers as p

    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Größe und Länge", "数学问题 12", "Сумма двух чисел", "plain text, 3.14", "aaaaaaa" * 30]
    assert ids(bpe.load("byte_bpe_multi_50k"), texts) == [enc.encode_ordinary(t) for t in texts]


def test_small_cache_gives_the_same(vocab, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    cache = {}
    for t in ("one two three four", "two five", "six"):
        ends, flat = bpe.encode([t], vocab, cache)
        assert flat.tolist() == ids(vocab, [t])[0]


def test_table(spark, reference):
    rows = [(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "hello world", "x"), (None, "no key", "x"), (5, "long " * 60_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")  # ids clashes with the result
    got = {r.doc_id: list(r.ids) for r in bpe.encode_corpus(df).collect()}
    assert got == {k: reference(t) if t else [] for k, t, _ in rows}
    assert bpe.encode_corpus(df.limit(0)).count() == 0


def test_other_kinds_of_vocabulary_are_refused():
    with pytest.raises(ValueError):
        bpe.load("word_bpe_49k")
