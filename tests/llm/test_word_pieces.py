"""Words and pairs against the library."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lantern.llm import word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["a", "Ab", " ", "\n\t", "'s", "'", "é", "é", "Σ", "ς", "İ", "<|endoftext|>", "<|startoftext|>", "<|", "1", "½", "!?", "\x1c", "​", "　", "漢", "가", "thing", "\x85", "ﬁ", "'LL", "’s", "🙂"]


@pytest.fixture(scope="module")
def library():
    return LIBRARY


def ids(texts):
    return [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in word_bpe.encoder(PATH).encode(texts)]


def test_odd_texts(library):
    draw = random.Random(3)
    texts = ["".join(draw.choice(ODD) for _ in range(draw.randint(0, 50))) for _ in range(3000)]
    assert ids(texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_categories=["Cn", "Co"])))
def test_any_text(text):
    assert ids([text]) == [LIBRARY.encode(text, add_special_tokens=False).ids]


def test_long_words_and_runs(library, monkeypatch):
    monkeypatch.setattr(word_bpe, "RUN_CHARS", 1000)
    monkeypatch.setattr(word_bpe, "LISTED", 500)
    monkeypatch.setattr(word_bpe, "MAX_WORDS", 30)
    texts = ["banana" * 3000, "a" * 5000, "", "the quick brown fox " * 300, *(f"word{i} other{i}" for i in range(200))]
    assert ids(texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_a_pair_of_an_earlier_rank_comes_up_late():
    # 3 = 0+1, and 4 = 3+2 has an earlier rank: the queue of the definition takes it before the other places of 0+1
    merges, pairs = [(3, 2, 4), (0, 1, 3), (3, 0, 5)], {3 << 32 | 2: 0, 0 << 32 | 1: 1, 3 << 32 | 0: 2}
    first = np.full((3, 3), -1, np.int32)
    first[0, 1] = 1
    index = word_bpe.PairIndex(pairs, merges, first, [np.array(w, np.int32) for w in ([0, 1, 2, 0, 1, 0], [0, 1, 0, 1, 2], [2])])
    index.merge()
    assert list(index.words()) == [[4, 5], [3, 4], [2]]


def test_documents(spark, library):
    texts = [None, "", "Hello  world's <|endoftext|> end", "Hello  world's <|endoftext|> end"]
    docs = spark.createDataFrame([(i if i < 3 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, token_ids string")
    told = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    digest = lambda data: hashlib.sha256(data).hexdigest()
    want = [(i if i < 3 else None, len(x), digest(struct.pack(f"<{len(x)}I", *x)), digest(library.decode(x, skip_special_tokens=False).encode())) for i, x in enumerate(told)]
    assert sorted(map(tuple, word_bpe.token_digests(docs, PATH).collect()), key=str) == sorted(want, key=str)
    tokens = word_bpe.encode_documents(docs, PATH)
    assert sorted((r.doc_id, r.token_ids) for r in tokens.where("doc_id is not null").collect()) == [(i, x) for i, x in enumerate(told[:3])]
    assert {r.text for r in word_bpe.decode_documents(tokens, PATH).collect()} == {library.decode(x, skip_special_tokens=False) for x in told}
    assert word_bpe.token_digests(docs.limit(0), PATH).count() == 0
