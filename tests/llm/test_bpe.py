import hashlib
import random
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from textloom.llm import bpe
from tokenizers import Tokenizer

ODD = ["", " ", "Hello's WORLD'S I'll ΣΑΣ İstanbul ǅ ﬁ x́ é a b\x1cc\x85d​", "<|startoftext|>A<|endoftext|> b <|STARTOFTEXT|>", "aaa aaaa aaaaa 123 ①²½ ٣ 😀!!", "x" * 5000, "don't 'S 'Re we'Ve\n\n\tz", "ſ K Å ẞ", "Erst,### eror***"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def same(library, texts, got):
    for text, (n, ids, decoded) in zip(texts, got, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and n == len(want)
        assert decoded.decode() == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abethnoi'sABÉéß1٣!#😀 \ń <|>"), max_size=60), max_size=5))
def test_any_text_is_encoded_like_the_library(texts):
    same(Tokenizer.from_file(bpe.default_path()), texts, bpe.tokenizer(bpe.default_path()).encode_batch(texts))


def test_small_memory_changes_nothing(library, monkeypatch):
    own = bpe.PairIndexBPE(bpe.default_path())
    own.runs.most = own.seen_words.most = 3
    for _ in range(3):
        same(library, ODD, own.encode_batch(ODD))
        same(library, ODD[::-1], own.encode_batch(ODD[::-1]))


def test_rows(spark, library):
    rows = [(k, t, "clash") for k, t in enumerate(ODD)] + [(None, None, "x"), (1, "twice", "y"), (1, "twice", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((x.doc_id if x.doc_id is not None else -1, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in bpe.digests(df).collect())
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((-1 if i is None else i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    full = bpe.encode(df.where("doc_id = 4")).first()
    assert full.ids == library.encode(ODD[4], add_special_tokens=False).ids and full.decoded == library.decode(full.ids, skip_special_tokens=False)
    assert bpe.digests(df.where("false")).count() == 0


def test_many_words_are_merged_by_rank_not_by_place(library):
    some, own = random.Random(7), bpe.PairIndexBPE(bpe.default_path())
    pieces = ["the", "tion", "er", "aa", "aaa", "ing", "éa", "o", "wh", "xx", "st", "ou"]
    words = sorted({"".join(some.choices(pieces, k=some.randint(1, 7))) for _ in range(20_000)})
    lines = 0

    def trace(frame, event, _):
        nonlocal lines
        lines += event == "line"
        return trace if frame.f_code.co_filename == bpe.__file__ else None

    before = sys.gettrace()
    sys.settrace(trace)
    try:
        own.merge([x.encode() for x in words])
    finally:
        sys.settrace(before)
    symbols = sum(len(x.encode()) for x in words)
    assert lines < symbols, (lines, symbols)  # a loop over places takes several lines for each
    texts = [" ".join(words[k::9]) for k in range(9)] + ["<|endoftext|>" + "".join(words[:50]) + "  <|endoftext|>"]
    same(library, texts, own.encode_batch(texts))
