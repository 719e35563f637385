import os
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from memlake.llm import tokens

PATH = f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


def whole(text):
    encoding, _ = tokens.tokenizer(PATH)
    return encoding.encode_ordinary(text)


ALPHABET = st.text(alphabet=st.sampled_from(list("ab12 '.\n\tséß記 　!😀")), max_size=60)


@settings(max_examples=400, deadline=None)
@given(ALPHABET, st.integers(1, 7), st.integers(1, 4))
def test_tree_equals_whole(text, leaf, window):
    tree = tokens.TreeEncoder(PATH, leaf, window)
    ids = tree.encode(text)
    assert ids == whole(text)
    assert tree.decode(ids) == text


def test_long_pieces_and_runs():
    tree = tokens.TreeEncoder(PATH, 16, 4)
    rng = random.Random(5)
    for text in (" " * 300 + "a", "a" * 700, "\n" * 99 + "b" * 99 + " " * 99, "".join(rng.choice("ab \n") for _ in range(5000)), "<|endoftext|>"):
        assert tree.encode(text) == whole(text)


def test_null_empty_blank_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, "hello world"), (4, "hello world")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids")
    got = sorted((r.doc_id, r.ids) for r in tokens.encode_corpus(df).collect())
    assert got == sorted((i, whole(t) if t else []) for i, t in rows)
    assert tokens.encode_corpus(df.limit(0)).count() == 0
