"""Ids are those of the tokenizers library for the same vocabulary file."""

import duckdb
import numpy as np
from conftest import cases
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkveil.llm import edits, tokenizing

PATH = tokenizing.default_path()
REFERENCE = Tokenizer.from_file(PATH)
WORDS = tokenizing.words(PATH)


def ids(text):
    return np.frombuffer(WORDS.ids(text), "<u4").tolist()


def test_given_texts():
    texts = [t or "" for _, t in cases()] + [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    for text in texts:
        assert ids(text) == REFERENCE.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abAZ09 \t\n\r'.,-_sdltrevm²ªßéÜ\x85\xa0 漢🙂\x1c")), max_size=60))
def test_odd_texts(text):
    assert ids(text) == REFERENCE.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 9'.s\n")), max_size=400), st.lists(st.tuples(st.integers(-2, 420), st.integers(0, 300), st.text(alphabet=st.sampled_from(list("ab 9'.s\n")), max_size=20)), max_size=4))
def test_edits_equal_a_fresh_count(text, changes):
    d = edits.Document(text, WORDS)
    for at, removed, inserted in changes:
        d.edit(at, removed, inserted)
        at = min(max(at, 0), len(text))
        text = text[:at] + inserted + text[at + removed :]
        assert d.text == text and d.tokens == len(WORDS.bpe.encode_ordinary(text))
