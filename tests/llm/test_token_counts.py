import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barquarry.llm.token_counts import TOKENIZER, merge_counter, token_counts

PATH = public_tokenizers.path(TOKENIZER)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["the", "don't", " ", "\n", "Σσς", "é", "é", "9٣²", "<|endoftext|>", "<|ENDOFTEXT|>", "日本", "🙂", " ", "'LL", "xx"]) | st.text(max_size=4), max_size=12))
def test_counts_are_the_librarys(library, parts):
    text = "".join(parts)
    assert merge_counter(PATH).text(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_awkward_rows(awkward, library):
    texts = {r.doc_id: r.text or "" for r in awkward.collect()}
    rows = token_counts(awkward).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        text = texts[r.doc_id]
        assert r.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
        assert r.n_bytes == len(text.encode()) and r.over_limit == (r.n_tokens > 2048)


def test_no_rows(no_rows):
    assert token_counts(no_rows).count() == 0
