import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import token_counts as T

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter():
    return T.Counter(T.read_vocabulary(PATH))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_mixed_scripts_and_spaces(counter, library):
    r = random.Random(3)
    parts = [*"abstmdrevl'   \n\t\r\x0b\x85\xa0’.,!?019²½äß漢кир　\U0001f600́\x1c\x00", "<|endoftext|>", "'re", "'ll", "'s", " the", "ing", "ÃÂ"]
    texts = ["".join(r.choice(parts) for _ in range(r.choice((1, 3, 10, 80)))) for _ in range(4000)]
    assert counter.counts(texts).tolist() == library(texts)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_any_text(counter, library, text):
    assert counter.counts([text]).tolist() == library([text])


@pytest.mark.parametrize("chunk", [1, 2, 7, 1000])
def test_chunks_compose(chunk):
    text = "don't  'll  x'ss\n\n 12a  ''re end \n"
    codes = np.array([ord(c) for c in text], np.uint32)
    ends = np.array([len(text) - 1])
    assert T.pretoken_starts(codes, ends, chunk).tolist() == T.pretoken_starts(codes, ends, 64).tolist()


def test_long_runs(counter, library):
    texts = ["a" * 3000, " " * 4000 + "x", "ab" * 2000]
    assert counter.counts(texts).tolist() == library(texts)


def test_odd_rows(odd, none, library):
    rows = T.count_tokens(odd, PATH).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 10 and (by[1].n_bytes, by[1].n_tokens) == (0, 0) == (by[2].n_bytes, by[2].n_tokens)
    assert by[4].n_tokens == library(["word " * 20_000 + "end"])[0] and by[4].over_limit and not by[8].over_limit
    assert T.count_tokens(none, PATH).count() == 0
