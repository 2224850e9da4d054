import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from paralens.llm import ragged
from paralens.llm.ragged import flat
from paralens.llm.token_counts import Vocabulary, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["'", "s", "t", "re", "ve", "ll", " ", "  ", "\n", "\t", "a", "B", "1", "9", "!", "é", "漢", " ", "\xa0", "<|endoftext|>", "<|endof", "’", "😀", "'S", "\r\n", "٣", "ñ", "\x00", "aaaa", "<"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def counts(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_random_strings_equal_the_library(library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", "'", "'s", " 's", "!'s", "a" * 3000, " " * 500, "ab" * 2000, "<|endoftext|>" * 3, "x <|endoftext|> y"]
    assert Vocabulary(PATH).count(*flat(pa.array(texts))).tolist() == counts(library, texts)


@pytest.mark.parametrize("collide", [False, True])
def test_pre_tokens_are_told_apart_by_bytes(library, thue_morse, collide, monkeypatch):
    if collide:
        monkeypatch.setattr(ragged.Hashes, "of", lambda self, a, b: np.full(len(a), 7, np.uint64))
    texts = [*thue_morse, "one two three one", thue_morse[1] + " " + thue_morse[0]]
    vocabulary = Vocabulary(PATH)
    for _ in range(2):  # the second time from what was remembered
        assert vocabulary.count(*flat(pa.array(texts))).tolist() == counts(library, texts)


def test_corpus_equals_the_library(docs, texts, library):
    found = {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(docs, PATH).collect()}
    assert [found[k] for k in range(len(texts))] == list(zip((len(t.encode()) for t in texts), counts(library, texts), strict=True))


def test_odd_rows(odd, none):
    rows = count_tokens(odd, PATH).collect()
    assert len(rows) == odd.count() and sum(r.n_tokens == 0 for r in rows) == 4
    assert count_tokens(none, PATH).count() == 0
