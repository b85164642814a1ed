from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import tokens
from tidewright.llm.tokens import ChunkEncoder

tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = tokenizers.Tokenizer.from_file(PATH)
ENCODER = ChunkEncoder(PATH, cache=5)
OTHER = ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"), cache=5)
PARTS = st.sampled_from(["Word", "word,", "don't", "it's.", "Straße", "naïve", "é", "İ", "ΟΔΟΣ", "12ab", "!!", "\x1c", "\x85", "\xa0", " ", "\n", "\t", "<|endoftext|>", "<|ENDOFTEXT|>", "中文", "áb", "ǅ", "'s", "x'll"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(PARTS, st.text(max_size=4)), max_size=12).map("".join))
def test_same_ids_as_the_whole_text(text):
    assert ENCODER.by_chunks
    assert ENCODER.encode(text.encode()).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(PARTS, st.text(max_size=4)), max_size=12).map("".join))
def test_other_vocabularies_encode_whole_texts(text):
    assert not OTHER.by_chunks
    assert OTHER.encode(text.encode()).tolist() == OTHER.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(PARTS, st.text(max_size=4)), max_size=8).map(" ".join), max_size=8))
def test_blocks_know_the_words_of_the_one_before(texts):
    encoder, tokens.BLOCK, whole = ENCODER, 20, tokens.BLOCK
    try:
        assert [x.tolist() for x in encoder.encode_all([t.encode() for t in texts])] == [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]
    finally:
        tokens.BLOCK = whole


class Counted:
    """A tokenizer that counts the words it is given."""

    def __init__(self, inner, seen):
        self.inner, self.seen = inner, seen

    def encode_batch_fast(self, texts, **options):
        self.seen.update(w for t in texts for w in t.split())
        return self.inner.encode_batch_fast(texts, **options)


def test_a_word_goes_through_the_tokenizer_once_a_block():
    """Whatever punctuation follows, and however many others come between."""
    letters = "abcdefghijklmnop"
    names = ["".join(letters[i >> 4 * k & 15] for k in range(4)) for i in range(1 << 16)]
    one, two, three = (" ".join(f"{n}{q}{mark}" for n in names) for q, mark in (("q", ""), ("r", "."), ("s", ",")))
    texts = [one, two, three, one.replace(" ", ", "), two]
    encoder, seen = ChunkEncoder(PATH, cache=5), Counter()
    inner = encoder.tokenizer
    for name in ("tokenizer", "plain"):
        if hasattr(encoder, name):
            setattr(encoder, name, Counted(getattr(encoder, name), seen))
    found = [x.tolist() for x in encoder.encode_all([t.encode() for t in texts])]
    assert found == [inner.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(seen.values()) <= 3 * len(names) + 10
