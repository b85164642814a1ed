"""Token ids of whole texts by a public tokenizer: each distinct white-space-delimited chunk of a block of texts once."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The normalizer and the splits for which a text's ids are those of its chunks. Texts of other vocabularies are encoded whole.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
#: Lower-case letters of ASCII, all others of Latin-1, and ASCII punctuation (no apostrophe): the vocabulary splits a chunk just between them.
_LATIN = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of text whose chunks are told apart at once, and words in a call of the tokenizer, which holds much more than their ids.
BLOCK, CALL = 1 << 22, 1 << 13


def gathered(values: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values with numbers `at`, laid end to end, and their sizes. sizes: of all runs, in their order in values."""
    starts, own = np.cumsum(sizes) - sizes, sizes[at]
    ends = np.cumsum(own)
    return values[np.repeat(starts[at] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)], own


class ChunkEncoder:
    """Encodes UTF-8 texts. Where the vocabulary lowers case, drops white space and never merges across it, a text's ids are
    those of its chunks in turn; a chunk of letters and punctuation has the ids of the one, then the other. Each distinct part
    goes through the tokenizer once a block; of words of letters the first `cache` of a block are known to the next, so memory is
    bounded however many distinct chunks the corpus has."""

    def __init__(self, path: str, cache: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), cache
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)  # ids that end a word
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        spec = json.loads(self.tokenizer.to_str())
        normal, split, model = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}, spec["model"]
        self.by_chunks = normal.get("normalizers") == NORMAL and (split.get("pretokenizers") or [None])[0] == SPLIT and model.get("end_of_word_suffix") == "</w>" and not spec["post_processor"]
        if self.by_chunks:  # words of these letters are normal but for their case, and apart: they take neither the normalizer nor the split
            apart = {"type": "CharDelimiterSplit", "delimiter": " "}
            bare = {"normalizer": None, "added_tokens": [], "pre_tokenizer": split | {"pretokenizers": [apart, *split["pretokenizers"][1:]]}, "model": model | {"vocab": {}, "merges": []}}
            self.plain = Tokenizer.from_str(json.dumps(spec | bare))
            self.plain.model = self.tokenizer.model  # the same, not a copy
        self.known = (pa.array([], pa.string()), np.zeros(0, self.dtype), np.zeros(0, np.int64))  # words, their ids, how many of each

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def _words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words of letters, and how many each has."""
        known, ids, sizes = self.known
        at = pc.index_in(words, value_set=known)
        if at.null_count:  # each word's ids end at the next id that ends a word
            fresh = words.filter(at.is_null())
            parts = (" ".join(fresh[i : i + CALL].to_pylist()).lower() for i in range(0, len(fresh), CALL))
            found = np.concatenate([np.array(self.plain.encode_batch_fast([p], add_special_tokens=False)[0].ids, self.dtype) for p in parts])
            ends = np.flatnonzero(self.ends[found]) + 1
            if len(ends) != at.null_count or ends[-1] != len(found):
                raise ValueError("the vocabulary does not mark the ends of words")
            ids, sizes = np.concatenate([ids, found]), np.concatenate([sizes, np.diff(ends, prepend=0)])
        place = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[at.is_null().to_numpy(zero_copy_only=False)] = len(known) + np.arange(at.null_count)
        ids, sizes = gathered(ids, sizes, place)
        self.known = (words[: self.most], ids[: sizes[: self.most].sum()], sizes[: self.most])
        return ids, sizes

    def _chunks(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, and how many each has: those of a word of letters, then its punctuation; of others as a whole."""
        words = pc.ascii_rtrim(chunks, _MARKS)
        plain = pc.match_substring_regex(words, f"^[{_LATIN}]+\\z")
        words, tails = words.filter(plain).dictionary_encode(), pc.utf8_ltrim(chunks.filter(plain), _LATIN).dictionary_encode()
        whole = self._ids([*tails.dictionary.cast(pa.binary()).to_pylist(), *chunks.filter(pc.invert(plain)).cast(pa.binary()).to_pylist(), b""])
        ids, sizes = self._words(words.dictionary)
        n, is_plain = len(sizes), plain.to_numpy(zero_copy_only=False)
        sizes = np.concatenate([sizes, [len(x) for x in whole]])
        parts = np.full((len(chunks), 2), len(sizes) - 1)  # the empty one
        parts[is_plain, 0], parts[is_plain, 1] = words.indices.to_numpy(), n + tails.indices.to_numpy()
        parts[~is_plain, 0] = n + len(tails.dictionary) + np.arange(len(chunks) - len(words))
        ids, sizes = gathered(np.concatenate([ids, *whole]), sizes, parts.ravel())
        return ids, sizes.reshape(-1, 2).sum(1)

    def encode(self, text: bytes) -> np.ndarray:
        """Ids of a text, as unsigned little-endian integers. Empty for an empty text."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text. The chunks of some `BLOCK` bytes of texts are told apart together."""
        if not self.by_chunks:
            for text in texts:
                yield self._ids([text])[0]
            return
        held: list[bytes] = []
        size = 0
        for text in texts:
            held.append(text if b"<|" in text else text.lower())  # the special tokens' names are case-sensitive
            size += len(text)
            if size >= BLOCK:
                yield from self._looked_up(held)
                held, size = [], 0
        if held:
            yield from self._looked_up(held)

    def _looked_up(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        coded = split.values.dictionary_encode()
        ids, sizes = gathered(*self._chunks(coded.dictionary), coded.indices.to_numpy())
        cuts = np.concatenate([[0], np.cumsum(sizes)])[split.offsets.to_numpy()].tolist()
        yield from (ids[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True))


@lru_cache(1)
def encoder(path: str) -> ChunkEncoder:
    """The worker process's encoder: its cache outlives a task."""
    return ChunkEncoder(path)
