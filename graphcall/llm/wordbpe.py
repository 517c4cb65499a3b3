"""Whole texts to token ids with a word-level BPE file of the tokenizers library, with word caches."""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What the file must say for texts to be cut at white space: fixed values of the format.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORD_END = "</w>"


class Lists:
    """Lists of ids by key, in one array."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def find(self, keys: list[str]) -> np.ndarray:
        """The number of each key, -1 if it has none."""
        return np.fromiter(map(self.known.get, keys, itertools.repeat(-1)), np.int64, len(keys))

    def add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(keys, range(len(self.offsets) - 1, len(self.offsets) - 1 + len(keys)), strict=True))
        self.ids, self.offsets = np.concatenate([self.ids, ids]), np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])

    def join(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers one behind the other, and the size of each."""
        starts = self.offsets[numbers]
        sizes = self.offsets[numbers + 1] - starts
        ends = np.cumsum(sizes)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)], sizes


class WordEncoder:
    """Encodes like ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    Where the file's pre-tokenizer never matches white space and its normalizer acts on each character,
    the ids of a text are those of its words in order. A batch's distinct words are looked up in
    a cache. New ones are cut into pre-tokens together, and those of these that are new go through the
    library's model in one call. Words outside ASCII and the Latin-1 letters, and very long ones,
    go through the whole library, and so do all texts if the file is of another form.
    """

    #: Words, by lines, of at most 64 of these characters: they are in normal form NFC, and str.lower() maps each to one character.
    _PLAIN = re.compile(r"^[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]{1,64}$", re.M)
    #: The file's pre-tokens on such words, and what stands between words.
    _PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|\n|[^a-zß-öø-ÿ0-9\n]+")

    def __init__(self, path: str, cache_words: int = 450_000, cache_pieces: int = 350_000, longest: int = 64):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_words, self.cache_pieces, self.longest = cache_words, cache_pieces, longest
        self.by_words = self._cut_at_white_space(json.loads(self.tokenizer.to_str()))
        self.words, self.pieces = Lists(), Lists()
        if self.by_words:
            special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
            self.marked = re.compile("|".join(special) or "(?!)")
            letters = {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c != "÷"}
            self.table = str.maketrans(letters)
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[k for t, k in vocabulary.items() if t.endswith(WORD_END)]] = True

    @staticmethod
    def _cut_at_white_space(file: dict) -> bool:
        pre, model = file["pre_tokenizer"], file["model"]
        steps = pre.get("pretokenizers", []) if pre else []
        return (
            file["normalizer"] == {"type": "Sequence", "normalizers": NORMALIZERS} and file["post_processor"] is None and len(steps) == 2
            and steps[0] == {"type": "Split", "pattern": {"Regex": PRE_TOKENS}, "behavior": "Removed", "invert": True}
            and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
            and model["type"] == "BPE" and model["end_of_word_suffix"] == WORD_END and not model["dropout"] and not model["continuing_subword_prefix"]
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(c.isspace() for c in t["content"]) for t in file["added_tokens"])
        )

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _add_pieces(self, pieces: list[str]) -> None:
        """Every pre-token ends with the one token of it that ends a word, so the ids of many are cut there."""
        text = " ".join(p if p.isascii() else p.translate(self.table) for p in pieces)
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(pieces) or cuts[-1] != len(ids):
            raise ValueError("the vocabulary doesn't end each pre-token with one token")
        self.pieces.add(pieces, ids, np.diff(cuts, prepend=0))

    def _add_words(self, words: list[str]) -> None:
        plain = self._PLAIN.findall("\n".join(words))
        if any(map(self.marked.search, plain)):  # a special token inside a word is one token
            plain = [w for w in plain if not self.marked.search(w)]
        if plain:
            pieces = self._PIECE.findall("\n".join(plain).lower())
            if not self.pieces.known or len(self.pieces.known) >= self.cache_pieces:
                self.pieces = Lists()
                self.pieces.add(["\n"], np.zeros(0, np.uint32), np.zeros(1, np.int64))
            new = list(set(pieces).difference(self.pieces.known))
            for k in range(0, len(new), 20_000):  # what the library returns for each call takes memory
                self._add_pieces(new[k : k + 20_000])
            numbers = self.pieces.find(pieces)
            ids, sizes = self.pieces.join(numbers)
            ends = np.flatnonzero(np.append(numbers, 0) == 0)  # the piece of number 0 ends a word, as the list's end does
            total = np.concatenate([[0], np.cumsum(sizes), [len(ids)]])
            self.words.add(plain, ids, np.diff(total[ends], prepend=0))
        if len(plain) < len(words):
            # Long ones come last, so that they can be forgotten.
            rest = sorted(set(words).difference(plain), key=len)
            found = [self._whole(w) for w in rest]
            self.words.add(rest, np.array([k for ids in found for k in ids], np.uint32), np.array([len(ids) for ids in found], np.int64))

    def _forget_long(self) -> None:
        words = self.words
        while words.known and len(next(reversed(words.known))) > self.longest:
            words.known.popitem()
        kept = len(words.known)
        words.offsets = words.offsets[: kept + 1]
        words.ids = words.ids[: words.offsets[-1]]

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one behind the other, each with ``end_id`` if given, and where each begins and the last ends.

        Null and empty texts have no ids of their own.
        """
        if not self.by_words:
            own = [self._whole(t or "") for t in texts.to_pylist()]
            ids, counts = np.array([k for x in own for k in x], np.uint32), np.array([len(x) for x in own], np.int64)
        else:
            split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
            coded = split.flatten().dictionary_encode()
            words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            if len(self.words.known) >= self.cache_words:
                self.words = Lists()
            numbers = self.words.find(words)
            lost = np.flatnonzero(numbers < 0)
            if len(lost):
                new = [words[k] for k in lost.tolist()]
                self._add_words(new)
                numbers[lost] = self.words.find(new)
            ids, sizes = self.words.join(numbers[coded.indices.to_numpy()])
            if len(lost):
                self._forget_long()
            places = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)])
            counts = np.diff(np.concatenate([[0], np.cumsum(sizes)])[places])
        if end_id is not None:
            whole = np.full(len(ids) + len(counts), end_id, np.uint32)
            whole[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
            ids, counts = whole, counts + 1
        return ids, np.concatenate([[0], np.cumsum(counts)])

    def __call__(self, text: str | None) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers."""
        return self.encode(pa.array([text], pa.string()))[0].astype("<u4", copy=False).tobytes()


_made: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, so that its caches last over tasks."""
    if path not in _made:
        _made[path] = WordEncoder(path)
    return _made[path]


def encoded(encode: WordEncoder, texts: pa.Array, end_id: int, most_bytes: int = 2_000_000) -> Iterator[tuple[int, list[memoryview]]]:
    """Place of the first text and the ids (little-endian u32) of each, for runs of neighbouring texts of bounded size but for a single text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(before, before[at] + most_bytes, side="right")) - 1)
        ids, places = encode.encode(texts.slice(at, end - at), end_id)
        raw, cuts = memoryview(ids.astype("<u4", copy=False)).cast("B"), (4 * places).tolist()
        yield at, [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        at = end
