"""Batch encoding with the public tokenizer files, one encode call per distinct segment of a batch.

Both vocabularies split a text by a left-to-right pattern before anything else: at white space, and where a run of
letters ends. A text's ids are therefore those of its segments in a row. Segments met before come from a bounded cache;
texts with a character on which Python and the tokenizer could disagree (rare white space, special-token strings, a
capital whose lower case isn't one character) are encoded whole by the library. The rules of a file are compared with the two
below when it is loaded; with any other rules every text is encoded by the library.
"""

from __future__ import annotations

import json
import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import at_work, remembers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters that only one of the two counts as white space, white space beyond ASCII.
_WHOLE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The one character whose lower case is two, the second a mark that joins what follows.
_TWO_LOWER = "\u0130"
# The rules (normalizer, split) that the segments below follow, by ``spaced``.
_RULES = {
    True: (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    False: (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    ),
}
_LETTERS = "[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ]+(?=[\t-\r -@\\[-`{-~]|$)"
#: A run of Latin letters that an ASCII character or the end closes, else all up to the next white space.
_SPACED = re.compile(rf" ?{_LETTERS}| ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
_DROPPED = re.compile(rf"{_LETTERS}|[^ \t-\r]+")
_RUN = re.compile(" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ]+")


def _byte_characters() -> str:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes themselves, others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in printable else next(others)) for b in range(256))


_BYTES = _byte_characters()
#: Entries after which a cache starts anew: a bound on memory, not on what is encoded.
CACHE_ENTRIES = 400_000


#: One of these at the end of a word, after a letter or digit, is a piece of its own in both vocabularies.
_TAILS = ".,;:!?"
_STEM_END = r"[A-Za-z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]$"


def gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the values of the entries ``index`` in a row, where each entry ends, with a leading 0)."""
    sizes = size[index]
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    if ends[-1] + len(flat) < 1 << 31:  # half the memory traffic
        at = np.repeat((first[index] - ends[:-1]).astype(np.int32), sizes)
        at += np.arange(len(at), dtype=np.int32)
    else:
        at = np.repeat(first[index] - ends[:-1], sizes) + np.arange(ends[-1])
    return flat[at], ends


class BatchEncoder:
    """encode(texts) -> (all ids as uint32, ids per text). ``spaced``: white space and capitals have ids of their own.

    Words of a batch are split off and numbered by Arrow; Python sees each distinct word once. A word met for the first
    time is taken apart into pieces, and the library encodes the pieces that are new.
    """

    def __init__(self, path: str, spaced: bool, cache_entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.spaced = spaced
        self.split = (_SPACED if spaced else _DROPPED).findall
        self.cache_entries = cache_entries
        self.short: dict[str, list[int]] = {}  # of pieces that aren't runs of letters
        self.tokenize = self.library.model.tokenize
        file = json.loads(self.library.to_str())
        self.by_segments = (file["normalizer"], file["pre_tokenizer"]) == _RULES[spaced] and not file["model"]["dropout"]
        self.whole = "|".join([_WHOLE, *([] if spaced else [_TWO_LOWER]), *(re.escape(t["content"]) for t in file["added_tokens"])])
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.first, self.size = np.empty(1 << 14, np.int32), np.empty(1 << 14, np.int32)

    def _room(self, entries: int, ids: int) -> None:
        while self.used + ids > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.known) + entries > len(self.first):
            self.first = np.concatenate([self.first, np.empty_like(self.first)])
            self.size = np.concatenate([self.size, np.empty_like(self.size)])

    def _piece(self, piece: str) -> list[int]:
        """A run of Latin letters is one unit to the model, which is asked at once; all else goes the whole way."""
        if _RUN.fullmatch(piece) and (self.spaced or piece.islower()):
            if piece.isascii():
                unit = piece if piece[0] != " " else f"\u0120{piece[1:]}"  # letters stand for themselves, U+0120 for a space
            else:
                unit = piece.encode().decode("latin-1").translate(_BYTES)
            return [t.id for t in self.tokenize(unit)]
        ids = self.short.get(piece)
        if ids is None:
            ids = self.library.encode(piece, add_special_tokens=False).ids
            if len(piece) <= 4 and len(self.short) < 50_000:
                self.short[piece] = ids
        return ids

    def _learn(self, words: list[str]) -> None:
        split, piece = self.split, self._piece
        flat: list[int] = []
        ends = []
        for word in words:
            if word.isalpha() or word[1:].isalpha():
                flat += piece(word)
            else:
                for p in split(word):
                    flat += piece(p)
            ends.append(len(flat))
        sizes = np.diff(np.array(ends, np.int64), prepend=0)
        k = len(self.known)
        self._room(len(words), len(flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.first[k : k + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.size[k : k + len(words)] = sizes
        self.known.update(zip(words, range(k, k + len(words))))
        self.used += len(flat)

    def _numbers(self, words: list[str]) -> np.ndarray:
        index = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(index < 0)):
            own = [words[i] for i in new.tolist()]
            self._learn(list(dict.fromkeys(own)))
            index[new] = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))
        return index

    def _ids(self, index: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the words numbered ``index``; text i has the words upto[i] to upto[i + 1]."""
        ids, ends = gather(self.flat, self.first, self.size, index)
        return ids, np.diff(ends[upto])

    def _pairs(self, words: pa.Array, spaced: bool) -> np.ndarray:
        """Two entries per distinct word: its stem and, if it ends so, one of ``_TAILS``, else the empty one."""
        if not len(words):
            return np.empty(0, np.int64)
        stems = pc.ascii_rtrim(words, _TAILS)
        one = pc.subtract(pc.binary_length(words), pc.binary_length(stems)).to_numpy() == 1
        one &= pc.match_substring_regex(stems, _STEM_END).to_numpy(zero_copy_only=False)
        apart = pc.if_else(pa.array(one), stems, words).dictionary_encode()
        names = apart.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = self._numbers([f" {w}" for w in names] if spaced else names)
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset + 1 : words.offset + len(words) + 1]
        last = np.frombuffer(words.buffers()[2] or b"\0", np.uint8)[np.maximum(ends, 1) - 1]
        tail_of = np.full(256, 0, np.int64)
        tail_of[list(_TAILS.encode())] = self._numbers(list(_TAILS))
        pairs = np.empty(2 * len(words), np.int64)
        pairs[0::2] = numbers[apart.indices.to_numpy()]
        pairs[1::2] = np.where(one, tail_of[last], self._numbers([""])[0])
        return pairs

    def _by_arrow(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number per text."""
        if self.spaced:  # a line end is a word of its own, without a space before it or after it
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        else:
            lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        upto = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.slice(upto[0], upto[-1] - upto[0])
        upto -= upto[0]
        coded = flat.dictionary_encode()
        at, words = coded.indices.to_numpy(), coded.dictionary
        pairs = self._pairs(words, self.spaced)
        if self.spaced:
            bare = np.zeros(len(at) + 1, bool)
            bare[upto[:-1]] = True
            lines = np.flatnonzero(at == pc.index(words, "\n").as_py())
            bare[lines] = bare[lines + 1] = True
            bare = np.flatnonzero(bare[:-1])
            opening = flat.take(pa.array(bare)).dictionary_encode()
            pairs = np.concatenate([pairs, self._pairs(opening.dictionary, False)])
            at = at.astype(np.int64)
            at[bare] = len(words) + opening.indices.to_numpy()
        own, ends = gather(self.flat, self.first, self.size, pairs)
        starts = ends[::2]
        ids, ends = gather(own, starts[:-1], np.diff(starts), at)
        return ids, np.diff(ends[upto])

    def _split_by_python(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [self.split(t) for t in texts]
        return self._numbers([w for own in lists for w in own]), np.cumsum([0, *map(len, lists)])

    def _way(self, texts: pa.Array) -> np.ndarray:
        """0: split by Arrow, 1: by the pattern in Python, 2: the library takes the whole text."""
        way = np.zeros(len(texts), np.int8)
        if not self.by_segments:
            return way + 2
        if self.spaced:  # white space beside white space, or at an end of the text
            way[pc.match_substring_regex(texts, r"^[\t-\r ]|[\t-\r ]$|[\t-\r ][\t-\r ]").to_numpy(zero_copy_only=False)] = 1
        else:
            way[pc.match_substring_regex(texts, r"[^\x{0}-\x{12f}\x{131}-\x{24f}]").to_numpy(zero_copy_only=False)] = 1
        way[pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)] = 2
        return way

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        texts = texts.fill_null("")
        if len(self.known) > self.cache_entries:
            self._clear()
        way = self._way(texts)
        if not way.any():
            return self._by_arrow(texts) if len(texts) else (np.empty(0, np.uint32), np.empty(0, np.int64))
        parts: list = [None] * len(texts)
        for kind in (0, 1, 2):
            if not len(own := np.flatnonzero(way == kind)):
                continue
            mine = texts.take(pa.array(own))
            if kind == 2:
                for i, x in zip(own.tolist(), self.library.encode_batch_fast(mine.to_pylist(), add_special_tokens=False)):
                    parts[i] = np.array(x.ids, np.uint32)
            else:
                ids, lengths = self._ids(*self._split_by_python(mine.to_pylist())) if kind else self._by_arrow(mine)
                for i, x in zip(own.tolist(), np.split(ids, np.cumsum(lengths)[:-1])):
                    parts[i] = x
        return np.concatenate(parts).astype(np.uint32, copy=False), np.array([len(x) for x in parts], np.int64)


_encoders: dict[tuple[str, bool], BatchEncoder] = {}


def encoder(path: str, spaced: bool) -> BatchEncoder:
    """The worker's encoder for a file; kept between the tasks of a worker."""
    at_work(f"ids of {path}")
    if (path, spaced) not in _encoders:
        e = _encoders[path, spaced] = BatchEncoder(path, spaced)
        remembers(f"ids of {path}", e._clear)
    return _encoders[path, spaced]
