"""Exact byte-level BPE by dynamic programming over prefixes.

Every prefix of a pre-token has exactly one valid encoding, hence exactly one
last token.  For each prefix end the suffix automaton (Aho-Corasick over the
vocabulary) lists the tokens that end there; the one whose predecessor - the
last token of the prefix before it - is compatible with it is stored, and the
ids are read off by following the stored tokens backwards.  The cost is linear
in the length of the pre-token times the number of tokens that end at a place,
however long the pre-token is.

Two adjacent tokens are compatible when merging in rank order never merges
across the seam between them.

Only the pre-tokens differ between texts, and few of them are new, so the ids
of each distinct pre-token are kept (bounded, see ``MAX_CACHED``).
"""

from __future__ import annotations

import json
import re
from itertools import chain

import ahocorasick
import numpy as np
import regex

#: The published pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same for text of ASCII characters only, where the classes are plain ranges.
ASCII_PATTERN = PATTERN.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace("A-Za-z+", "[A-Za-z]+").replace("0-9+", "[0-9]+")

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"

#: Distinct pre-tokens whose ids one worker keeps; the cache is emptied when it is full.
MAX_CACHED = 400_000
#: Longer pre-tokens (runs without a boundary) are encoded but not kept.
MAX_CACHED_CHARS = 64

_ASCII = re.compile(ASCII_PATTERN, re.ASCII)
_ANY = regex.compile(PATTERN)


def byte_alphabet() -> dict[str, int]:
    """The printable character that vocabulary files write for each byte, and its byte.

    Printable Latin-1 bytes stand for themselves, the others follow from 256 on.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def pretokens(text: str) -> list[str]:
    """The pieces of ``text`` that are encoded one by one; joined, they are ``text``."""
    return (_ASCII if text.isascii() else _ANY).findall(text)


class PrefixEncoder(dict):
    """Ids of pre-tokens; looking up a new one encodes it.

    ``encoder[pretoken]`` is a tuple of ids.  A lone surrogate cannot occur in
    text that came through Arrow, so UTF-8 always exists.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        alphabet = byte_alphabet()
        plain = str.maketrans({c: chr(b) for c, b in alphabet.items()})
        vocab: dict[str, int] = model["vocab"]
        self.length = [0] * (max(vocab.values()) + 1)
        automaton = ahocorasick.Automaton()
        for shown, i in vocab.items():
            raw = shown.translate(plain)
            self.length[i] = len(raw)
            automaton.add_word(raw, i)
        automaton.make_automaton()
        self.automaton = automaton
        self.base = {chr(b): vocab[c] for c, b in alphabet.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair, whole = (vocab[left], vocab[right]), vocab[left + right]
            self.merged[pair] = whole
            self.halves.setdefault(whole, pair)
        self._spines: dict[tuple[int, int], list[int]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}

    def _spine(self, token: int, side: int) -> list[int]:
        """From the outermost byte on that side (0 left, 1 right) up to ``token`` itself."""
        key = (token, side)
        if key not in self._spines:
            up = [token]
            while up[-1] in self.halves:
                up.append(self.halves[up[-1]][side])
            self._spines[key] = up[::-1]
        return self._spines[key]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging in rank order leaves ``left`` and ``right`` apart.

        Both grow towards the seam, in rank order.  They are joined iff at some
        moment the two parts at the seam have a merge that comes before the next
        growth of either; of equal merges the leftmost is done first.
        """
        key = (left, right)
        known = self._pairs.get(key)
        if known is not None:
            return known
        a, b = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        never = len(self.length)
        good = True
        while True:
            grow_a = a[i + 1] if i + 1 < len(a) else never
            grow_b = b[j + 1] if j + 1 < len(b) else never
            joint = self.merged.get((a[i], b[j]), never)
            if joint < grow_a and joint <= grow_b and joint != never:
                good = False
                break
            if grow_a == grow_b == never:
                break
            if grow_a <= grow_b:
                i += 1
            else:
                j += 1
        if len(self._pairs) > 2_000_000:
            self._pairs.clear()
        self._pairs[key] = good
        return good

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8").decode("latin-1")
        n, length, compatible = len(raw), self.length, self.compatible
        last = [-1] * (n + 1)
        for end, token in self.automaton.iter(raw):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length[token]
            if start == 0 or (last[start] >= 0 and compatible(last[start], token)):
                last[end] = token
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        return tuple(ids[::-1])

    def cuts(self, piece: str) -> tuple[list[int], list[int]]:
        """Places between the characters of a pre-token that are also places between its tokens: characters and tokens before each.

        The tokens on either side are those of the whole, as neighbours stay compatible.  The end is the last place.
        """
        ends = [0]
        for c in piece:
            ends.append(ends[-1] + len(c.encode("utf-8")))
        at = {e: k for k, e in enumerate(ends)}
        chars, tokens, place = [], [], 0
        for n, i in enumerate(self.encode_piece(piece), 1):
            place += self.length[i]
            if place in at:
                chars.append(at[place])
                tokens.append(n)
        return chars, tokens

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encode_piece(piece)
        if len(piece) <= MAX_CACHED_CHARS:
            if len(self) >= MAX_CACHED:
                self.clear()
            self[piece] = ids
        return ids

    def ids(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, pretokens(text))))


class PieceCounts(dict):
    """Number of ids of each pre-token, over the cache of an encoder."""

    def __init__(self, encoder: PrefixEncoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> int:
        n = len(self.encoder.encode_piece(piece))
        if len(piece) <= MAX_CACHED_CHARS:
            if len(self) >= MAX_CACHED:
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, pretokens(text)))

    def lengths(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))


_ENCODERS: dict[str, PrefixEncoder] = {}
_COUNTS: dict[str, PieceCounts] = {}


def tokenizer_path(name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> str:
    return f"{folder}/{name}.json"


def encoder(path: str) -> PrefixEncoder:
    """The encoder of this worker; the vocabulary is read once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(path)
    return _ENCODERS[path]


def piece_counts(path: str) -> PieceCounts:
    if path not in _COUNTS:
        _COUNTS[path] = PieceCounts(encoder(path))
    return _COUNTS[path]
