"""64-bit hashes of word n-grams, by arrays: each distinct word is hashed once, each n-gram is a few array operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType

#: Distinct words whose hashes one worker keeps.
MAX_WORDS = 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = WordHashes()


def rolling(words: list[str], n: int) -> np.ndarray:
    """Hashes of the n-grams in order; empty for fewer words."""
    return rolled(np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)), n)


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """``rolling`` over the hashes of the words."""
    size = len(h) - n + 1
    if size < 1:
        return np.zeros(0, np.uint64)
    total = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            total = total * _STEP + h[k : k + size]
        total ^= total >> np.uint64(31)
        total *= _MIX
        total ^= total >> np.uint64(29)
    return total


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
    """The hashes of all words of the texts, one after another, and the number of words of each text; null texts have none."""
    parts = []
    for t in texts:  # the words of one text at a time
        words = t.split() if t else []
        parts.append(np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), list(map(len, parts))


def gram_hashes(n: int):
    """An Arrow function: text to the distinct hashes of its n-grams of words; null texts and shorter ones have none."""

    @F.arrow_udf(ArrayType(LongType()))
    def hashes(text: pa.Array) -> pa.Array:
        parts = [np.unique(rolling(t.split(), n)).view(np.int64) if t else np.zeros(0, np.int64) for t in text.to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))

    return hashes


def gram_hits(n: int, sought):
    """An Arrow function: whether a text has one of the sought n-grams, a broadcast sorted array of their hashes; null texts have none."""

    @F.arrow_udf(BooleanType())
    def hits(text: pa.Array) -> pa.Array:
        known = sought.value
        if not len(known):
            return pa.array(np.zeros(len(text), bool))
        h, sizes = word_hashes(text.to_pylist())
        flat, row = rolled(h, n).view(np.int64), np.repeat(np.arange(len(sizes)), sizes)
        # few n-grams pass the cells, so few are searched
        cells = np.zeros(1 << min(22, len(known).bit_length() + 4), bool)
        cells[known & (len(cells) - 1)] = True
        found = cells[flat & (len(cells) - 1)]
        some = flat[found]
        found[found] = known[np.minimum(np.searchsorted(known, some), len(known) - 1)] == some
        begin, end = row[: len(flat)], row[n - 1 :]
        return pa.array(np.bincount(begin[found & (begin == end)], minlength=len(sizes)) > 0)

    return hits


def gram_candidates(n: int, bitmap):
    """An Arrow function: the n-grams of a text whose place in a broadcast bitmap is set (a filter of one hash)."""

    @F.arrow_udf(ArrayType(LongType()))
    def hits(text: pa.Array) -> pa.Array:
        words = bitmap.value
        out = []
        for t in text.to_pylist():
            h = np.unique(rolling(t.split(), n)) if t else np.zeros(0, np.uint64)
            place = h % np.uint64(len(words) * 64)
            out.append(h[(words[(place // np.uint64(64)).astype(np.int64)] >> (place % np.uint64(64))) & np.uint64(1) == 1].view(np.int64))
        return pa.array(out, pa.list_(pa.int64()))

    return hits
