"""Finding passages of short test items in texts: pigeonhole pieces, then Myers' bit-parallel distance.

An item of L words is a case where a text repeats ``RUN`` consecutive words of
it, or ``SHARE`` of its words in its order within one passage.  The errors
allowed are therefore counted before anything is compared:

* a run of ``RUN`` words holds every three consecutive words of it, wherever it
  begins - so every three consecutive words of the item are a piece;
* of L words up to k = L - ceil(SHARE * L) may be changed, dropped or added and a line thrown
  in; cut into k + 2 pieces, one of them is intact - pieces of two words are added where the
  cut makes any.

Slips are no errors: a word of the text stands for every item word that it equals but
for a slip, and a piece is hit by any choice of these.  A word that stands in an item as it
is, is no slip of another one: names of two items may differ by a letter.

Hits name the candidates.  A candidate is dropped only if the text lacks the words that
either condition needs (an upper bound, so no case is lost).  The rest are verified over
all words that a passage around any of the hits can reach:

* consecutive runs by shifted masks;
* Myers' bit-parallel distance between the item and the text, words for letters, at most k;
* with a line thrown in after word i, the distance of the item's first i words before the line and
  of the others after it, added up over every i and every line of at most ``thrown_in`` words: Myers' columns
  give the distances of all beginnings at every place, those of the reversed words of all endings;
* words kept in order where a changed word became several (at most k more words), by the indel form of the same
  recurrence from every place at which such a passage can begin.

Words that differ by a slip of one letter (Myers' bit-parallel distance of one, or two
letters swapped) count as equal.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil

import numpy as np

from lontar.llm.normal import plain_words

RUN = 12
SHARE = 0.7
LEAST_WORDS = 8
#: Words of a thrown-in line at most (a parameter of the index).
THROWN_IN = 128
#: Words shorter than this must be equal.
SLIP_LETTERS = 4


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance by Myers' bit vectors."""
    if not a:
        return len(b)
    mask: dict[str, int] = {}
    for i, c in enumerate(a):
        mask[c] = mask.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for c in b:
        eq = mask.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        hp, hm = minus | ~(xh | plus) & full, plus & xh
        score += bool(hp & top) - bool(hm & top)
        hp, hm = (hp << 1 | 1) & full, hm << 1 & full
        plus, minus = hm | ~(xv | hp) & full, hp & xv
    return score


def slip(a: str, b: str) -> bool:
    """Whether two words are equal but for one letter, or for two neighbours swapped.

    Of numbers only swapped digits count: another digit makes another number.
    """
    if a == b:
        return True
    if min(len(a), len(b)) < SLIP_LETTERS or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        if len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]:
            return True
    return not (a.isdigit() or b.isdigit()) and edit_distance(a, b) <= 1


def columns(rows: list[int], size: int) -> tuple[list[int], list[int], list[int]]:
    """Myers' recurrence of an item of ``size`` words over a text, begun anywhere: the vertical steps up and down of every column and the distances at the item's end.

    ``rows`` has for each word of the text the item's words that it equals, as bits.
    """
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    ups, downs, scores = [plus], [0], [size]
    for eq in rows:
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        hp, hm = minus | ~(xh | plus) & full, plus & xh
        score += bool(hp & top) - bool(hm & top)
        hp, hm = hp << 1 & full, hm << 1 & full
        plus, minus = hm | ~(xv | hp) & full, hp & xv
        ups.append(plus)
        downs.append(minus)
        scores.append(score)
    return ups, downs, scores


def distances(ups: list[int], downs: list[int], size: int) -> np.ndarray:
    """The distance of every beginning of the item (0 to ``size`` words) at every place, from the vertical steps."""
    wide = -(-size // 8)

    def bits(steps: list[int]) -> np.ndarray:
        raw = np.frombuffer(b"".join(x.to_bytes(wide, "little") for x in steps), np.uint8)
        return np.unpackbits(raw.reshape(-1, wide), axis=1, bitorder="little")[:, :size].astype(np.int16)

    step = bits(ups) - bits(downs)
    return np.concatenate([np.zeros((len(step), 1), np.int16), step.cumsum(1, dtype=np.int16)], axis=1)


def lowest(values: np.ndarray, back: int) -> np.ndarray:
    """The minimum of each row of ``values`` and the ``back`` rows before it."""
    out, wide = values.copy(), 1
    while wide <= back:
        step = min(wide, back + 1 - wide)
        out[step:] = np.minimum(out[step:], out[:-step]) if step < len(out) else out[step:]
        wide += step
    return out


def reversed_bits(mask: int, size: int) -> int:
    return int(f"{mask:0{size}b}"[::-1], 2)


def deletions(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))} | {word}


@dataclass
class PassageIndex:
    """Pieces and words of a block of items."""

    vocab: dict[str, int] = field(default_factory=dict)
    items: list[list[int]] = field(default_factory=list)
    ids: list[list[int]] = field(default_factory=list)
    near: dict[str, list[str]] = field(default_factory=dict)
    codes: dict[int, np.ndarray] = field(default_factory=dict)
    starts: dict[int, np.ndarray] = field(default_factory=dict)
    places: dict[int, np.ndarray] = field(default_factory=dict)
    matrix: np.ndarray | None = None
    sizes: np.ndarray | None = None
    slips: dict[str, tuple[int, ...]] = field(default_factory=dict)
    masks: dict[int, dict[int, int]] = field(default_factory=dict)
    thrown_in: int = THROWN_IN

    @classmethod
    def build(cls, rows: list[tuple[int, str | None]], thrown_in: int = THROWN_IN) -> "PassageIndex":
        """``rows``: item id and text; equal items (after normalisation) are kept once with all their ids."""
        self = cls(thrown_in=thrown_in)
        known: dict[tuple[str, ...], int] = {}
        for item, text in rows:
            words = tuple(plain_words(text or ""))
            if len(words) < LEAST_WORDS:
                continue
            if words in known:
                self.ids[known[words]].append(item)
                continue
            known[words] = len(self.items)
            self.ids.append([item])
            self.items.append([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words])
        for w in self.vocab:
            if len(w) >= SLIP_LETTERS:
                for x in deletions(w):
                    self.near.setdefault(x, []).append(w)
        pieces: dict[int, dict[int, list[tuple[int, int]]]] = {2: {}, 3: {}}
        for n, words in enumerate(self.items):
            size = len(words)
            for i in range(size - 2):
                pieces[3].setdefault(self._code(words[i : i + 3]), []).append((n, i))
            parts = size - ceil(SHARE * size - 1e-9) + 2
            cuts = [size * p // parts for p in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:]):
                if b - a == 2:
                    pieces[2].setdefault(self._code(words[a:b]), []).append((n, a))
        for width, found in pieces.items():
            keys = sorted(found)
            self.codes[width] = np.array(keys, np.int64)
            self.starts[width] = np.concatenate([[0], np.cumsum([len(found[k]) for k in keys])]).astype(np.int64)
            self.places[width] = np.array([p for k in keys for p in found[k]], np.int64).reshape(-1, 2)
        widest = max(map(len, self.items), default=0)
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        self.matrix = np.zeros((len(self.items), widest), np.int64)
        for n, words in enumerate(self.items):
            self.matrix[n, : len(words)] = words
        return self

    def _code(self, ids: list[int]) -> int:
        code = 0
        for i in ids:
            code = code << 20 | i
        return code

    def classes(self, word: str) -> tuple[int, ...]:
        """The item words that a word of a text equals, but for a slip; a word of an item is itself alone."""
        got = self.slips.get(word)
        if got is None:
            found = {self.vocab[word]} if word in self.vocab else set()
            if not found and len(word) >= SLIP_LETTERS:
                close = {w for x in deletions(word) for w in self.near.get(x, ())}
                found |= {self.vocab[w] for w in close if slip(word, w)}
            if len(self.slips) > 500_000:
                self.slips.clear()
            self.slips[word] = got = tuple(sorted(found))
        return got

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(row of the text, number of the item, longest run, words kept in order) of every case."""
        if not self.items:
            return []
        lists = [plain_words(t) if t else [] for t in texts]
        sizes = np.array([len(w) for w in lists])
        total = int(sizes.sum())
        known: dict[str, int] = {}
        flat = np.fromiter((known.setdefault(w, len(known)) for ws in lists for w in ws), np.int64, total)
        classes = [self.classes(w) for w in known]
        number = np.array([len(c) for c in classes], np.int64)
        begin = number.cumsum() - number
        choice = np.array([x for c in classes for x in c], np.int64)
        first = np.concatenate([[0], sizes.cumsum()])
        row = np.repeat(np.arange(len(lists)), sizes)
        some = number[flat] > 0 if total else np.zeros(0, bool)
        hits = []
        for width in (2, 3):
            if total < width or not len(self.codes[width]):
                continue
            good = row[: total - width + 1] == row[width - 1 :]
            for k in range(width):
                good &= some[k : total - width + 1 + k]
            at = np.flatnonzero(good)
            code = np.zeros(len(at), np.int64)
            for k in range(width):
                word = flat[at + k]
                count = number[word]
                offset = np.arange(count.sum()) - np.repeat(count.cumsum() - count, count)
                code = np.repeat(code, count) << 20 | choice[np.repeat(begin[word], count) + offset]
                at = np.repeat(at, count)
            where = np.searchsorted(self.codes[width], code)
            where[where == len(self.codes[width])] = 0
            same = self.codes[width][where] == code
            at, where = at[same], where[same]
            count = self.starts[width][where + 1] - self.starts[width][where]
            many = np.repeat(np.arange(len(at)), count)
            offset = np.arange(len(many)) - np.repeat(count.cumsum() - count, count)
            place = self.places[width][self.starts[width][where][many] + offset]
            hits.append(np.column_stack([row[at[many]], place[:, 0], at[many] - first[row[at[many]]], place[:, 1]]))
        found = np.concatenate(hits) if hits else np.zeros((0, 4), np.int64)
        out: list[tuple[int, int, int, int]] = []
        if not len(found):
            return out
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        rows, begin = np.unique(found[:, 0], return_index=True)
        for r, a, b in zip(rows, begin, np.append(begin[1:], len(found))):
            out += self._verify(int(r), lists[r], found[a:b])
        return out

    def _verify(self, r: int, words: list[str], hits: np.ndarray) -> list[tuple[int, int, int, int]]:
        member = np.zeros(len(self.vocab) + 1, bool)
        for w in set(words):
            for c in self.classes(w):
                member[c] = True
        items, begin = np.unique(hits[:, 1], return_index=True)
        end = np.append(begin[1:], len(hits))
        there = member[self.matrix[items]]
        enough = there.sum(1) >= np.ceil(SHARE * self.sizes[items] - 1e-9)
        if there.shape[1] >= RUN:
            run = there
            for step in (1, 2, 4):
                run = run[:, step:] & run[:, :-step]
            four = there[:, 1:] & there[:, :-1]
            four = four[:, 2:] & four[:, :-2]
            run = run[:, : there.shape[1] - RUN + 1] & four[:, 8 : 8 + there.shape[1] - RUN + 1]
            enough |= run.any(1)
        out = []
        for n, a, b in zip(items[enough], begin[enough], end[enough]):
            run, kept = self._best(int(n), words, hits[a:b])
            if run >= RUN or kept >= self._need(int(n)):
                out.append((r, int(n), run, kept))
        return out

    def _need(self, n: int) -> int:
        return ceil(SHARE * len(self.items[n]) - 1e-9)

    def _best(self, n: int, words: list[str], hits: np.ndarray) -> tuple[int, int]:
        """Longest run and most words kept, over the stretches of the text that passages through the hits can reach."""
        size = len(self.items[n])
        masks = self.masks.get(n)
        if masks is None:
            masks = {}
            for i, v in enumerate(self.items[n]):
                masks[v] = masks.get(v, 0) | 1 << i
            if len(self.masks) > 20_000:
                self.masks.clear()
            self.masks[n] = masks
        room = size - self._need(n) + self.thrown_in
        begin = np.unique(hits[:, 2] - hits[:, 3])
        gap = np.flatnonzero(np.diff(begin) > size + 2 * room) + 1
        best_run = best_kept = 0
        for part in np.split(begin, gap):
            rows = []
            for w in words[max(0, int(part[0]) - room) : int(part[-1]) + size + room]:
                m = 0
                for c in self.classes(w):
                    m |= masks.get(c, 0)
                rows.append(m)
            run = self._run(rows)
            kept = self._kept(rows, size, self._need(n), run < RUN)
            best_run, best_kept = max(best_run, run), max(best_kept, kept)
        return best_run, best_kept

    @staticmethod
    def _run(rows: list[int]) -> int:
        """The most consecutive words of the item: ends of runs, moved on by one word, that match there."""
        longest, layer = 0, rows
        while any(layer):
            longest += 1
            layer = [0] + [layer[j - 1] << 1 & rows[j] for j in range(1, len(rows))]
        return longest

    def _kept(self, rows: list[int], size: int, need: int, whole: bool) -> int:
        """Words of the item less the distance to the best passage; the dearer forms only if ``whole`` and the plain one doesn't do."""
        ups, downs, scores = columns(rows, size)
        kept = size - min(scores)
        if kept >= need or not whole or self._ordered(rows, size) < need:
            return kept
        before = distances(ups, downs, size)
        back = [reversed_bits(m, size) for m in reversed(rows)]
        after = distances(*columns(back, size)[:2], size)[::-1, ::-1]
        kept = max(kept, size - int((lowest(before, self.thrown_in) + after).min()))
        return kept if kept >= need else max(kept, self._in_order(rows, size, need))

    @staticmethod
    def _ordered(rows: list[int], size: int) -> int:
        """The most words of the item that a stretch holds in order, whatever stands between."""
        full = v = (1 << size) - 1
        for m in rows:
            u = v & m
            v = (v + u | v - u) & full
        return size - v.bit_count()

    def _in_order(self, rows: list[int], size: int, need: int) -> int:
        """The most words in order within ``size`` and as many words more as may be changed."""
        span, kept = 2 * size - need, 0
        some = np.concatenate([[0], np.cumsum([m > 0 for m in rows])])
        ends = np.minimum(np.arange(len(rows)) + span, len(rows))
        for start in np.flatnonzero(some[ends] - some[:-1] >= need).tolist():
            if rows[start]:
                kept = max(kept, self._ordered(rows[start : start + span], size))
        return kept
