"""Language scores from a blended-spectrum string kernel with Nyström landmarks and kernel ridge regression.

A word's feature is the presence vector of its character n-grams (all orders up
to ``orders``, with a sign for the word's ends), scaled to length one; a text's
feature is the mean over its words, and the kernel of two texts is the product of
their features.  Landmark texts give the Nyström map, one-versus-rest ridge
regression in that space gives one score per language.  As both are linear in
the presence vectors, landmarks and regression fold into one matrix of n-grams by
languages, and the scores of a batch of words are one sparse matrix product.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")

#: Distinct words whose scores one worker keeps.
MAX_WORDS = 300_000


def grams(word: str, orders: int) -> set[str]:
    w = f"^{word}$"
    n = len(w)
    return {w[i : i + k] for k in range(2, orders + 1) for i in range(n - k + 1)} | set(word)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class SpectrumModel:
    languages: list[str]
    orders: int
    index: dict[str, int]
    weight: np.ndarray

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], orders: int = 6, landmarks: int = 300, ridge: float = 1e-3, seed: int = 7) -> "SpectrumModel":
        languages = sorted(set(labels))
        index: dict[str, int] = {}
        rows, cols, vals = [], [], []
        for r, text in enumerate(texts):
            found = words_of(text)
            for w in found:
                g = grams(w, orders)
                unit = 1 / (len(g) ** 0.5 * len(found))
                for x in g:
                    rows.append(r)
                    cols.append(index.setdefault(x, len(index)))
                    vals.append(unit)
        psi = np.zeros((len(texts), len(index)), np.float32)
        np.add.at(psi, (np.array(rows, np.int64), np.array(cols, np.int64)), np.array(vals, np.float32))
        pick = np.sort(np.random.default_rng(seed).permutation(len(texts))[:landmarks])
        base = psi[pick].astype(np.float64)
        value, vector = np.linalg.eigh(base @ base.T)
        keep = value > 1e-9 * value.max()
        to_space = base.T @ (vector[:, keep] / np.sqrt(value[keep]))
        z = psi @ to_space
        target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
        mean = target.mean(0)
        coef = np.linalg.solve(z.T @ z + ridge * len(texts) / 100 * np.eye(z.shape[1]), z.T @ (target - mean))
        return cls(languages, orders, index, (to_space @ coef).astype(np.float32))

    def scorer(self) -> "WordScores":
        return WordScores(self)


#: The row of whatever is no word; its scores are 0.
END = 0


class WordScores(dict):
    """Row numbers of words in ``table``, a growing matrix of language scores."""

    def __init__(self, model: SpectrumModel) -> None:
        super().__init__()
        self.model = model
        self.fresh: list[str] = []
        self.table = np.zeros((1, len(model.languages)), np.float32)

    def __missing__(self, word: str) -> int:
        if not word[:1].isalnum():
            self[word] = END
            return END
        i = len(self.table) + len(self.fresh)
        self[word] = i
        self.fresh.append(word)
        return i

    def ids(self, words, count: int) -> np.ndarray:
        """Rows of the words; new ones are scored first, in one sparse product."""
        if len(self) > MAX_WORDS:
            self.clear()
            self.fresh, self.table = [], self.table[:1]
        ids = np.fromiter(map(self.__getitem__, words), np.int64, count)
        if self.fresh:
            index, orders = self.model.index, self.model.orders
            sets = [grams(w, orders) for w in self.fresh]
            sizes = np.array([len(s) for s in sets])
            flat = np.array([index.get(g, -1) for s in sets for g in s], np.int64)
            padded = np.vstack([self.model.weight, np.zeros((1, self.model.weight.shape[1]), np.float32)])
            sums = np.add.reduceat(padded[flat], np.concatenate([[0], sizes.cumsum()[:-1]]), axis=0)
            self.table = np.vstack([self.table, sums / np.sqrt(sizes)[:, None].astype(np.float32)])
            self.fresh = []
        return ids

    def rows(self, words: list[str]) -> np.ndarray:
        """Scores of each word, N by languages."""
        ids = self.ids(words, len(words))
        return self.table[ids]
