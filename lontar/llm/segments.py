"""Language of whole documents and of their single-language segments (batch functions over lists of texts)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np

from lontar.llm.normal import plain
from lontar.llm.spectrum import END, WORD, SpectrumModel, WordScores

#: Words, and the ends of sentences and lines between them.
_PART = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?…]+[\"'”’)]*(?=\s)|[\n\r\u2028\u2029]")
#: Words of a unit without an end mark; longer ones are cut.
UNIT_WORDS = 12
#: What a change of language costs, in summed word scores.
SWITCH = 4.0
#: Consecutive words that make a segment of its own.
SEGMENT_WORDS = 20
#: Mean advantage over the main language from which a run is another language (its own scores about 1, the others about -1).
MARGIN = 1.0
#: Summed advantage over the main language that a run of a lower mean needs.
EVIDENCE = 2 * SWITCH
#: Shares of held-out windows below the least advantage and the least own score of such a run.
ADVANTAGE_TAIL, OWN_TAIL = 0.01, 0.05


@dataclass
class Weak:
    """What a run of less than ``MARGIN`` needs: the mean advantage by its language and the main one, the mean score of its own language."""

    ahead: np.ndarray
    own: np.ndarray


@dataclass
class Segment:
    language: int
    first_word: int
    words: int
    confidence: float
    mean: np.ndarray


def units(ids: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the words of all texts, the document of each word, and of each unit the place of its first word and its size.

    ``ids`` are rows of words and ``END`` for the ends between units, ``document`` the text
    of each.  A unit is a sentence or line; long ones are cut into even parts.
    """
    word = ids != END
    rows, own = ids[word], document[word]
    if not len(rows):
        none = np.zeros(0, np.int64)
        return rows, own, none, none
    run = np.cumsum(~word)[word]
    first = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (own[1:] != own[:-1])]))
    size = np.diff(np.append(first, len(rows)))
    parts = np.where(size > 2 * UNIT_WORDS, -(-size // UNIT_WORDS), 1)
    if (parts > 1).any():
        unit = np.repeat(np.arange(len(first)), parts)
        k = np.arange(len(unit)) - np.repeat(parts.cumsum() - parts, parts)
        first = first[unit] + k * size[unit] // parts[unit]
        size = np.diff(np.append(first, len(rows)))
    return rows, own, first, size


def best_path(sums: np.ndarray, switch: float) -> np.ndarray:
    """The sequence of languages with the highest sum of scores, less the cost of the changes."""
    n, k = sums.shape
    back = np.zeros((n, k), np.int64)
    at = sums[0].copy()
    stay = np.arange(k)
    for i in range(1, n):
        top = int(at.argmax())
        change = at[top] - switch
        back[i] = np.where(at >= change, stay, top)
        at = np.maximum(at, change) + sums[i]
    path = np.empty(n, np.int64)
    path[-1] = int(at.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def sharpness(model: SpectrumModel, texts: list[str], labels: list[str]) -> float:
    """The factor by which mean scores become probabilities, of least log loss on the samples."""
    scores = WordScores(model)
    means = np.stack([scores.rows(words_or_blank(t)).mean(0) for t in texts])
    at = np.array([model.languages.index(x) for x in labels])
    best, factor = np.inf, 4.0
    for f in (1, 2, 3, 4, 6, 8, 10, 12):
        z = means * f
        loss = (np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(at)), at]).mean()
        if loss < best:
            best, factor = loss, float(f)
    return factor


def weak_runs(model: SpectrumModel, texts: list[str], labels: list[str]) -> Weak:
    """Measured on windows of ``SEGMENT_WORDS`` words of texts the model hasn't seen.

    Languages that the model tells apart by ``MARGIN`` anyway keep it; a language without
    twenty windows keeps it too.  Lists, names and numbers of the main language lean to a related
    one, but don't score for it as its own text does.
    """
    k = len(model.languages)
    weak = Weak(np.full((k, k), MARGIN), np.full(k, np.inf))
    scores = WordScores(model)
    for a, language in enumerate(model.languages):
        words = [w for t, c in zip(texts, labels) if c == language for w in WORD.findall(t.lower())]
        if len(words) < SEGMENT_WORDS + 20:
            continue
        sums = np.cumsum(np.vstack([np.zeros(k), scores.rows(words)]), axis=0)
        mean = (sums[SEGMENT_WORDS:] - sums[:-SEGMENT_WORDS]) / SEGMENT_WORDS
        weak.ahead[a] = np.minimum(MARGIN, np.quantile(mean[:, a, None] - mean, ADVANTAGE_TAIL, axis=0))
        weak.own[a] = np.quantile(mean[:, a], OWN_TAIL)
    return weak


def words_or_blank(text: str) -> list[str]:
    return WORD.findall(text.lower()) or [""]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def segment_batch(texts: list[str | None], scores: WordScores, factor: float, weak: Weak | None = None) -> list[list[Segment]]:
    """For each text its runs of one language, in order; texts without words have none.

    A run is of another language than the main one only where its words score ``MARGIN``
    higher for it on average, or ``SEGMENT_WORDS`` or more reach what ``weak`` says of the two
    languages and add up to ``EVIDENCE``; any other run is odd text of the main language and joins its neighbours.
    """
    tokens = [_PART.findall(plain(t)) if t else [] for t in texts]
    lengths = np.array([len(t) for t in tokens], np.int64)
    ids = scores.ids(chain.from_iterable(tokens), int(lengths.sum()))
    rows, own, starts, size = units(ids, np.repeat(np.arange(len(texts)), lengths))
    out: list[list[Segment]] = [[] for _ in texts]
    if not len(rows):
        return out
    sums = np.add.reduceat(scores.table[rows], starts, axis=0)
    label, of = sums.argmax(1), own[starts]
    edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    ends = np.append(edges[1:], len(of))
    same = np.minimum.reduceat(label, edges) == np.maximum.reduceat(label, edges)
    whole, words = np.add.reduceat(sums, edges, axis=0), np.add.reduceat(size, edges)
    mean = whole / words[:, None]
    sure = softmax(mean * factor)
    for k, (a, b) in enumerate(zip(edges.tolist(), ends.tolist())):
        if same[k]:
            at = int(label[a])
            out[of[a]] = [Segment(at, 0, int(words[k]), float(sure[k, at]), mean[k])]
        else:
            out[of[a]] = runs(sums[a:b], size[a:b], factor, weak)
    return out


def runs(sums: np.ndarray, sizes: np.ndarray, factor: float, weak: Weak | None = None) -> list[Segment]:
    """The runs of a text whose units don't agree."""
    path = best_path(sums, SWITCH)
    begins = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1])
    total, count, language = np.add.reduceat(sums, begins, axis=0), np.add.reduceat(sizes, begins), path[begins]
    if len(begins) > 1:
        main = int(total.sum(0).argmax())
        mean = total / count[:, None]
        own = mean[np.arange(len(language)), language]
        ahead = own - mean[:, main]
        sure = ahead >= MARGIN
        if weak is not None:
            sure |= (count >= SEGMENT_WORDS) & (ahead >= weak.ahead[language, main]) & (ahead * count >= EVIDENCE) & (own >= weak.own[language])
        language = np.where(sure, language, main)
        begins = np.concatenate([[0], np.flatnonzero(np.diff(language)) + 1])
        total, count, language = np.add.reduceat(total, begins, axis=0), np.add.reduceat(count, begins), language[begins]
    mean = total / count[:, None]
    sure = softmax(mean * factor)
    first = np.concatenate([[0], count.cumsum()[:-1]])
    return [Segment(int(k), int(f), int(c), float(s[k]), v) for k, f, c, s, v in zip(language, first, count, sure, mean)]


def main_language(segments: list[Segment], languages: int) -> int:
    """The language with the highest sum of word scores over the whole text."""
    return int(sum(s.mean * s.words for s in segments).argmax()) if segments else -1


def long_languages(segments: list[Segment]) -> list[int]:
    """Languages of at least ``SEGMENT_WORDS`` consecutive words."""
    return sorted({s.language for s in segments if s.words >= SEGMENT_WORDS})
