"""Cutting long texts into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.llm.arrow import batch, map_batches
from lontar.llm.bpe import piece_counts, pretokens, tokenizer_path
from lontar.plans.runtime import spread

_PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*")
_SENTENCE = re.compile(r"[.!?。…]+[\"'”’)\]]*\s+|\n")
_WORD = re.compile(r"(?<=\S)(?=\s)")
#: A paragraph's end is taken if it leaves at most this part of the limit unused, a sentence's likewise.
PARAGRAPH_SLACK, SENTENCE_SLACK = 0.25, 0.5
#: Pre-tokens of more tokens may be cut inside (of fewer under small limits).
WHOLE = 8


def boundaries(text: str, starts: np.ndarray) -> list[np.ndarray]:
    """Token-aligned character places of paragraph, sentence and word boundaries, each sorted.

    A boundary inside a pre-token is moved to the beginning of that pre-token, so that
    a cut never changes the tokens on either side.
    """
    out = []
    for places in (
        [m.end() for m in _PARAGRAPH.finditer(text)],
        [m.end() for m in _SENTENCE.finditer(text)],
        [m.start() for m in _WORD.finditer(text)],
    ):
        at = np.searchsorted(starts, np.array(places, np.int64), side="right") - 1
        out.append(np.unique(at[at > 0]))
    return out


def split_text(text: str, limit: int, overlap: int, counts) -> list[tuple[int, int, int, int]]:
    """(first character, end character, first token, end token) of the pieces; one piece where the text is within the limit.

    ``counts`` gives the number of tokens of pre-tokens.  With the prefix sums of the
    tokens, the last boundary within the limit is a binary search: paragraph ends are
    preferred, then sentence ends, then word ends, where the finer ones would use much
    more of the limit, then the ends of pre-tokens.  The next piece begins ``overlap`` tokens back, at the last
    word's or pre-token's boundary that shares so many; so more is shared only as far as that boundary lies back.

    Cuts inside a pre-token fall between its tokens and between its characters.  An end falls there only where
    no piece could go on otherwise: in a pre-token that doesn't fit into the limit with the overlap before it; a
    beginning where no boundary lies within another ``overlap`` tokens back.  Less is shared only where the tokens
    of the next character wouldn't fit after the overlap.
    """
    parts = pretokens(text)
    sizes = counts.lengths(parts)
    if int(sizes.sum()) <= limit:
        return [(0, len(text), 0, int(sizes.sum()))]
    largest = min(WHOLE, max(1, (limit - overlap) // 4))
    steps, inner = [], []
    for p, n in zip(parts, sizes.tolist()):
        if n <= largest:
            steps.append((len(p), n))
            inner.append(False)
        else:
            chars, tokens = counts.encoder.cuts(p)
            steps += zip(np.diff(chars, prepend=0).tolist(), np.diff(tokens, prepend=0).tolist())
            inner += [False] + [True] * (len(chars) - 1)
    chars, tokens = np.concatenate([np.zeros((1, 2), np.int64), np.array(steps, np.int64)]).cumsum(0).T.tolist()
    inner.append(False)
    whole = [k for k, x in enumerate(inner) if not x]
    paragraph, sentence, word = ([whole[k] for k in b] for b in boundaries(text, np.array([chars[k] for k in whole[:-1]])))
    total = tokens[-1]

    def before(places: list[int], low: int, high: int) -> int | None:
        """The last of the places in (low, high]."""
        k = bisect_right(places, high)
        return places[k - 1] if k and places[k - 1] > low else None

    out, begin, done = [], 0, 0
    while True:
        first = tokens[begin]
        if total - first <= limit:
            out.append((chars[begin], len(text), first, total))
            return out
        reach = bisect_right(tokens, first + limit) - 1
        end = None
        for places, slack in ((paragraph, PARAGRAPH_SLACK), (sentence, SENTENCE_SLACK), (word, 1.0), (whole, 1.0)):
            least = bisect_left(tokens, first + int(limit * (1 - slack))) - 1
            end = before(places, max(begin, done, least), reach)
            if end is not None:
                break
        if end is None:
            end = reach
        out.append((chars[begin], chars[end], first, tokens[end]))
        back = bisect_right(tokens, tokens[end] - overlap) - 1
        nearest = max(begin, bisect_left(tokens, tokens[end] - 2 * overlap) - 1)
        step = None
        for places in (word, whole):
            at = before(places, nearest, back)
            # a beginning from which the next end at a boundary can be reached
            if at is not None and tokens[whole[bisect_right(whole, end)]] - tokens[at] <= limit:
                step = at
                break
        if step is None:
            step = max(back, begin + 1, bisect_left(tokens, tokens[end + 1] - limit))
        begin, done = step, end


def pieces(documents: DataFrame, limit: int, overlap: int, path: str | None = None) -> DataFrame:
    """The pieces of every text of more than ``limit`` tokens.

    ``doc_id``, ``piece`` (from 0), ``pieces``, ``first_char``, ``end_char``, ``first_token``, ``end_token``, ``tokens`` (the sum of
    the pre-tokens' tokens, never above the limit), ``text``.  Texts within the limit,
    null and empty ones have no row.  ``overlap`` is below half the limit.
    """
    if not 0 <= 2 * overlap < limit:
        raise ValueError("the overlap must be below half the limit")
    path = path or tokenizer_path()
    rows = documents.select("doc_id", "text")

    def work(b: pa.RecordBatch) -> pa.RecordBatch | None:
        counts = piece_counts(path)
        at, cols = [], [[] for _ in range(8)]
        for i, text in enumerate(b.column(1).to_pylist()):
            if not text or len(text.encode()) <= limit:
                continue
            cuts = split_text(text, limit, overlap, counts)
            if len(cuts) < 2:
                continue
            for k, (c0, c1, t0, t1) in enumerate(cuts):
                at.append(i)
                for col, v in zip(cols, (k, len(cuts), c0, c1, t0, t1, t1 - t0, text[c0:c1])):
                    col.append(v)
        if not at:
            return None
        names = ("piece", "pieces", "first_char", "end_char", "first_token", "end_token", "tokens")
        return batch(doc_id=b.column(0).take(pa.array(at)), **{n: pa.array(c, pa.int32()) for n, c in zip(names, cols)}, text=pa.array(cols[7]))

    schema = f"doc_id {rows.schema[0].dataType.simpleString()}, piece int, pieces int, first_char int, end_char int, first_token int, end_token int, tokens int, text string"
    return map_batches(spread(rows), work, schema)
