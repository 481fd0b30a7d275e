"""Statistics of one document's text, whole text, plain Python over a few regular expressions."""

from __future__ import annotations

import re
from collections import Counter
from math import log1p
from zlib import compress

import numpy as np

#: Frequent function words of English and Indonesian, the base of the common words.
COMMON = frozenset(
    """
    the a an of and to in is was were are be been by for with on at that this it as from or not but which who will would could should can had has have
    yang dan di ke dari untuk pada dengan adalah itu ini tidak akan oleh karena juga atau dalam bisa ada sudah belum harus saya kami kita mereka anda
    """.split()
)


def language_words(samples: list[tuple[str, str]]) -> Counter:
    """In how many of (language, text) samples each word stands: keys (language, word)."""
    found: Counter = Counter()
    for language, text in samples:
        found.update((language, w) for w in set(_WORD.findall(text.lower())) if not w.isdigit())
    return found


NAMES = (
    "log_chars", "log_words", "log_lines", "mean_word_len", "letter_share", "digit_share", "symbol_share", "blank_share",
    "end_mark_share", "comma_end_share", "marker_share", "log_words_line", "line_spread", "log_longest_line", "short_line_share",
    "common_share", "type_share", "top_word_share", "pair_share", "column_share", "columns", "log_longest_run",
    "odd_share", "code_line_share", "line_type_share", "sentences_words", "capital_line_share", "number_word_share",
    "log_types", "entry_share", "packed_share", "colon_share", "gap_share", "seen_letters", "comma_word_share", "quote_line_share", "one_word_line_share",
)

_WORD = re.compile(r"[^\W_]+")
_MARKER = re.compile(r"(?:[-*+•·–—»›▪◦‣○●■□✓✔→>]|\[[ xX]?\]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.):])\s*(?=\S)")
_CODE = re.compile(
    r"[;{}]\s*$|^\s*(?:def |class |return\b|import |from \w+ import|if .*:$|if .*\{|for .*:$|for .*\{|while .*[:{]$|func |function |var |let |const |public |private |static |int |void |else\b|elif |try:|print\(|console\.|#include|package |use |SELECT |//|/\*|# |\"\"\"|<\?php|\w+ ?:?= |\w+\.\w+\(|\w+\(.*\)$|@\w+$)"
)
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_ASCII_LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = re.compile(r"[.!?…]+(?=\s|$|[\"'”’)])")
_ODD = re.compile(r"[�\x80-\xa0¡-¿ÃÂÐÑÏÎâïœšžŸ€™‚„†‡ˆ‰‹›]")
_SEPARATORS = ("|", "\t", ";", ",", "│", " / ", " - ", ":")
_WIDE_GAP = re.compile(r"\S( {2,})(?=\S)")
_END = frozenset(".!?…。:")
_CLOSE = "\"'”’)]*_»"


def statistics(text: str | None, common: frozenset[str] = COMMON) -> list[float]:
    """The values of ``NAMES`` for one text; null, empty and blank texts give zeros."""
    text = text or ""
    lines = [s for s in map(str.strip, text.splitlines()) if s]
    if not lines:
        return [0.0] * len(NAMES)
    words = _WORD.findall(text.lower())
    chunks = text.split()
    n, m, solid = len(words), len(lines), len("".join(chunks))
    raw = text.encode("utf-8", "replace")
    if len(raw) == len(text):
        letters, digits = len(raw) - len(raw.translate(None, _ASCII_LETTERS)), len(raw) - len(raw.translate(None, b"0123456789"))
    else:
        letters, digits = len("".join(_LETTERS.findall(text))), len("".join(_DIGITS.findall(text)))
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    per = [len(s.split()) for s in lines]
    mean_per = sum(per) / m
    ends = [s.rstrip(_CLOSE)[-1:] or s[-1] for s in lines]
    column_share, columns = 0.0, 0.0
    rows = lines[1:] if m > 3 else lines
    for sep in _SEPARATORS:
        if sep in text:
            cells = [s.count(sep) for s in rows]
            most, times = max(Counter(cells).items(), key=lambda x: (x[0] > 0, x[1]))
            if most and times / len(rows) > column_share:
                column_share, columns = times / len(rows), float(most)
    gaps = 0
    if "  " in text or "\t" in text:
        cells = [len(_WIDE_GAP.findall(s)) for s in rows]
        gaps = sum(x > 0 for x in cells)
        most, times = max(Counter(cells).items(), key=lambda x: (x[0] > 0, x[1]))
        if most and times / len(rows) > column_share:
            column_share, columns = times / len(rows), float(most)
    top = max(counts.values()) if counts else 0
    marks = len(_MARKS.findall(text))
    return [
        log1p(len(text)), log1p(n), log1p(m), sum(map(len, words)) / n if n else 0.0, letters / solid, digits / solid, (solid - letters - digits) / solid, 1 - solid / len(text),
        sum(e in _END for e in ends) / m, sum(e in ",;" for e in ends) / m, sum(_MARKER.match(s) is not None for s in lines) / m,
        log1p(mean_per), (sum((x - mean_per) ** 2 for x in per) / m) ** 0.5 / (1 + mean_per), log1p(max(per)), sum(x <= 8 for x in per) / m,
        sum([c for w, c in counts.items() if w in common]) / n if n else 0.0, len(counts) / n if n else 0.0, top / n if n else 0.0,
        pairs / (n - 1) if n > 1 else 1.0, column_share, log1p(columns), log1p(max(map(len, chunks))),
        len(_ODD.findall(text)) / solid if len(raw) != len(text) else 0.0, sum(_CODE.search(s) is not None for s in lines) / m, len(set(lines)) / m,
        marks / (1 + n), sum(s[0].isupper() for s in lines) / m, sum(map(str.isdigit, words)) / n if n else 0.0,
        log1p(len(counts)), sum(x <= 8 and e not in _END for x, e in zip(per, ends)) / m, len(compress(raw, 1)) / len(raw) if len(raw) >= 256 else 0.5, text.count(":") / m, gaps / m, log1p(len(set(text))),
        text.count(",") / (1 + n), sum(s[0] in "\"'“‘" for s in lines) / m, sum(x == 1 for x in per) / m,
    ]


def matrix(texts: list[str | None], common: frozenset[str] = COMMON) -> np.ndarray:
    return np.array([statistics(t, common) for t in texts], dtype=np.float64).reshape(len(texts), len(NAMES))
