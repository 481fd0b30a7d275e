"""Column functions over text with Python's notions of blanks, lines and letters.

Everything here stays in the JVM but for ``nfkc`` and ``top_count``.  Patterns name their characters
instead of using ``\\s`` and ``\\w``, whose meaning differs between engines.  All
functions give null for a null text unless they say otherwise.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

#: Blanks as ``str.split`` knows them.
BLANK = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Line ends as ``str.splitlines`` knows them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: Letters, numbers and the underscore.
WORDLIKE = r"\p{L}\p{N}_"

#: What the scrubber takes for web and mail addresses.
URL = rf"https?://[^{BLANK}]+"
EMAIL = rf"[{WORDLIKE}.+\-]+@[{WORDLIKE}\-]+\.[{WORDLIKE}.\-]+"


@F.arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Compatibility composition; the JVM has no such function among its SQL functions."""
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


def text_or_empty(text: Column) -> Column:
    """Null and missing fold to the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """The pieces between blanks, none empty."""
    return F.filter(F.split(text, rf"[{BLANK}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def mean_word_length(text: Column) -> Column:
    """Characters that are no blanks, per word; null without words."""
    w = words(text)
    return F.length(F.array_join(w, "")) / F.nullif(F.size(w), F.lit(0))


def letter_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.greatest(F.length(text), F.lit(1))


def lines(text: Column) -> Column:
    """Lines without their ends; a line end at the very end opens no further line."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def newline_count(text: Column) -> Column:
    """Line feeds plus one, the denominator of the line shares."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def ellipsis_lines(text: Column) -> Column:
    return F.size(F.filter(lines(text), lambda s: strip(s).endswith("...")))


def bullet_lines(text: Column) -> Column:
    return F.size(F.filter(lines(text), lambda s: s.rlike(rf"^[{BLANK}]*[\-*•]")))


@F.arrow_udf(IntegerType())
def top_count(items: pa.Array) -> pa.Array:
    """How often the most frequent element of an array occurs, 0 in an empty one; counted for a whole batch at once."""
    sizes = items.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    codes = items.flatten().dictionary_encode()
    wide = len(codes.dictionary) + 1
    keys, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * wide + codes.indices.fill_null(wide - 1).to_numpy(zero_copy_only=False), return_counts=True)
    best = np.zeros(len(sizes), np.int64)
    np.maximum.at(best, keys // wide, counts)
    return pa.array(best, pa.int32(), mask=items.is_null().to_numpy(zero_copy_only=False))


def repeats(text: Column, times: int) -> Column:
    """Whether some character other than a line feed stands ``times`` times in a row."""
    return text.rlike(rf"([^\n])\1{{{times - 1},}}")


def scrub(text: Column) -> Column:
    """Addresses of web and mail become a blank, outer blanks go.  Texts without their marks are spared the patterns, which try every word."""
    webless = F.when(text.contains("://"), F.regexp_replace(text, URL, " ")).otherwise(text)
    return strip(F.when(text.contains("@"), F.regexp_replace(webless, EMAIL, " ")).otherwise(webless))


def clean(text: Column) -> Column:
    """Words of fewer than 50 characters, joined by single blanks."""
    return F.array_join(F.filter(words(text), lambda w: F.length(w) < 50), " ")


def normalize(text: Column) -> Column:
    """Composed text without zero-width signs, with line feeds only, without blanks around them, at most one empty line."""
    t = F.regexp_replace(nfkc(text), r"[\x{200B}-\x{200D}\x{FEFF}]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\r\n|\r", "\n"), r"[ \t]+", " ")
    return strip(F.regexp_replace(F.regexp_replace(t, r" *\n *", "\n"), r"\n{3,}", "\n\n"))


def simplify(normal: Column) -> Column:
    """Lower-case ASCII letters and digits of a normalised text, other signs become blanks."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(normal), rf"[^a-z0-9{BLANK}]", " "), r"[ \t]+", " "))


def estimated_tokens(text: Column) -> Column:
    """Three quarters of the words, at least one."""
    return F.greatest(F.lit(1), F.floor(word_count(text) * F.lit(0.75)).cast("int"))


def ngrams(tokens: Column, n: int, whole_if_short: bool = False) -> Column:
    """Runs of n words, joined by blanks; of fewer words none, or the whole text as one."""
    short = F.array(F.array_join(tokens, " ")) if whole_if_short else F.array().cast("array<string>")
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, runs).otherwise(F.when(F.size(tokens) > 0, short).otherwise(F.array().cast("array<string>")))


def piece_count(text: Column) -> Column:
    """ASCII alphanumeric runs and other single characters, a plain stand-in for a tokenizer."""
    others = F.length(F.regexp_replace(text, "[A-Za-z0-9]+", ""))
    runs = F.length(F.regexp_replace(F.regexp_replace(text, "[A-Za-z0-9]+", "a"), "[^a]", ""))
    return others + runs


#: Beginnings of templated instructions, stripped before fuzzy keys are made.
TEMPLATES = (
    "Jelaskan|Uraikan|Ceritakan|Deskripsikan|Berikan penjelasan tentang|Tolong jelaskan|Bisakah kamu menjelaskan|"
    "Bagaimana cara memahami|Sebutkan dan jelaskan|Analisis tentang|Berikan informasi mengenai"
)
#: Verbs that begin an instruction, stripped to find its topic.
TOPIC_VERBS = "Jelaskan|Apa|Bagaimana|Ceritakan|Sebutkan|Mengapa|Tolong|Berikan|Uraikan"


def without_template(instruction: Column) -> Column:
    """The first 60 lower-case characters after a leading template."""
    return F.substring(F.lower(strip(F.regexp_replace(instruction, rf"(?i)^({TEMPLATES})[{BLANK}]+", ""))), 1, 60)


def topic(instruction: Column) -> Column:
    """The first 80 characters after a leading verb, without question and exclamation marks."""
    return F.substring(strip(F.regexp_replace(F.translate(instruction, "?!", ""), rf"^({TOPIC_VERBS})[{BLANK}]+", "")), 1, 80)


#: How a plain text becomes a task to sum it up.
SUMMARY_PREFIX = "Ringkas teks berikut:\n"


def summary_pair(text: Column) -> tuple[Column, Column]:
    """Instruction (the first 500 characters) and output (the first 250, cut at the last full stop)."""
    head = F.substring(text, 1, 250)
    return F.concat(F.lit(SUMMARY_PREFIX), F.substring(text, 1, 500)), F.concat(F.regexp_replace(head, r"(?s)\.[^.]*$", ""), F.lit("."))


def chat_turn(role: Column, content: Column) -> Column:
    """The marks around a turn of a rendered conversation."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), content, F.lit("<|im_end|>\n"))
