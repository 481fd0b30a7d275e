"""Predicates and scores over documents and instruction pairs, as Column expressions.

Sums of scores add doubles in a fixed order, as thresholds lie where the order of
additions decides.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lontar.functions import text as T

# Lexicons, patterns and thresholds that results depend on.
STOPWORDS = "yang dan di ke dari ini itu untuk pada adalah dengan tidak akan bisa sebagai dalam bahwa tersebut oleh saat juga telah lebih kami kita".split()
HINTS = "yang dan di ke dari untuk pada adalah dengan tidak akan bisa sudah juga lebih karena dalam sebagai jika atau kami kita anda kamu".split()
COMMON_WORDS = (
    "yang dan di ini itu dengan untuk dari pada adalah dalam tidak akan juga sudah bisa oleh ada atau saya anda kamu mereka kami kita sangat lebih karena tetapi bahwa seperti harus banyak telah dapat"
).split()
MORE_COMMON_WORDS = [*COMMON_WORDS, *"secara tersebut menjadi sebuah antara tentang namun serta beberapa setiap".split()]
CODE_MARKERS = ("```", "def ", "class ", "import ", "return ", "console.log", "<html")
BAD_WORDS = "judi slot togel casino porno bokep xxx sex hack crack phishing scam drugs narkoba terorisme bunuh".split()
BAD_CONTENT = "judi slot casino porno bokep phishing scam narkoba terorisme".split()
IDENTITY_OPENERS = ("saya adalah", "i am", "i'm")
IDENTITY_NAMES = "chatgpt gpt-4 gpt gemini claude openai".split()
META_PHRASES = ("as an ai language model", "sebagai model bahasa", "openai", "assistant created by openai")
TEMPLATE_STARTS = (
    "Jelaskan", "Uraikan", "Ceritakan", "Deskripsikan", "Berikan penjelasan", "Tolong jelaskan", "Bisakah kamu",
    "Bagaimana cara memahami", "Sebutkan dan jelaskan", "Analisis tentang", "Berikan informasi",
)
MIN_QUALITY_AUTOPILOT, MIN_QUALITY_AUDITOR, MIN_QUALITY_UNIFIED, MIN_QUALITY_PREFERENCE = 0.4, 0.45, 0.42, 0.3


def whole_word(alternatives: str) -> str:
    """Pattern of whole words, with word ends between letters, numbers or underscores and anything else."""
    return rf"(?i)(^|[^{T.WORDLIKE}])({alternatives})($|[^{T.WORDLIKE}])"


_NO_ASCII_LETTER = bytes(c for c in range(128) if not chr(c).isalpha())
_ASCII = bytes(range(128))


def letter_count(text: str) -> int:
    """The letters; those of ASCII are counted as bytes."""
    raw = text.encode()
    other = raw.translate(None, _ASCII)
    return len(raw.translate(None, _NO_ASCII_LETTER)) - len(other) + sum(map(str.isalpha, other.decode()))


def repeated(text: str, times: int = 10) -> bool:
    """Whether some character other than a line feed stands ``times`` times in a row."""
    c = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return b"\x01" * (times - 1) in ((c[1:] == c[:-1]) & (c[1:] != 10)).tobytes()


def first_failure(text: str, low: int, high: int) -> tuple[str | None, int]:
    """The first heuristic that a text fails, or None, and its number of words; the dear measures come last.  The empty text fails by ``length``."""
    if not text:
        return "length", 0
    words = text.split()
    n = len(words)
    if n < low or n > high:
        return "words", n
    if n and not 3 <= sum(map(len, words)) / n <= 10:
        return "mean_word_length", n
    if letter_count(text) / max(len(text), 1) < 0.6:
        return "letters", n
    lines, ends = text.splitlines(), text.count("\n") + 1
    if "..." in text and sum(s.rstrip().endswith("...") for s in lines) / ends > 0.3:
        return "ellipses", n
    if sum(s.lstrip().startswith(("-", "*", "•")) for s in lines) / ends > 0.9:
        return "bullets", n
    if n >= 20 and max(Counter(words).values()) / n > 0.3:
        return "top_word", n
    return ("repeats" if repeated(text) else None), n


@F.arrow_udf(StructType([StructField("reason", StringType()), StructField("n_words", IntegerType())]))
def gopher(text: pa.Array, min_words: pa.Array, max_words: pa.Array) -> pa.Array:
    """The first heuristic that a text fails (length, words, mean_word_length, letters, ellipses, bullets, top_word, repeats) or null, and its number of words.

    One pass over the text in Arrow batches: as Column expressions the measures over words and lines are
    interpreted element by element and take about ten times as long.  Null texts are empty ones.
    """
    made = [first_failure(t or "", low, high) for t, low, high in zip(text.to_pylist(), min_words.to_pylist(), max_words.to_pylist())]
    return pa.StructArray.from_arrays([pa.array([r for r, _ in made], pa.string()), pa.array([n for _, n in made], pa.int32())], names=["reason", "n_words"])


def lexicon_hits(text: Column, lexicon: list[str]) -> Column:
    """Different words of the lexicon among the lower-case words."""
    return F.size(F.array_intersect(T.words(F.lower(text)), F.array(*map(F.lit, lexicon))))


def stopword_share(text: Column) -> Column:
    w = T.words(F.lower(text))
    return F.size(F.filter(w, lambda x: x.isin(STOPWORDS))) / F.nullif(F.size(w), F.lit(0))


def likely_code(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (low.contains(m) for m in CODE_MARKERS))


def bad_words(text: Column) -> Column:
    return text.rlike(whole_word("|".join(BAD_WORDS)))


def bad_content(text: Column) -> Column:
    return text.rlike(whole_word("|".join(BAD_CONTENT)))


def wrong_identity(text: Column) -> Column:
    return text.rlike(rf"(?i)(^|[^{T.WORDLIKE}])({'|'.join(IDENTITY_OPENERS)})[{T.BLANK}]+({'|'.join(IDENTITY_NAMES)})($|[^{T.WORDLIKE}])")


def meta(text: Column) -> Column:
    return text.rlike(rf"(?i)({'|'.join(META_PHRASES)})")


def _sum(*terms: tuple[Column, float]) -> Column:
    """Doubles added in order, each where its condition holds."""
    total = F.lit(0.0)
    for condition, value in terms:
        total = total + F.when(condition, F.lit(value)).otherwise(F.lit(0.0))
    return total


def _sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\."), T.strip), lambda s: s != "")


def quality_autopilot(instruction: Column, output: Column) -> Column:
    """Lengths, lexicon, punctuation and sentence variety; unsafe or too short pairs have 0."""
    n, hits = F.length(output), lexicon_hits(output, COMMON_WORDS)
    pieces = F.size(F.split(output, r"\."))
    varied = (pieces > 1) & (F.size(F.array_distinct(_sentences(output))) / pieces > F.lit(0.5))
    s = _sum((n > 50, 0.15), (n > 100, 0.1), (n > 200, 0.1), (F.length(instruction) > 10, 0.1), (hits >= 3, 0.2), (hits >= 5, 0.1), (output.contains("."), 0.05), (output.contains(","), 0.05), (varied, 0.1))
    unsafe = bad_words(F.concat(instruction, F.lit(" "), output)) | (n < 15)
    return F.when(unsafe, F.lit(0.0)).otherwise(F.least(s, F.lit(1.0)))


def with_auditor_score(df: DataFrame, instruction: Column, output: Column, name: str = "score") -> DataFrame:
    """Adds the stricter score: hard zeros, penalties for length, repetition and templates, clamped to 0..1.

    Stripped texts, words and sentences are made in projections of their own, so each is
    made once per row and not once per term.
    """
    inst, out, tokens, sentences = (F.col(f"__{c}") for c in "iows")
    texts = df.withColumn("__i", T.strip(instruction)).withColumn("__o", T.strip(output))
    parts = texts.withColumn("__w", T.words(F.lower(out))).withColumn("__s", _sentences(out))
    lexicon = F.array(*map(F.lit, MORE_COMMON_WORDS))
    measured = parts.withColumn("__h", F.size(F.array_intersect(tokens, lexicon))).withColumn("__u", F.size(F.array_distinct(sentences))).withColumn("__t", F.when(F.size(tokens) > 10, T.top_count(tokens)))
    n, hits, count = F.length(out), F.col("__h"), F.size(sentences)
    unique = F.when(count > 1, F.col("__u") / count)
    top = (F.size(tokens) > 10) & (F.col("__t") / F.size(tokens) * 100 > 30)
    template = reduce(lambda a, b: a | b, (inst.startswith(t) for t in TEMPLATE_STARTS))
    s = _sum(
        (n > 3000, -0.1), (n > 50, 0.1), (n > 100, 0.1), (n > 200, 0.05), (F.length(inst) > 15, 0.1), (inst.contains("?") | inst.contains("!"), 0.05),
        (hits >= 3, 0.15), (hits >= 5, 0.1), (hits >= 8, 0.05), (count >= 2, 0.1), (count >= 3, 0.05), (unique > F.lit(0.7), 0.1), (unique < F.lit(0.3), -0.2),
        (out.contains("."), 0.03), (out.contains(","), 0.02), (top, -0.2), (template & (n < 100), -0.15),
    )
    zero = (n < 30) | (F.length(inst) < 8) | bad_words(F.concat(inst, F.lit(" "), out))
    score = F.when(zero, F.lit(0.0)).otherwise(F.greatest(F.least(s, F.lit(1.0)), F.lit(0.0)))
    return measured.withColumn(name, score).drop("__i", "__o", "__w", "__s", "__h", "__u", "__t")


def hint_score(simple: Column) -> Column:
    """Different hint words in a simplified text."""
    return F.size(F.array_intersect(T.words(simple), F.array(*map(F.lit, HINTS))))


def quality_unified(instruction: Column, response: Column, simple_response: Column) -> Column:
    n, m = F.length(instruction), F.length(response)
    fits = (hint_score(simple_response) >= 2) | likely_code(response)
    s = _sum(
        (n >= 10, 0.15), (n >= 25, 0.10), (m >= 40, 0.20), (m >= 120, 0.20), (m <= 2500, 0.10), (response.contains("\n"), 0.10),
        (response.rlike("[.:;]"), 0.05), (fits, 0.10), (T.repeats(response, 7), -0.25),
    )
    return F.greatest(F.lit(0.0), F.least(s, F.lit(1.0)))


def reject_reason(instruction: Column, response: Column, source: Column, simple_response: Column) -> Column:
    """The first reason to reject a pair, or null."""
    both = F.concat(instruction, F.lit("\n"), response)
    foreign = ~likely_code(response) & (hint_score(simple_response) < 1) & ~source.eqNullSafe(F.lit("synthetic"))
    return (
        F.when(F.length(instruction) < 8, "instruction_too_short")
        .when(F.length(response) < 20, "response_too_short")
        .when(F.length(response) > 3200, "response_too_long")
        .when(bad_content(both), "bad_content")
        .when(wrong_identity(response), "wrong_identity")
        .when(meta(response), "meta_response")
        .when(T.repeats(both, 7), "noisy_repetition")
        .when(foreign, "not_indonesian_enough")
        .when(quality_unified(instruction, response, simple_response) < F.lit(MIN_QUALITY_UNIFIED), "low_quality")
    )


def preference_clean(df: DataFrame) -> DataFrame:
    """Preference pairs long enough on all sides, with different answers, the chosen one not much shorter and of quality."""
    prompt, chosen, rejected = F.col("prompt"), F.col("chosen"), F.col("rejected")
    sizes = (F.length(prompt) >= 5) & (F.length(chosen) >= 20) & (F.length(rejected) >= 5)
    fit = df.where(sizes & (chosen != rejected) & (F.length(chosen) >= F.length(rejected) * F.lit(0.5)))
    return with_auditor_score(fit, prompt, chosen, "__score").where(F.col("__score") >= F.lit(MIN_QUALITY_PREFERENCE)).drop("__score")


def grade(answer: Column, must: Column, must_not: Column, min_length: Column) -> Column:
    """Reasons why an answer fails; an empty array is a pass."""
    low = F.lower(answer)
    found = F.filter(must_not, lambda k: low.contains(F.lower(k)))
    missing = (F.size(must) > 0) & ~F.exists(must, lambda k: low.contains(F.lower(k)))
    reasons = F.array(
        F.when(missing, F.lit("missing keywords")), F.when(F.size(found) > 0, F.concat(F.lit("contains: "), F.array_join(found, ", "))),
        F.when((min_length > 0) & (F.length(answer) < min_length), F.lit("too short")), F.when(F.length(T.strip(answer)) < 5, F.lit("empty")),
    )
    return F.array_compact(reasons)
