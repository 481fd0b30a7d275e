"""Defective answers of instruction and preference pools."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.llm.arrow import batch, map_batches
from lontar.llm.pairs import Judge, request_words, sample_words, voters
from lontar.plans.runtime import cut, spread

#: Texts of a language in which a word stands at least to vote for it, and its least share of the word's rate over all languages.
LEAST, PURITY = 3, 0.9
#: The same share for words of questions; lower than the samples', as some answers are in a wrong language.
REQUEST_PURITY = 0.8


def learnt(rows: DataFrame, count: Callable[[list[tuple]], Counter], purity: float = PURITY) -> dict[str, str]:
    """Words that vote for a language, learnt from all ``rows`` of two columns by what ``count`` finds in them.

    ``count`` gives numbers by (word, language), where '' as a word stands for all texts of the language.
    Words are counted and decided on the workers; only those that vote come to the driver.
    """

    def work(b: pa.RecordBatch) -> pa.RecordBatch | None:
        found = count(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
        if not found:
            return None
        return batch(word=pa.array([w for w, _ in found]), language=pa.array([x for _, x in found]), n=pa.array(list(found.values()), pa.int64()))

    counted = cut(map_batches(spread(rows), work, "word string, language string, n bigint").groupBy("word", "language").agg(F.sum("n").alias("n")))
    texts = Counter({r["language"]: r["n"] for r in counted.where("word = ''").collect()}) or None
    words = counted.where("word <> ''").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("language", "n"))).alias("seen"), F.max("n").alias("most"))

    def decide(b: pa.RecordBatch) -> pa.RecordBatch:
        seen = {w: Counter({x["language"]: x["n"] for x in found}) for w, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
        found = voters(seen, texts, LEAST, purity)
        return batch(word=pa.array(list(found), pa.string()), language=pa.array(list(found.values()), pa.string()))

    voting = map_batches(words.where(F.col("most") >= LEAST).select("word", "seen"), decide, "word string, language string")
    return {r["word"]: r["language"] for r in voting.collect()}


def question_votes(rows: DataFrame, lexicon: dict[str, str]) -> dict[str, str]:
    """Words of questions that vote for a language, learnt from the languages of the answers of all ``rows`` (id, question, answer)."""
    return learnt(rows.select(*rows.columns[1:]), lambda pairs: request_words(pairs, lexicon), REQUEST_PURITY)


def defective_answers(pool: DataFrame, name: str, question: str, fields: tuple[str, ...], samples: DataFrame) -> DataFrame:
    """``pool``, ``pair_id``, ``field``, ``defect``: one row per defective answer of the pool.

    Pairs with a null or blank question have no defect; null answers are empty ones.
    Repeated rows give repeated results, other columns are ignored, an empty pool gives
    none.  Without language samples no answer is in another language.
    """
    lexicon = learnt(samples.where("language is not null and text is not null").select("language", "text"), sample_words)
    rows = pool.select("pair_id", question, *fields)
    asked = question_votes(rows.select("pair_id", question, fields[0]), lexicon) | lexicon if lexicon else {}
    judges: list[Judge] = []

    def work(b: pa.RecordBatch) -> pa.RecordBatch | None:
        if not judges:
            judges.append(Judge(lexicon, asked))
        judge = judges[0]
        answers = [b.column(2 + k).to_pylist() for k in range(len(fields))]
        found = []
        for i, q in enumerate(b.column(1).to_pylist()):
            if q is None:
                continue
            question = judge.question(q)
            for k, field in enumerate(fields):
                defect = judge.defect(question, answers[k][i])
                if defect:
                    found.append((i, field, defect))
        if not found:
            return None
        at, field, defect = zip(*found)
        return batch(pool=pa.array([name] * len(at)), pair_id=b.column(0).take(pa.array(at)), field=pa.array(field), defect=pa.array(defect))

    return map_batches(spread(rows), work, f"pool string, pair_id {rows.schema[0].dataType.simpleString()}, field string, defect string")
