"""Text statistics of documents and the kind of each: prose, list, table, junk or code."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lontar.llm.arrow import batch, map_batches
from lontar.llm.boosting import Boosted, JobRows, Rows, grid_keys
from lontar.llm.textstats import COMMON, NAMES, language_words, matrix
from lontar.plans.runtime import broadcast_small, cut, spread

#: A word is common in a language if it stands in at least this share of the language's samples.
COMMON_SHARE = 0.1
KINDS = ("prose", "list", "table", "junk", "code")
#: Weakly labelled documents up to which the trees grow on the driver, from a byte a column; beyond, by a job a level. All count in either case.
DRIVER_ROWS = 200_000
#: Where the kind only filters other findings: documents (about so many, by a hash of the id) and hand-labelled ones of which it is learnt.
WEAK_SAMPLE, HAND_SAMPLE = 5_000, 12_000


def known_words(samples: DataFrame | None) -> frozenset[str]:
    """The base and the words common in any language, counted over all language samples; the base without samples."""
    if samples is None:
        return COMMON
    rows = samples.where("language is not null and text is not null").select("language", "text")

    def work(b: pa.RecordBatch) -> pa.RecordBatch | None:
        found = language_words(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
        if not found:
            return None
        return batch(language=pa.array([x for x, _ in found]), word=pa.array([w for _, w in found]), n=pa.array(list(found.values()), pa.int64()))

    counted = map_batches(spread(rows), work, "language string, word string, n bigint").groupBy("language", "word").agg(F.sum("n").alias("n"))
    totals = broadcast_small(rows.groupBy("language").agg(F.count("*").alias("texts")))
    common = counted.join(totals, "language").where(F.col("n") >= F.greatest(F.lit(3.0), F.lit(COMMON_SHARE) * F.col("texts")))
    return COMMON | {w for (w,) in common.select("word").distinct().collect()}


def text_statistics(documents: DataFrame, samples: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the columns of ``textstats.NAMES``; null, empty and blank texts have zeros."""
    common = known_words(samples)
    rows = documents.select(F.col(id_col), F.col(text_col))
    kind = rows.schema[0].dataType.simpleString()

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(b.column(1).to_pylist(), common)
        return batch(id=b.column(0), **{n: pa.array(x[:, i]) for i, n in enumerate(NAMES)})

    return map_batches(spread(rows), work, ", ".join([f"`{id_col}` {kind}", *(f"{n} double" for n in NAMES)]))


def weak_kinds(x: np.ndarray) -> np.ndarray:
    """Kinds by plain rules on the statistics, -1 where no rule is sure; of two rules the later counts."""
    c = {n: x[:, i] for i, n in enumerate(NAMES)}
    y = np.full(len(x), -1)
    lines, words = np.expm1(c["log_lines"]), np.expm1(c["log_words"])
    few_ends, few_lines, long = c["end_mark_share"] < 0.2, lines < 5, words > 1_000
    worded = (c["common_share"] > 0.12) & (c["letter_share"] > 0.75) & (c["odd_share"] < 0.02)
    prose = [
        (c["end_mark_share"] > 0.7) & (c["common_share"] > 0.15) & (c["pair_share"] > 0.6) & (c["symbol_share"] < 0.1) & (c["short_line_share"] < 0.4) & (c["code_line_share"] < 0.2),
        worded & few_lines & (c["pair_share"] > 0.8) & (words > 40) & (c["column_share"] < 0.5),
        # the longer a text, the more of its pairs come again
        worded & long & (c["type_share"] < 0.5) & ((c["sentences_words"] > 0.02) & (c["short_line_share"] < 0.5) | few_lines & (c["pair_share"] > 0.1)),
        worded & few_lines & (words > 40) & (c["pair_share"] > 0.65) & (c["entry_share"] == 0) & (c["top_word_share"] < 0.15) & (c["common_share"] > 0.2) & (c["type_share"] > 0.45),
        # sentences on wrapped lines
        worded & (c["sentences_words"] > 0.03) & (c["sentences_words"] < 0.25) & (c["pair_share"] > 0.8) & (c["capital_line_share"] < 0.6) & (c["marker_share"] < 0.1) & (c["column_share"] < 0.5) & (c["code_line_share"] < 0.3),
        (c["end_mark_share"] >= 1) & (lines < 3) & (words >= 5) & (words < 60) & (c["pair_share"] > 0.9) & (c["letter_share"] > 0.75) & (c["odd_share"] < 0.02) & (c["log_longest_run"] < np.log1p(40)),
        # some sentences with an address or a heading
        (c["end_mark_share"] > 0.4) & (c["common_share"] > 0.1) & (c["pair_share"] > 0.8) & (c["short_line_share"] < 0.7) & (c["code_line_share"] < 0.2) & (c["marker_share"] < 0.3) & (c["column_share"] < 0.6) & (lines < 6),
    ]
    lists = [
        (c["marker_share"] > 0.85) & (lines >= 6) & few_ends & (c["short_line_share"] > 0.8) & (c["code_line_share"] < 0.3),
        # entries without marks: short lines, hardly a sentence, mostly of several words, each line its own
        (c["entry_share"] > 0.85) & few_ends & (lines >= 6) & (c["line_type_share"] > 0.6) & (c["column_share"] < 0.5) & (c["letter_share"] > 0.75) & (c["code_line_share"] < 0.2)
        & (c["colon_share"] < 0.1) & (c["quote_line_share"] < 0.1) & (c["one_word_line_share"] < 0.3) & (c["common_share"] > 0.02) & (c["sentences_words"] < 0.02),
        # the same with one comma or number in each
        (c["entry_share"] > 0.95) & (lines >= 6) & (c["line_type_share"] > 0.8) & (c["columns"] < np.log1p(1.5)) & (c["letter_share"] > 0.7) & (c["code_line_share"] < 0.2)
        & (c["quote_line_share"] < 0.1) & (c["one_word_line_share"] < 0.3) & (c["comma_word_share"] > 0.05) & (c["comma_end_share"] < 0.5),
    ]
    tables = [(c["column_share"] > 0.95) & (c["columns"] > 1) & (lines >= 5) & few_ends & (c["marker_share"] < 0.3) & (c["code_line_share"] < 0.4)]
    code = [(c["code_line_share"] > 0.6) & (lines >= 4) & (c["common_share"] < 0.3), (c["code_line_share"] > 0.4) & (lines >= 4) & (c["symbol_share"] > 0.12) & (c["marker_share"] < 0.5)]
    junk = [
        (c["letter_share"] < 0.3) & (c["digit_share"] < 0.4) & (c["code_line_share"] < 0.3) & (c["column_share"] < 0.5),
        (c["letter_share"] < 0.1) & few_lines & (np.expm1(c["log_chars"]) > 100),
        c["odd_share"] > 0.15,
        (c["pair_share"] < 0.3) & (words > 40) & ~long & (few_lines | (c["packed_share"] < 0.15)),
        (c["pair_share"] < 0.02) & long,
        # the same few words over and over, between few or no function words
        (c["pair_share"] < 0.6) & (words > 40) & ~long & few_lines & (c["common_share"] < 0.12),
        (c["type_share"] < 0.3) & (c["pair_share"] < 0.75) & (words > 40) & (words < 200) & few_lines & (c["sentences_words"] < 0.03),
        # letters without any function word, on lines too long for entries
        (c["common_share"] < 0.02) & (words > 25) & (c["short_line_share"] < 0.5) & (c["code_line_share"] < 0.3) & (few_lines | (c["column_share"] < 0.5)),
        (c["log_longest_run"] > np.log1p(150)) & (words < 60),
    ]
    for kind, rules in ((0, prose), (1, lists), (2, tables), (4, code), (3, junk)):
        for rule in rules:
            y[rule] = kind
    return y


def described(documents: DataFrame, common: frozenset[str] = COMMON) -> DataFrame:
    """``doc_id`` and ``x``, the statistics as bytes, of every document, written down once."""
    rows = documents.select("doc_id", "text")

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        return batch(doc_id=b.column(0), x=pa.array([x.tobytes() for x in matrix(b.column(1).to_pylist(), common)], pa.binary()))

    return cut(map_batches(spread(rows), work, f"doc_id {rows.schema[0].dataType.simpleString()}, x binary"))


def unpacked(x: pa.Array, width: int = len(NAMES)) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pylist())).reshape(-1, width)


def hand_kinds(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``kind``: of contradicting labels of a document the most frequent, of ties the first in the alphabet."""
    votes = labels.where(F.col("doc_id").isNotNull() & F.col("kind").isin(*KINDS)).groupBy("doc_id", "kind").count()
    order = Window.partitionBy("doc_id").orderBy(F.desc("count"), "kind")
    return votes.withColumn("r", F.row_number().over(order)).where("r = 1").select("doc_id", "kind")


def drawn(documents: DataFrame, labels: DataFrame, weak_sample: int = WEAK_SAMPLE, hand_sample: int = HAND_SAMPLE) -> DataFrame:
    """``doc_id`` and ``text`` of a bounded draw of documents by a hash of the id, and of hand-labelled ones."""
    share = max(1, documents.count() // max(1, weak_sample))
    h = F.xxhash64("doc_id", F.lit("kinds"))
    hand = hand_kinds(labels).orderBy(h, "doc_id").limit(hand_sample)
    return documents.select("doc_id", "text").join(F.broadcast(hand), "doc_id", "left").where(F.col("kind").isNotNull() | (F.pmod(h, F.lit(share)) == 0)).select("doc_id", "text")


def train_kinds(rows: DataFrame, labels: DataFrame) -> Boosted | None:
    """Boosted trees on statistics of weakly labelled documents, calibrated on the hand-labelled ones, which are held out from training.

    All ``rows`` (of ``described``) that the weak rules label train, and all hand labels calibrate; bins are quantiles of all training rows.
    Labels without an id or kind are dropped; of contradicting labels of a document
    the most frequent counts, of ties the first in the alphabet.  Where the weak rules know fewer than two kinds, the hand
    labels train as well.  Returns None where nothing can be learnt from (no documents).
    """
    taught = rows.join(broadcast_small(cut(hand_kinds(labels))), "doc_id", "left").select("kind", "x")

    def answers(b: pa.RecordBatch, hand_too: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Statistics, kinds to train on and kinds by hand, -1 where there is none."""
        x = unpacked(b.column(1))
        y = np.array([KINDS.index(k) if k else -1 for k in b.column(0).to_pylist()])
        blank = x[:, 0] == 0
        hand = np.where(blank, -1, y)
        weak = np.where((hand >= 0) | blank, -1, weak_kinds(x))
        return x, np.where(hand >= 0, hand, weak) if hand_too else weak, hand

    def tally(hand_too: bool) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Training rows by kind, and by cell of each column."""

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            x, y, _ = answers(b, hand_too)
            x, y = x[y >= 0], y[y >= 0]
            counted = [np.unique(k, return_counts=True) for k in (y, *grid_keys(x).T)]
            column = np.repeat(np.arange(len(counted)), [len(k) for k, _ in counted])
            return batch(column=pa.array(column, pa.int32()), key=pa.array(np.concatenate([k for k, _ in counted]), pa.int32()), n=pa.array(np.concatenate([n for _, n in counted]), pa.int64()))

        got = map_batches(taught, work, "column int, key int, n bigint").groupBy("column", "key").agg(F.sum("n").alias("n")).toArrow()
        column, key, n = (got[c].to_numpy() for c in ("column", "key", "n"))
        of = [(key[column == i], n[column == i]) for i in range(1 + len(NAMES))]
        return np.bincount(*of[0], len(KINDS)).astype(float), of[1:]

    hand_too = False
    kinds, cells = tally(hand_too)
    if (kinds > 0).sum() < 2:
        hand_too = True
        kinds, cells = tally(hand_too)
    if not kinds.sum():
        return None
    model = Boosted().cuts(cells)

    def bins(b: pa.RecordBatch) -> pa.RecordBatch:
        x, y, _ = answers(b, hand_too)
        return batch(y=pa.array(y[y >= 0], pa.int32()), b=pa.array([r.tobytes() for r in model.binned(x[y >= 0])], pa.binary()))

    binned = map_batches(taught, bins, "y int, b binary")
    if kinds.sum() <= DRIVER_ROWS:
        # in the order of their contents, so that sums don't depend on the files
        got = binned.toArrow().sort_by([("b", "ascending"), ("y", "ascending")])
        model.grow(Rows(np.frombuffer(b"".join(got["b"].to_pylist()), np.uint8).reshape(-1, len(NAMES)), got["y"].to_numpy(), len(KINDS)))
    else:
        model.grow(JobRows(cut(binned), kinds, len(NAMES)))

    def scores(b: pa.RecordBatch) -> pa.RecordBatch | None:
        x, _, hand = answers(b, hand_too)
        at = hand >= 0
        return batch(y=pa.array(hand[at], pa.int32()), raw=pa.array([r.tobytes() for r in model.raw(x[at])], pa.binary())) if at.any() else None

    by_hand = map_batches(taught.where("kind is not null"), scores, "y int, raw binary").toArrow().sort_by([("raw", "ascending"), ("y", "ascending")])
    return model.calibrate_raw(unpacked(by_hand["raw"], len(KINDS)), by_hand["y"].to_numpy()) if by_hand.num_rows >= 20 else model


def judged(x: np.ndarray, model: Boosted) -> tuple[np.ndarray, np.ndarray]:
    """Kind numbers (-1 for blank texts) and their calibrated probabilities, by statistics."""
    p = model.probabilities(x)
    kind = p.argmax(1) if len(p) else np.zeros(0, np.int64)
    return np.where(x[:, 0] == 0, -1, kind), p.max(1) if len(p) else np.zeros(0)


def kinds_of(texts: list[str | None], model: Boosted, common: frozenset[str] = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Kind numbers (-1 for blank texts) and their calibrated probabilities."""
    return judged(matrix(texts, common), model)


def document_kinds(documents: DataFrame, labels: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``kind`` and ``probability`` of every document.

    Null, empty and blank texts have a null kind and probability.  Where nothing
    can be learnt from, all kinds are null.
    """
    rows = described(documents, known_words(samples))
    model = train_kinds(rows, labels)
    schema = f"doc_id {rows.schema[0].dataType.simpleString()}, kind string, probability double"
    if model is None:
        return rows.select("doc_id", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("probability"))

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        kind, p = judged(unpacked(b.column(1)), model)
        return batch(doc_id=b.column(0), kind=pa.array([KINDS[k] if k >= 0 else None for k in kind], pa.string()), probability=pa.array(np.round(p, 6), mask=kind < 0))

    return map_batches(rows, work, schema)


def structural(documents: DataFrame, labels: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """The documents that are a list, a table or junk: ``doc_id``, ``kind``."""
    return document_kinds(documents, labels, samples).where(F.col("kind").isin("list", "table", "junk")).select("doc_id", "kind")
