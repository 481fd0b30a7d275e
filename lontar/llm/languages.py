"""Languages of documents and of their segments, and the labels that are missing or wrong."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.llm.arrow import batch, map_batches
from lontar.llm.boosting import Boosted
from lontar.llm.quality import described, drawn, kinds_of, known_words, train_kinds
from lontar.llm.segments import Segment, Weak, long_languages, main_language, segment_batch, sharpness, softmax, weak_runs
from lontar.llm.spectrum import SpectrumModel
from lontar.plans.runtime import spread

#: Language samples the model is fitted on at most (by a hash of the id).
FIT_SAMPLE = 2_000
#: Texts of fewer words are no case of a wrong label.
LEAST_WORDS = 35

#: Notations of the languages (the part before any region or script, lower case).
NOTATIONS = {
    "en": "en eng english",
    "id": "id ind in indonesian indonesia",
    "ms": "ms msa zsm may zlm malay melayu",
    "jv": "jv jav jw javanese jawa",
    "su": "su sun sundanese sunda",
}
#: Words for an unknown language.
UNKNOWN = ("", "und", "unknown", "unk", "none", "null", "n/a", "na", "-", "?", "xx", "mis", "mul", "other")
BY_NOTATION = {w: code for code, words in NOTATIONS.items() for w in words.split()}


def canonical(label: str | None) -> str | None:
    """The code of a label in any notation; None where it is missing or unknown; other labels as they are."""
    low = (label or "").strip().lower()
    if low in UNKNOWN:
        return None
    return BY_NOTATION.get(low.replace("_", "-").split("-")[0], low)


class LanguageModel:
    """Kernel model, the factor of its confidence and the bounds of weak runs, with the word scores of this worker."""

    def __init__(self, model: SpectrumModel, factor: float, weak: Weak | None = None) -> None:
        self.model, self.factor, self.weak = model, factor, weak
        self._scores = None

    def __getstate__(self):
        return {"model": self.model, "factor": self.factor, "weak": self.weak, "_scores": None}

    @classmethod
    def fit(cls, samples: DataFrame, limit: int = FIT_SAMPLE) -> "LanguageModel":
        """Fitted on two thirds of the samples for the factor and the bounds, on all for the scores."""
        drawn = samples.where("language is not null and text is not null").orderBy(F.xxhash64("sample_id"), "sample_id").limit(limit)
        rows = [tuple(r) for r in drawn.select("language", "text").collect()]
        if len({r[0] for r in rows}) < 2:
            raise ValueError("samples of two languages at least are needed")
        at = max(2, len(rows) * 2 // 3)
        first = SpectrumModel.fit([t for _, t in rows[:at]], [c for c, _ in rows[:at]])
        held = [r for r in rows[at:] if r[0] in first.languages] or rows
        factor = sharpness(first, [t for _, t in held], [c for c, _ in held]) if {c for c, _ in held} <= set(first.languages) else 4.0
        weak = weak_runs(first, [t for _, t in held], [c for c, _ in held])
        return cls(SpectrumModel.fit([t for _, t in rows], [c for c, _ in rows]), factor, weak)

    @property
    def languages(self) -> list[str]:
        return self.model.languages

    def segments(self, texts: list[str | None]) -> list[list[Segment]]:
        if self._scores is None:
            self._scores = self.model.scorer()
        return segment_batch(texts, self._scores, self.factor, self.weak)


def document_segments(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per single-language segment: ``doc_id``, ``segment``, ``language``, ``first_word``, ``words``, ``confidence``.

    A document in one language is one segment; texts without words have none.
    """
    model = LanguageModel.fit(samples)
    rows = documents.select("doc_id", "text")

    def work(b: pa.RecordBatch) -> pa.RecordBatch | None:
        per = model.segments(b.column(1).to_pylist())
        flat = [(i, k, s) for i, x in enumerate(per) for k, s in enumerate(x)]
        if not flat:
            return None
        return batch(
            doc_id=b.column(0).take(pa.array([i for i, _, _ in flat])), segment=pa.array([k for _, k, _ in flat], pa.int32()), language=pa.array([model.languages[s.language] for _, _, s in flat]),
            first_word=pa.array([s.first_word for _, _, s in flat], pa.int32()), words=pa.array([s.words for _, _, s in flat], pa.int32()), confidence=pa.array([round(s.confidence, 6) for _, _, s in flat]),
        )

    return map_batches(spread(rows), work, f"doc_id {rows.schema[0].dataType.simpleString()}, segment int, language string, first_word int, words int, confidence double")


def document_languages(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """``doc_id``, ``language`` (of most words), ``confidence``, ``share`` of that language's words, ``languages`` of long segments.

    Texts without words have a null language and confidence, and no languages.
    """
    model = LanguageModel.fit(samples)
    rows = documents.select("doc_id", "text")

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        language, sure, share, long = [], [], [], []
        for x in model.segments(b.column(1).to_pylist()):
            if not x:
                language.append(None), sure.append(None), share.append(None), long.append([])
                continue
            top = main_language(x, len(model.languages))
            words = sum(s.words for s in x)
            chance = softmax(np.stack([s.mean for s in x]) * model.factor)[:, top]
            language.append(model.languages[top])
            sure.append(round(float(sum(c * s.words for c, s in zip(chance, x))) / words, 6))
            share.append(round(sum(s.words for s in x if s.language == top) / words, 6))
            long.append([model.languages[k] for k in long_languages(x)])
        return batch(doc_id=b.column(0), language=pa.array(language, pa.string()), confidence=pa.array(sure, pa.float64()), share=pa.array(share, pa.float64()), languages=pa.array(long, pa.list_(pa.string())))

    return map_batches(spread(rows), work, f"doc_id {rows.schema[0].dataType.simpleString()}, language string, confidence double, share double, languages array<string>")


def wrong_labels(documents: DataFrame, samples: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``language``: a row for each language of a document whose label is missing or wrong, or that mixes languages.

    Documents of fewer than 35 words and lists, tables, junk and code are no cases;
    the kind is looked at only where the label or a second language calls for it.
    """
    model = LanguageModel.fit(samples)
    common = known_words(samples)
    kinds: Boosted | None = train_kinds(described(drawn(documents, labels), common), labels)
    rows = documents.select("doc_id", "text", "lang")

    def work(b: pa.RecordBatch) -> pa.RecordBatch | None:
        texts, marks = b.column(1).to_pylist(), b.column(2).to_pylist()
        found: list[tuple[int, list[int]]] = []
        for i, x in enumerate(model.segments(texts)):
            if sum(s.words for s in x) < LEAST_WORDS or len(texts[i].split()) < LEAST_WORDS:
                continue
            top = main_language(x, len(model.languages))
            long = long_languages(x)
            if long and (canonical(marks[i]) != model.languages[top] or len(long) > 1):
                found.append((i, long))
        if found and kinds is not None:
            kind, _ = kinds_of([texts[i] for i, _ in found], kinds, common)
            found = [f for f, k in zip(found, kind) if k == 0]
        cases = [(i, model.languages[k]) for i, long in found for k in long]
        if not cases:
            return None
        return batch(doc_id=b.column(0).take(pa.array([i for i, _ in cases])), language=pa.array([x for _, x in cases]))

    return map_batches(spread(rows), work, f"doc_id {rows.schema[0].dataType.simpleString()}, language string")
