"""Token ids and exact token counts of whole corpora."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.llm.arrow import batch, map_batches
from lontar.llm.bpe import encoder, piece_counts, pretokens, tokenizer_path
from lontar.plans.runtime import spread

#: Characters from which a text is cut into chunks that are counted by different workers.
CHUNK_CHARS = 16_384


def encode_ids(documents: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (a list of integers, without special tokens) of every row.

    Null and empty texts have the empty list; blank texts are encoded like any
    other.  Strings of special tokens are ordinary text.  Other columns of the
    input are ignored, repeated rows give repeated results.
    """
    path = path or tokenizer_path()

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        get = encoder(path).__getitem__
        values, sizes = [], []
        for text in b.column(1).to_pylist():
            ids = np.fromiter(chain.from_iterable(map(get, pretokens(text))), np.int32) if text else np.zeros(0, np.int32)
            values.append(ids)
            sizes.append(len(ids))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return batch(id=b.column(0), ids=pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values))))

    rows = documents.select(F.col(id_col), F.col(text_col))
    kind = rows.schema[0].dataType.simpleString()
    return map_batches(spread(rows), work, f"`{id_col}` {kind}, ids array<int>")


def chunks(text: str = "text", size: int = CHUNK_CHARS):
    """A column of the parts of a text, cut only where the tokenizer cannot join.

    A pre-token never holds a blank after a character that is none, so the place
    between them is a boundary whatever follows; a part has at least ``size``
    characters and runs on to the next such place.  A text without one stays whole.
    """
    return F.regexp_extract_all(F.col(text), F.lit(rf"(?U)(?s).{{{size}}}\s*+\S*+|.+"), F.lit(0))


def count_tokens(documents: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``id_col`` and ``n_tokens`` of every row; null and empty texts have 0.

    Short texts are counted where they are read.  Oversized ones are cut at proven
    boundaries, their chunks are spread over the workers by a salt, and the exact
    counts of a document's chunks are added up, so that one huge text doesn't keep one
    worker busy.  Ids are expected to be unique; rows that share an id are counted
    separately when short and added up when oversized.
    """
    path = path or tokenizer_path()

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        count = piece_counts(path).count
        return batch(id=b.column(0), n=pa.array([count(t) if t else 0 for t in b.column(1).to_pylist()], pa.int64()))

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    schema = f"id {kind}, n bigint"
    long = F.coalesce(F.length("text"), F.lit(0)) > 2 * chunk_chars
    short = map_batches(spread(rows).where(~long), work, schema)
    parts = rows.where(long).select("id", F.posexplode(chunks(size=chunk_chars)).alias("part", "text"))
    salted = parts.repartition(F.xxhash64("id", "part")).select("id", "text")
    counted = map_batches(salted, work, schema).groupBy("id").agg(F.sum("n").alias("n"))
    return short.unionByName(counted).select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"))
