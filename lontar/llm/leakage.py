"""Documents that contain passages of held-out test items."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.llm.arrow import batch, map_batches
from lontar.llm.passages import THROWN_IN, PassageIndex
from lontar.plans.runtime import spread

#: Characters of items searched for in one pass; more items mean more passes, in blocks of this size.
BLOCK_CHARS = 4_000_000
SCHEMA = "doc_id {0}, item_id {1}, longest_run int, words_kept int, item_words int"


def leaked_passages(documents: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS, thrown_in: int = THROWN_IN) -> DataFrame:
    """Every pair of a document and an item whose passage it holds, with the evidence.

    The items are the stated query set: they are read in blocks of bounded size
    (by a hash of the id), each block's index is broadcast, and the documents are
    scanned once per block, without a shuffle.  Items without text or of fewer than 8
    words never match, equal items all do; documents without text hold nothing; a
    passage that occurs several times in a document gives one row.  A passage may be interrupted by a line of at most
    ``thrown_in`` words.  An empty table on
    either side gives an empty result.
    """
    rows = spread(documents.select("doc_id", "text"))
    asked = items.select("item_id", "text").where(F.col("text").isNotNull())
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(chars) // block_chars))
    schema = SCHEMA.format(rows.schema[0].dataType.simpleString(), asked.schema[0].dataType.simpleString())
    out = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else asked
        index = documents.sparkSession.sparkContext.broadcast(PassageIndex.build([tuple(r) for r in part.orderBy("item_id").collect()], thrown_in))

        def work(b: pa.RecordBatch, index=index) -> pa.RecordBatch | None:
            found = index.value
            ids = b.column(0).to_pylist()
            cases = [(ids[r], item, run, kept, len(found.items[n])) for r, n, run, kept in found.search(b.column(1).to_pylist()) for item in found.ids[n]]
            if not cases:
                return None
            doc, item, run, kept, size = zip(*cases)
            return batch(doc_id=pa.array(doc, b.column(0).type), item_id=pa.array(item), longest_run=pa.array(run, pa.int32()), words_kept=pa.array(kept, pa.int32()), item_words=pa.array(size, pa.int32()))

        found = map_batches(rows, work, schema)
        out = found if out is None else out.unionByName(found)
    return out
