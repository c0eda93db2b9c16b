"""BPE encoding and decoding of whole texts over DataFrames.

Each batch of texts is cut at forced boundaries (:mod:`.forced_bpe`), the fragments are encoded
independently and concatenated, so the work is one narrow pass: no shuffle, memory by batches of
about half a megabyte of text (one text at least).

Null and empty texts have no ids and decode to the empty text; null ids decode to null, null
elements and ids that the file does not have to nothing, bytes that are no UTF-8 to U+FFFD.
Repeated rows are encoded as often as they occur, empty tables stay empty, and columns may have
any names: those of ``keep`` are returned, others ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import fresh, named, sliced
from .forced_bpe import byte_bpe

#: Ids that are decoded at once (a longer list is decoded by itself).
MOST_IDS = 1 << 17


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", ids_col: str = "ids", special: bool = True) -> DataFrame:
    """The columns ``keep`` and the ids of each text; ``special``: strings of special tokens are those tokens."""
    k = len(keep)
    src = docs.select(*map(named, keep), named(text_col).alias(fresh("text", list(keep))))
    schema = StructType([*src.schema.fields[:k], StructField(ids_col, ArrayType(IntegerType(), False), False)])

    def run(batches):
        import pyarrow as pa

        for b in sliced(batches, k, 1 << 19):
            ids, counts = byte_bpe(path, special).encode([t or "" for t in b.column(k).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids, pa.int32()))], schema.names)

    return src.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The columns ``keep`` and the text that each list of ids stands for, special tokens included."""
    k = len(keep)
    src = encoded.select(*map(named, keep), named(ids_col).cast("array<int>").alias(fresh("ids", list(keep))))
    schema = StructType([*src.schema.fields[:k], StructField(text_col, StringType())])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            part = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(k)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // MOST_IDS
            cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for b in (batch.slice(at, end - at) for at, end in zip(cut, cut[1:]) if end > at):
                lists = b.column(k)
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
                texts = byte_bpe(path).decode(ids, counts)
                yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array([t if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist())], pa.string())], schema.names)

    return src.mapInArrow(run, schema)
