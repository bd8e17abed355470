"""Token counts of whole texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_bytes`` and ``n_tokens`` of every row, without special or added tokens.

    Only lengths leave the Arrow function. Inside it a batch is dealt into groups of about
    equal bytes, and a text longer than 64 Ki characters that goes to the library is cut at
    places no token can cross. A null text counts as empty; repeated rows are counted one
    by one; an empty table gives an empty result; other columns are ignored. The path must
    name the tokenizer's file on every executor.
    """
    given = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = StructType([StructField(id_col, given.schema["_id"].dataType), StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from offerlens.llm.tokens import encoder

        coder = encoder(tokenizer_path, "counts")
        for batch in batches:
            texts = batch.column(1).fill_null("")
            n_bytes = pa.compute.binary_length(texts).cast(pa.int64())
            n_tokens = pa.array(coder.counts(texts.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n_tokens], names=[id_col, "n_bytes", "n_tokens"])

    return given.mapInArrow(count, out)
