"""Language identification by compression with one dictionary per language."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from offerlens.llm.sampling import place, under_quota
from offerlens.operators.scale import top_per_group

UNKNOWN = "und"


def language_dictionaries(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = 32 << 10, most_from_one: int = 1 << 10, rows: int = 200
) -> dict[str, bytes]:
    """Raw dictionary content per language, from a bounded sample of labelled rows.

    The ``rows`` different texts of a language with the smallest hash are looked at; each
    gives at most ``most_from_one`` characters, from a place that another hash chooses, and
    together they fill ``size`` bytes. Copies of a text count once. So the driver
    receives ``size`` bytes for each language, whatever the number of rows. The words are
    shuffled: a dictionary that held whole passages would win every copy of one of them,
    whatever its language. Languages come in the order of their rows, the largest first.
    """
    text = F.col(text_col)
    known = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    known = known.select(F.col(lang_col).cast("string").alias("_lang"), text.alias("_whole"), F.xxhash64(text).alias("_o"))
    totals = known.groupBy("_lang", "_o").count().groupBy("_lang").agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("texts"))
    totals = totals.orderBy(F.desc("count"), "_lang").collect()
    if not totals:
        return {}
    number = F.create_map(*[F.lit(x) for r in totals for x in (r["_lang"], r["texts"])])[F.col("_lang")]
    start = F.pmod(F.xxhash64("_whole", F.lit(1)), F.greatest(F.length("_whole") - most_from_one + 1, F.lit(1))).cast("int") + 1
    sample = known.where(under_quota(F.col("_o"), rows, number))
    sample = sample.select("_lang", "_o", F.lower(F.substring("_whole", start, F.lit(most_from_one))).alias("_text"))
    sample = sample.groupBy("_lang", "_o").agg(F.min("_text").alias("_text"))
    sample = top_per_group(sample, ["_lang"], [place(F.col("_o")), F.col("_text")], rows, "_rank")
    filled = F.sum(F.octet_length("_text")).over(Window.partitionBy("_lang").orderBy("_rank"))
    sample = sample.withColumn("_filled", filled).where((F.col("_filled") <= size) | (F.col("_rank") == 1))
    chosen: dict[str, set[str]] = {}
    for row in sample.select("_lang", "_rank", "_text").orderBy("_lang", "_rank").collect():
        chosen.setdefault(row["_lang"], set()).add(row["_text"])
    out = {}
    for lang in [r["_lang"] for r in totals if r["_lang"] in chosen]:
        words = [w for t in sorted(chosen[lang]) for w in t.split()]
        random.Random(len(words)).shuffle(words)
        out[lang] = " ".join(words).encode()[-size:]
    return out


class Compressors:
    """Compressed sizes of a text under every dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int, block: int):
        import zstandard

        self.langs, self.block, self.made = list(dictionaries), block, []
        for lang in self.langs:
            held = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            self.made.append(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, data: bytes) -> list[int]:
        """Blocks are compressed apart: a long text would else become its own dictionary."""
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.made]


def predict_language(
    docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text",
    min_margin: float = 0.01, level: int = 6, block: int = 4 << 10,
) -> DataFrame:
    """Language of every whole text: the dictionary under which it becomes smallest.

    ``lang_pred`` is the winner (ties go to the language with more rows), ``margin`` the share of the
    runner-up's size that it saves, ``score`` the winner's part of a softmax over the sizes,
    ``rejected`` is true where the margin is under ``min_margin``: too close to call. A text
    that is null or has no letter is ``und`` with score 0 and rejected; so is every text
    when there is no dictionary. With one language the margin is 1. Repeated rows are judged
    one by one; an empty table gives an empty result; other columns are ignored.
    """
    given = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = StructType([
        StructField(id_col, given.schema["_id"].dataType), StructField("lang_pred", StringType()), StructField("score", DoubleType()),
        StructField("margin", DoubleType()), StructField("rejected", BooleanType()), StructField("compressed", LongType()),
    ])

    def judge(text: str | None, tools: Compressors) -> tuple[str, float, float, bool, int]:
        if text is None or not tools.made or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0, True, 0
        sizes = np.array(tools.sizes(text.lower().encode()), float)
        best = int(np.argmin(sizes))
        if len(sizes) == 1:
            return tools.langs[0], 1.0, 1.0, False, int(sizes[0])
        second = np.partition(sizes, 1)[1]
        margin = float((second - sizes[best]) / second)
        parts = np.exp(-(sizes - sizes[best]) / (1.0 + 0.02 * sizes[best]))
        return tools.langs[best], float(1 / parts.sum()), margin, margin < min_margin, int(sizes[best])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Compressors(dictionaries, level, block)
        for batch in batches:
            found = [judge(t, tools) for t in batch.column(1).to_pylist()]
            columns = list(zip(*found)) or [()] * 5
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=out.fieldNames())

    return given.mapInArrow(predict, out)
