"""From raw documents to packed training sequences, one written table after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm.bagminhash import near_duplicates
from offerlens.llm.linedup import SOLID, dedup_lines
from offerlens.llm.mixing import weighted_fair_mix
from offerlens.llm.packing import pack
from offerlens.llm.queries import prepare, split_of, table, tokenizer_file
from offerlens.llm.toxicity import fit_toxicity, without_toxic
from offerlens.plans.session import tune
from offerlens.plans.store import stored

#: The packing order follows a hash that SQL engines do not share.
ORACLE_SQL = None


def _ready(spark: SparkSession) -> SparkSession:
    return prepare(tune(spark))


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows as one struct, with a key of id and text; equal keys mean equal documents."""
    text_hash = F.xxhash64("text")
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.xxhash64("doc_id", text_hash).alias("_key"), text_hash.alias("_hash"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.3; a null or empty text stays."""
    _ready(spark)
    labels = table(spark, sf_dir, "labels").where(split_of(4) != 2).select("doc_id", "toxic")
    return without_toxic(docs, fit_toxicity(docs.select("doc_id", "text"), labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the later copies of repeated runs of lines, of any length from one line on.

    A document that loses its last visible line goes; one that had none before stays.
    ``n_chars``, where there is such a column, follows the new text.
    """
    _ready(spark)
    told = dedup_lines(docs, min_lines=1)
    left = told.where((F.col("_n_removed") == 0) | F.coalesce(F.col("text").rlike(SOLID), F.lit(False)))
    if "n_chars" in docs.columns:
        size = F.when(F.col("_n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id.

    Rows of equal id and text are one document and leave one row; texts without a word are
    no copies of each other.
    """
    _ready(spark)
    found = near_duplicates(docs.select("doc_id", "text"))
    first = found.groupBy("_class").agg(F.min(F.struct("_id", "_h")).alias("_first"))
    kept = first.select(F.xxhash64("_first._id", "_first._h").alias("_key"), F.col("_first._h").alias("_hash"))
    rows = _keyed(docs).join(kept, ["_key", "_hash"]).groupBy("_key", "_hash").agg(F.first("_row").alias("_row"))
    return rows.select("_row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them whole: never, once or twice.

    Texts without a word have no size, so no mix can take them: they stay once.
    """
    _ready(spark)
    told = weighted_fair_mix(docs.select("doc_id", "text", "source"))
    times = F.when(F.col("size") == 0, F.lit(1).cast("bigint")).otherwise(F.col("passes"))
    passes = told.select(F.xxhash64("doc_id", "text_hash").alias("_key"), F.col("text_hash").alias("_hash"), times.alias("_times"))
    passes = passes.groupBy("_key", "_hash").agg(F.sum("_times").cast("int").alias("_times")).where("_times > 0")
    rows = _keyed(docs).groupBy("_key", "_hash").agg(F.first("_row").alias("_row")).join(passes, ["_key", "_hash"])
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; every token lies in one piece."""
    _ready(spark)
    return pack(docs.select("doc_id", "text", "source"), tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
