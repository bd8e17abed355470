"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm.sql import MERKLE_SQL, SUFFIX_SQL, vector_codes_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches: a batch of very long texts still fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), solid AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), ranked AS (
  SELECT doc_id, j, row_number() OVER (PARTITION BY line ORDER BY doc_id, j) AS copy FROM solid
), gone AS (
  SELECT doc_id, j FROM ranked WHERE copy > 1
), pairs AS (
  SELECT b.doc_id, b.j, a.doc_id AS earlier, b.j - a.j AS shift FROM solid b JOIN solid a ON a.line = b.line AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.j < b.j)
), stretches AS (
  SELECT *, j - row_number() OVER (PARTITION BY doc_id, earlier, shift ORDER BY j) AS stretch FROM pairs
), common AS (
  SELECT doc_id, j, row_number() OVER (PARTITION BY doc_id, earlier, shift, stretch ORDER BY j DESC) AS n FROM stretches
), longest AS (
  SELECT doc_id, j, max(n) AS n FROM common GROUP BY doc_id, j
), runs AS (
  SELECT l.doc_id, count(*) AS n_runs, max(l.n) AS longest_run FROM longest l LEFT JOIN longest p ON p.doc_id = l.doc_id AND p.j = l.j - 1
  WHERE p.n IS NULL OR p.n <= l.n GROUP BY l.doc_id
), marked AS (
  SELECT l.doc_id, l.i, l.line, g.j IS NOT NULL AS removed
  FROM lines l LEFT JOIN solid s ON s.doc_id = l.doc_id AND s.i = l.i LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.j = s.j
), told AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT removed), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256,
       coalesce(n_runs, 0) AS n_runs, coalesce(longest_run, 0) AS longest_run
FROM documents d LEFT JOIN told USING (doc_id) LEFT JOIN runs USING (doc_id)
"""


@query("op5_line_dedup", LINE_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from offerlens.llm.linedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
        F.coalesce(F.array_size("_copies"), F.lit(0)).cast("bigint").alias("n_runs"),
        F.coalesce(F.array_max(F.transform("_copies", lambda c: c["length"])), F.lit(0)).cast("bigint").alias("longest_run"),
    )


@query("op9_mix_sources")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from offerlens.llm.mixing import weighted_fair_mix

    return weighted_fair_mix(table(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file; every executor has the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_pack")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from offerlens.llm.packing import pack

    out = pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from offerlens.llm.tokencount import count_tokens

    out = count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from offerlens.llm.quality import language_references, quality_rules

    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, language_references(docs))


def split_of(parts: int) -> Column:
    """Remainder of the id's checksum: decides which rows are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


@query("op2_language")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from offerlens.llm.langid import language_dictionaries, predict_language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict_language(docs, language_dictionaries(docs.where(split_of(5) != 0)))
    return found.select("doc_id", F.coalesce(split_of(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from offerlens.llm.toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(split_of(4) != 2).select("doc_id", "toxic")
    found = score_toxicity(docs, fit_toxicity(docs, labels))
    return found.select(
        "doc_id", F.coalesce(split_of(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query("op7_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from offerlens.llm.bagminhash import near_duplicates

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs)
    # A class carries the smallest id of its documents.
    names = found.groupBy("_class").agg(F.min("_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return found.join(names, "_class").select(F.col("_id").alias("doc_id"), "class_id", "class_size", F.col("_links").alias("n_links"))


@query("op10_nearest_neighbours")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from offerlens.llm.ann import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op8_substring_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from offerlens.llm.substring import repeated_windows

    return repeated_windows(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op13_merkle_manifest", MERKLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from offerlens.llm.merkle import document_leaves, merkle_manifest, proofs

    docs = table(spark, sf_dir, "documents")
    shown = {"text": F.regexp_replace("text", "\n", "")}
    leaves = document_leaves(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", shown, F.coalesce(split_of(2) == 0, F.lit(False)))
    found = proofs(merkle_manifest(leaves, ["_id"]), "_shown")
    return found.select(
        F.col("_id").alias("doc_id"), F.lower(F.hex("_leaf")).alias("leaf"), "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query("op11_vector_codes", vector_codes_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from offerlens.llm.vectorcodes import code_text, encode, fit_codebooks, with_group_error

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = fit_codebooks(vectors)
    found = with_group_error(encode(vectors, books), "label", "label_error")
    return found.select(
        "vec_id", code_text(F.col("_codes")).alias("code"), F.col("_error").alias("error"), "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256")
    )


@query("op12_suffix_dedup", SUFFIX_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from offerlens.llm.suffixdedup import without_repeats

    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
