"""Every operator on odd rows and on an empty table: defined results, no crash."""

import pytest
from data import SCHEMA, odd_rows
from pyspark.sql import functions as F

import corpus_pipeline
from offerlens.llm.ann import nearest_neighbours
from offerlens.llm.bagminhash import near_duplicates
from offerlens.llm.langid import language_dictionaries, predict_language
from offerlens.llm.linedup import dedup_lines
from offerlens.llm.mixing import weighted_fair_mix
from offerlens.llm.packing import pack
from offerlens.llm.quality import language_references, quality_rules
from offerlens.llm.queries import prepare, tokenizer_file
from offerlens.llm.substring import repeated_windows
from offerlens.llm.tokencount import count_tokens
from offerlens.llm.toxicity import fit_toxicity, score_toxicity, without_toxic

BYTE, WORD = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")


@pytest.fixture(params=["odd", "empty"])
def docs(spark, request):
    prepare(spark)
    return spark.createDataFrame(odd_rows() if request.param == "odd" else [], SCHEMA)


def labels(spark, n=0):
    return spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, toxic int")


def test_one_row_per_row(spark, docs):
    n = docs.count()
    for found in (
        predict_language(docs, language_dictionaries(docs)), score_toxicity(docs, fit_toxicity(docs, labels(spark))), quality_rules(docs, language_references(docs)),
        count_tokens(docs, WORD), repeated_windows(docs), weighted_fair_mix(docs), dedup_lines(docs), near_duplicates(docs),
    ):
        assert len(found.collect()) == n


def test_unknown_language_and_score(spark, docs):
    rows = predict_language(docs, language_dictionaries(docs)).collect()
    known = {r["doc_id"]: r for r in rows}
    if rows:
        assert known[0]["lang_pred"] == known[1]["lang_pred"] == known[2]["lang_pred"] == "und"
        assert known[4]["lang_pred"] in ("en", "")
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in predict_language(docs, {}).collect()} <= {"und"}


def test_toxicity_without_labels_rejects_nothing(spark, docs):
    model = fit_toxicity(docs, labels(spark))
    assert without_toxic(docs, model).count() == docs.count()
    assert without_toxic(docs, model).columns == docs.columns


def test_packing_covers_every_row(spark, docs):
    pieces = pack(docs, BYTE, length=64, packet=16).collect()
    assert sum(p["length"] for p in pieces if p["start"] == 0) <= sum(p["length"] for p in pieces)
    assert sum(1 for p in pieces if p["start"] == 0) == docs.count()
    assert all(len(p["ids"]) == 4 * p["length"] for p in pieces)
    slots = sorted((p["sequence_id"], p["offset"], p["length"]) for p in pieces)
    at = 0
    for sequence, offset, length in slots:
        assert sequence * 64 + offset == at
        at += length


def test_weights_change_the_mixture(spark):
    prepare(spark)
    docs = spark.createDataFrame([(i, "a b c d e f g h", "s1" if i % 2 else "s2") for i in range(400)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("s1", 3.0), ("s2", 1.0)], "source string, weight double")
    pieces = pack(docs, BYTE, length=128, packet=16, weights=weights).collect()
    early = [p for p in pieces if p["sequence_id"] < 10]
    share = sum(p["length"] for p in early if p["source"] == "s1") / sum(p["length"] for p in early)
    assert abs(share - 0.75) < 0.05


def test_pipeline_stages_keep_columns(spark, docs, tmp_path):
    labels(spark, 20).write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [0.0, 2.0]), (8, [0.0, 2.0]), (None, [1.0, 1.0]), (100, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("_q", F.lit("x"))
    found = nearest_neighbours(vectors, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in found] == [
        (0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 8, 2.236068), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 8, 2.236068)
    ]
    assert nearest_neighbours(vectors.where("false"), F.col("vec_id") % 100 == 0).count() == 0
