"""Toxicity by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from offerlens.llm.sampling import place, under_quota
from offerlens.operators.scale import top_per_group

_LETTERS = re.compile(r"[^\W\d_]+")
HEAD = 3  # letters by which a word is looked up first
STEMS = (4, 5, 6)  # a pattern voter takes every word that begins so, and is longer
TIMES = (1, 2, 3)  # a count voter asks for so many matches of any lexicon entry


def terms_of(text: str) -> set[str]:
    """Words of a text and, marked with ``*``, the stems of longer words."""
    words = set(_LETTERS.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


@dataclass
class ToxicityModel:
    """``terms``: lexicon words and stem patterns; each is a voter. ``accuracy``: P(vote |
    toxic) and P(vote | clean) of every voter; ``correlation``: of the voters given the
    label; ``weights``, ``bias``: the linear classifier over the votes."""

    terms: list[str] = field(default_factory=list)
    accuracy: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))
    correlation: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -20.0

    def lookup(self) -> tuple[set[str], dict[str, int]]:
        return {t[:HEAD] for t in self.terms}, {t: i for i, t in enumerate(self.terms)}

    def votes(self, texts: list[str | None]) -> np.ndarray:
        """One row per text, one column per voter: 1 where it votes toxic."""
        heads, index = self.lookup()
        out = np.zeros((len(texts), len(self.terms) + len(TIMES)), np.float64)
        for row, text in enumerate(texts):
            n = 0
            for word, times in Counter(_LETTERS.findall((text or "").lower())).items():
                if word[:HEAD] not in heads:
                    continue
                hits = [index[t] for t in (word, *(word[:k] + "*" for k in STEMS if len(word) > k)) if t in index]
                out[row, hits] = 1
                n += times * bool(hits)
            out[row, len(self.terms) :] = [n >= k for k in TIMES]
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.terms:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.votes(texts) @ self.weights + self.bias, -40, 40)))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> DataFrame:
    """Up to ``per_class`` labelled texts of each class, by the order of a hash."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("bigint").alias("_y"))
    sizes = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    total = F.when(F.col("_y") == 1, F.lit(sizes.get(1, 0))).otherwise(F.lit(sizes.get(0, 0)))
    known = known.where(under_quota(F.xxhash64("_id"), per_class, total))
    known = top_per_group(known, ["_y"], [place(F.xxhash64("_id")), F.col("_id")], per_class, "_r").drop("_r")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # Two fixed numbers of ids at most: small enough for every task.
    out = StructType([StructField("_least", LongType()), StructField("_y", LongType()), StructField("_text", StringType())])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [(t or "").lower().split() for t in batch.column(0).to_pylist()]
            keys = [min((zlib.crc32(f"{a} {b}".encode()) for a, b in zip(w, w[1:])), default=-1) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(1), batch.column(0)], names=out.fieldNames())

    # Copies and near copies of one text would vote for its every word. So of the texts
    # with one least pair of words, which near copies share, one is kept.
    sample = texts.join(F.broadcast(known), "_id").select("_text", "_y").mapInArrow(least, out)
    return sample.groupBy("_least", "_y").agg(F.min("_text").alias("_text")).select("_text", "_y")


def _mined(sample: DataFrame, min_toxic: int, min_share: float, most: int) -> list[tuple[str, int, int]]:
    """The ``most`` terms that lean furthest to the toxic class, with their counts: at least
    a hundred times as common there."""
    out = StructType([StructField("term", StringType()), StructField("toxic", LongType()), StructField("clean", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[y].update(terms_of(text or ""))
        terms = list(seen[0] | seen[1])
        columns = (pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in (seen[1], seen[0])))
        yield pa.RecordBatch.from_arrays(list(columns), names=out.fieldNames())

    totals = sample.mapInArrow(count, out).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sizes = {r["_y"]: r["count"] for r in sample.groupBy("_y").count().collect()}
    odds = 100.0 * sizes.get(1, 0) / max(1, sizes.get(0, 0))
    least = max(min_toxic, min_share * sizes.get(1, 0))
    lean = totals.where(F.col("toxic") >= least).where(F.col("toxic") >= F.lit(odds) * F.col("clean"))
    # A clean text that holds a term counts against it; of equal terms the longer says more.
    rows = lean.orderBy((F.col("toxic") - 20 * F.col("clean")).desc(), F.length("term").desc(), "term").limit(most).collect()
    return [(r["term"], r["toxic"], r["clean"]) for r in rows]


def _voters(mined: list[tuple[str, int, int]], most: int) -> list[str]:
    """Terms in order of their reach, without those that a chosen pattern covers already and
    without patterns that reach hardly more than the chosen terms they cover."""
    chosen: dict[str, int] = {}
    for term, toxic, _ in mined:
        stem = term.rstrip("*")
        if any(c.endswith("*") and stem.startswith(c[:-1]) and stem != c[:-1] for c in chosen):
            continue
        inside = sum(n for c, n in chosen.items() if term.endswith("*") and c.startswith(stem))
        if inside and toxic - inside < 0.1 * toxic:
            continue
        chosen[term] = toxic
        if len(chosen) == most:
            break
    return list(chosen)


def label_model(votes: np.ndarray, prior: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the toxic class per row, accuracies and correlations of the voters.

    Expectation maximisation over P(vote | class) without any label but the class share;
    then the voters' correlation given the posterior is measured, a voter's evidence is
    divided by the number of voters it moves with, and the accuracies are fitted again.
    """
    n, m = votes.shape
    correlation, share = np.eye(m), np.ones(m)
    posterior = np.clip((votes.sum(1) > 0) * 0.9 + 0.05, 0.05, 0.95)
    accuracy = np.zeros((2, m))
    for step in range(rounds):
        for c, w in ((0, 1 - posterior), (1, posterior)):
            accuracy[c] = (w @ votes + 0.5) / (w.sum() + 1.0)
        if step == rounds // 2:
            centred = votes - np.where(posterior[:, None] > 0.5, accuracy[1], accuracy[0])
            spread = np.sqrt((centred**2).mean(0)) + 1e-9
            correlation = (centred.T @ centred) / max(n, 1) / np.outer(spread, spread)
            share = 1 / np.clip(np.abs(correlation), 0, 1).sum(1).clip(1)
        yes = votes @ (share * np.log(accuracy[1] / accuracy[0]))
        no = (1 - votes) @ (share * np.log((1 - accuracy[1]) / (1 - accuracy[0])))
        posterior = 1 / (1 + np.exp(-np.clip(yes + no + np.log(prior / (1 - prior)), -40, 40)))
    return posterior, accuracy, correlation


def _linear(votes: np.ndarray, target: np.ndarray, steps: int = 30, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's method; the bias is not shrunk."""
    x = np.hstack([votes, np.ones((len(votes), 1))])
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (target - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    per_class: int = 4000, min_toxic: int = 4, min_share: float = 0.01, max_voters: int = 128,
) -> ToxicityModel:
    """A model from the labelled rows of ``labels`` (rows to be held out are left out there).

    Labels serve to find voters in at most ``per_class`` texts of each class: words, and
    stems of words, that at least ``min_toxic`` toxic texts and ``min_share`` of them hold
    and clean ones hardly: rarer words may stand in toxic texts by chance alone. The most far-reaching ``max_voters`` vote on the same sample; a generative model estimates
    their accuracies and correlations and a posterior for every text; a linear classifier
    over the votes learns that posterior. The driver holds the sample's votes, whose size
    the parameters bound. Without labels, or without a voter, every score is 0.
    """
    sample = _sample(docs, labels, id_col, text_col, label_col, per_class)
    model = ToxicityModel(terms=_voters(_mined(sample, min_toxic, min_share, 8 * max_voters), max_voters))
    if not model.terms:
        return model
    out = StructType([StructField("votes", StringType()), StructField("y", LongType()), StructField("n", LongType())])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = model.votes(batch.column(0).to_pylist()).astype(np.uint8)
            rows = ["".join(map(str, r)) for r in table]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), batch.column(1), pa.array([1] * len(rows), pa.int64())], names=out.fieldNames())

    kinds = sample.mapInArrow(vote, out).groupBy("votes").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).orderBy("votes").collect()
    patterns = np.array([[int(c) for c in r["votes"]] for r in kinds], np.float64)
    rows = np.repeat(patterns, [r["n"] for r in kinds], axis=0)
    prior = float(np.clip(sum(r["y"] for r in kinds) / len(rows), 0.01, 0.99))
    posterior, model.accuracy, model.correlation = label_model(rows, prior)
    model.weights, model.bias = _linear(rows, posterior)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``score`` (0 to 1, higher: more likely toxic) of every whole text.

    A null or empty text has no votes and gets the score of none. Repeated rows are scored
    one by one; an empty table gives an empty result; other columns are ignored.
    """
    given = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = StructType([StructField(id_col, given.schema["_id"].dataType), StructField("score", DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1).to_pylist()), pa.float64())], names=out.fieldNames())

    return given.mapInArrow(score, out)


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows whose score is under the threshold, with all their columns as they are."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array(model.score(texts) < threshold))

    return docs.mapInArrow(keep, docs.schema)
