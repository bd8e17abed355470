"""Removal of word windows that an earlier document holds, found with FM-indexes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from offerlens.llm.fmindex import FMIndex, matched_windows
from offerlens.llm.words import Words, grams, range_hash, words_of
from offerlens.plans.store import stored

GRAM = 16


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (first window's word, number of windows, anchor, text).

    A window's anchor is its gram of ``GRAM`` words with the smallest hash, the leftmost of
    equals: equal windows have equal anchors, wherever they stand.
    """
    gram = min(GRAM, window)
    at, h = grams(words, gram)
    span = window - gram + 1
    none = np.zeros(0, np.int64)
    if len(at) < span:
        return none, none, np.zeros(0, np.uint64), none
    ok = np.arange(len(at) - span + 1)
    ok = ok[words.doc[at[ok]] == words.doc[at[ok] + window - 1]]
    place = np.empty(len(ok), np.int64)
    views = np.lib.stride_tricks.sliding_window_view(h, span)
    for i in range(0, len(ok), 1 << 16):
        part = ok[i : i + (1 << 16)]
        place[i : i + (1 << 16)] = part + views[part].argmin(1)
    if not len(ok):
        return none, none, np.zeros(0, np.uint64), none
    new = np.ones(len(ok), bool)
    new[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(ok)))
    return at[ok[first]], count, h[place[first]], words.doc[at[ok[first]]]


def _digest(pieces: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(pieces)).hexdigest()


def _pieces(words: Words, lo: int, hi: int) -> list[bytes]:
    raw = words.data.tobytes() if isinstance(words.data, np.ndarray) else words.data
    return [raw[s:e] for s, e in zip(words.starts[lo:hi].tolist(), words.ends[lo:hi].tolist())]


def repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, shard_words: int = 600_000, hot_segments: int = 8_000,
) -> DataFrame:
    """Id, ``n_words``, ``n_removed``, ``kept_sha256`` and ``spans`` of every row.

    ``spans`` are the removed stretches (start, length) in words: all words covered by a
    window of ``window`` consecutive words whose sequence also starts in a document with a
    smaller id. Windows are judged on the input. ``kept_sha256`` is of the kept words joined
    by one space.

    Windows are routed by their anchor (see :func:`anchors`), so equal windows meet in one
    shard whatever the number of shards. Anchors are counted per document first, and only
    anchors of two or more ids go on. The stretch of windows around an anchor is a segment;
    equal segments are kept once, with their smallest id: every other copy is settled by
    that. A shard builds an FM-index over its segments and streams the segments through it,
    accepting only matches with a smaller id. The segments of an anchor with more than
    ``hot_segments`` different ones are not indexed: each of their windows becomes a row with
    a 128-bit digest of its words, and meets its equals by that. The rows grow with the
    segments, at most ``window`` times, and no task gathers the segments of an anchor.

    A null text has no words. A row whose id is null neither removes nor loses words; rows
    of equal id do not remove each other's. An empty table gives an empty result; other
    columns are ignored.
    """
    given = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = given.schema["_id"].dataType

    seen = StructType([StructField("_g", LongType()), StructField("_id", id_type)])

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, g, doc = anchors(words_of(batch.column(1)), window)
            pairs = np.unique(np.stack([doc.astype(np.uint64), g]), axis=1) if len(g) else np.zeros((2, 0), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view(np.int64)), batch.column(0).take(pa.array(pairs[0].astype(np.int32)))], names=seen.fieldNames())

    pairs = stored(given.where(F.col("_id").isNotNull()).mapInArrow(anchor, seen), "anchors")
    shared = pairs.groupBy("_g").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most")).where("_least < _most").select("_g")
    lists = pairs.join(shared, "_g").groupBy("_id").agg(F.collect_set("_g").alias("_gs"))
    joined = given.join(lists, "_id", "left")

    base_type = StructType([
        StructField("_k", LongType()), StructField("_id", id_type), StructField("_n", LongType()), StructField("_sha", StringType()),
        StructField("_text", StringType()), StructField("_gs", ArrayType(LongType())),
    ])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            words = words_of(batch.column(1))
            edge = words.doc_bounds()
            raw = words._replace(data=words.data.tobytes())
            open_ = batch.column(2).is_valid().to_pylist()
            sha = [None if o else _digest(_pieces(raw, edge[i], edge[i + 1])) for i, o in enumerate(open_)]
            keys = pa.array(np.arange(key, key + batch.num_rows))
            key += batch.num_rows
            text = pa.compute.if_else(batch.column(2).is_valid(), batch.column(1), pa.scalar(None, batch.column(1).type))
            yield pa.RecordBatch.from_arrays([keys, batch.column(0), pa.array(np.diff(edge)), pa.array(sha, pa.string()), text, batch.column(2)], names=base_type.fieldNames())

    base = stored(joined.select("_id", "_text", "_gs").mapInArrow(settle, base_type), "substring-base")
    open_rows = base.where(F.col("_gs").isNotNull())

    segment = StructType([
        StructField("_g", LongType()), StructField("_c", LongType()), StructField("_k", LongType()), StructField("_id", id_type),
        StructField("_from", IntegerType()), StructField("_windows", IntegerType()), StructField("_seg", BinaryType()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(batch.column(2))
            at, count, g, doc = anchors(words, window)
            lists_ = batch.column(3)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists_.offsets)))
            keep = np.zeros(len(g), bool)
            values, where = np.asarray(lists_.flatten()).view(np.uint64), owner
            for row in np.unique(doc):
                mine = doc == row
                keep[mine] = np.isin(g[mine], values[where == row])
            at, count, g, doc = at[keep], count[keep], g[keep], doc[keep]
            until = at + count + window - 1
            content = range_hash(words.hash, at, until)
            raw = words.data.tobytes()
            # One space between words: the bytes of a segment are its words, nothing else.
            starts, ends = words.starts, words.ends
            segs = [b" ".join([raw[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]) for a, b in zip(at.tolist(), until.tolist())]
            first = words.doc_bounds()[doc]
            take = pa.array(doc.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(g.view(np.int64)), pa.array(content.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take),
                 pa.array((at - first).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(segs, pa.binary())], names=segment.fieldNames(),
            )

    segments = stored(open_rows.select("_k", "_id", "_text", "_gs").mapInArrow(cut, segment), "segments")
    places = segments.select("_g", "_c", "_k", "_id", "_from", "_windows")
    distinct = segments.groupBy("_g", "_c").agg(F.min("_id").alias("_id"), F.first("_seg").alias("_seg"), F.max("_windows").alias("_windows"))
    distinct = stored(distinct, "distinct-segments")
    total = distinct.agg(F.sum(F.col("_windows") + window)).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    hot = stored(distinct.groupBy("_g").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > hot_segments).select("_g"), "hot-anchors")
    cold = distinct.join(hot, "_g", "left_anti")
    indexed = cold.select(F.pmod(F.xxhash64("_g"), F.lit(shards)).alias("_shard"), "_g", "_c", "_id", "_seg")
    answer = StructType([StructField("_g", LongType()), StructField("_c", LongType()), StructField("_runs", ArrayType(ArrayType(IntegerType())))])

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [s.split(b" ") for s in rows["_seg"]]
        flat = pd.factorize(np.array([w for p in parts for w in p], object))[0].astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        owners = np.unique(rows["_id"].to_numpy(), return_inverse=True)[1]
        runs = _runs(matched_windows(FMIndex(flat, bounds, owners), flat, bounds, owners, window), bounds)
        some = [i for i, r in enumerate(runs) if r]
        return pd.DataFrame({"_g": rows["_g"].to_numpy()[some], "_c": rows["_c"].to_numpy()[some], "_runs": pd.Series([runs[i] for i in some], dtype=object)})

    single = StructType([
        StructField("_g", LongType()), StructField("_c", LongType()), StructField("_id", id_type), StructField("_at", IntegerType()), StructField("_w", BinaryType()),
    ])

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, digest = [], [], []
            for i, seg in enumerate(batch.column(3).to_pylist()):
                ends = [k for k, byte in enumerate(seg) if byte == 32] + [len(seg)]
                starts = [0, *(e + 1 for e in ends[:-1])]
                for j in range(len(ends) - window + 1):
                    row.append(i)
                    at.append(j)
                    digest.append(hashlib.blake2b(seg[starts[j] : ends[j + window - 1]], digest_size=16).digest())
            take = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(take) for c in range(3)), pa.array(at, pa.int32()), pa.array(digest, pa.binary())], names=single.fieldNames(),
            )

    # A window is as long as what has to match, so equal windows are equal digests: no pairs.
    singles = stored(distinct.join(hot, "_g").select("_g", "_c", "_id", "_seg").mapInArrow(windows_of, single), "hot-windows")
    first = singles.groupBy("_g", "_w").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last").drop("_last")
    found = singles.join(first, ["_g", "_w"]).where("_first < _id")
    found = found.groupBy("_g", "_c").agg(F.collect_list(F.array(F.col("_at"), F.lit(1))).alias("_runs"))
    answers = stored(indexed.groupBy("_shard").applyInPandas(search, answer).unionByName(found), "substring-answers")
    owners = distinct.select("_g", "_c", F.col("_id").alias("_least"))
    settled = places.join(owners, ["_g", "_c"]).join(answers, ["_g", "_c"], "left")
    whole = F.array(F.array(F.lit(0), F.col("_windows")))
    runs = F.when(F.col("_id") > F.col("_least"), whole).otherwise(F.coalesce("_runs", F.expr("cast(array() as array<array<int>>)")))
    moved = F.transform(runs, lambda r: F.struct((r[0] + F.col("_from")).alias("start"), r[1].alias("n")))
    per_row = settled.select("_k", moved.alias("_w")).where(F.size("_w") > 0).groupBy("_k").agg(F.flatten(F.collect_list("_w")).alias("_w"))
    told = open_rows.select("_k", "_id", "_n", "_text").join(per_row, "_k", "left").select("_id", "_n", "_text", "_w")
    span = StructType([StructField("start", LongType()), StructField("length", LongType())])
    out = StructType([
        StructField(id_col, id_type), StructField("n_words", LongType()), StructField("n_removed", LongType()),
        StructField("kept_sha256", StringType()), StructField("spans", ArrayType(span)),
    ])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(batch.column(2))
            raw, edge = words._replace(data=words.data.tobytes()), words.doc_bounds()
            removed, sha, spans = [], [], []
            for i, windows in enumerate(batch.column(3).to_pylist()):
                n = int(edge[i + 1] - edge[i])
                steps = np.zeros(n + 1, np.int64)
                for w in windows or ():
                    steps[w["start"]] += 1
                    steps[w["start"] + w["n"] + window - 1] -= 1
                gone = np.cumsum(steps)[:n] > 0
                pieces = _pieces(raw, edge[i], edge[i + 1])
                removed.append(int(gone.sum()))
                sha.append(_digest([p for p, g in zip(pieces, gone.tolist()) if not g]))
                spans.append([{"start": s, "length": c} for s, c in _runs(gone, np.array([0, n]))[0]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(sha, pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))], names=out.fieldNames(),
            )

    clean = base.where(F.col("_gs").isNull()).select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_words"), F.lit(0).cast("bigint").alias("n_removed"), F.col("_sha").alias("kept_sha256"),
        F.expr("cast(array() as array<struct<start: bigint, length: bigint>>)").alias("spans"),
    )
    return clean.unionByName(told.mapInArrow(finish, out))


def _runs(flags: np.ndarray, bounds: np.ndarray) -> list[list[list[int]]]:
    """Per stretch between bounds, its runs of True as [start, length]."""
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        part = flags[lo:hi]
        if not part.any():
            out.append([])
            continue
        steps = np.flatnonzero(np.diff(np.concatenate([[False], part, [False]])))
        out.append([[int(a), int(b - a)] for a, b in zip(steps[::2], steps[1::2])])
    return out
