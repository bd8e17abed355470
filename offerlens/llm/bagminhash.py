"""Near-duplicates of word-shingle multisets by BagMinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from offerlens.llm.words import Words, grams, mix, range_hash, words_of
from offerlens.plans.store import stored

KEY = ["_id", "_h"]
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, times) of every text, sorted; a text of fewer than ``n`` words
    is one shingle of all its words."""
    at, h = grams(words, n)
    doc = words.doc[at]
    bounds = words.doc_bounds()
    few = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < n))
    if len(few):
        doc = np.concatenate([doc, few])
        h = np.concatenate([h, range_hash(words.hash, bounds[few], bounds[few + 1])])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    starts = np.flatnonzero(new)
    times = np.diff(np.append(starts, len(doc)))
    return doc[starts], h[starts], times


def signatures(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """BagMinHash signature of each text: equal registers have the weighted Jaccard's odds.

    The weight axis of an item is cut into dyadic blocks [0,1), [1,2), [2,4), [4,8) ... of
    discrete weights; each block is a Poisson process of its own whose rate is its length,
    seeded by item and block. A point of a block falls on a uniform weight level and counts
    only under the item's weight, so a text sees exactly the points below its weights. The
    points of a process come in rising time, each goes to a random register, and a register
    keeps its earliest one. A process stops when its time has passed every register of its
    text; all processes of a batch step together. Registers of texts without items are 0.
    """
    top = np.maximum(weight, 1) - 1
    levels = np.where(top > 0, np.floor(np.log2(np.maximum(top, 1))).astype(np.int64) + 2, 1)
    at = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    length = np.where(level > 0, 1 << np.maximum(level - 1, 0), 1)
    base = np.where(level > 0, length, 0)
    seed = mix(item[at] ^ mix((level.astype(np.uint64) + np.uint64(1)) * _GOLDEN))
    owner, limit = doc[at], weight[at]
    time = np.zeros(len(at))
    registers = np.full(n_docs * size, np.inf)
    names = np.zeros(n_docs * size, np.uint64)
    latest = np.full(n_docs, np.inf)
    step = 0
    while len(owner):
        step += 1
        draw = mix(seed + np.uint64(step * int(_GOLDEN) % (1 << 64)))
        gap = -np.log1p(-((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53))
        time = time + gap / length
        place = mix(draw ^ _GOLDEN)
        register = owner * size + ((place >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        under = base + ((place & np.uint64(0xFFFFFFFF)) * length.astype(np.uint64) >> np.uint64(32)).astype(np.int64) < limit
        better = under & (time < registers[register])
        if better.any():
            r, t, name = register[better], time[better], draw[better]
            order = np.lexsort((t, r))
            r, t, name = r[order], t[order], name[order]
            first = np.ones(len(r), bool)
            first[1:] = r[1:] != r[:-1]
            registers[r[first]], names[r[first]] = t[first], name[first]
        if step < 4 or step % 4 == 0:
            latest = registers.reshape(n_docs, size).max(1)
        alive = time < latest[owner]
        owner, seed, time, length, base, limit = (x[alive] for x in (owner, seed, time, length, base, limit))
    return names.reshape(n_docs, size)


def _bands(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """One row per text: key, content hash of its shingles, total weight, band keys."""
    given = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("_text"))
    out = StructType([
        StructField("_id", given.schema["_id"].dataType), StructField("_h", LongType()), StructField("_content", LongType()),
        StructField("_size", LongType()), StructField("_bands", ArrayType(LongType())),
    ])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            doc, item, times = shingles(words_of(batch.column(2)), n)
            size = np.bincount(doc, weights=times, minlength=m).astype(np.int64)
            # Order-free hash of the multiset: equal multisets are exact copies here.
            content = np.zeros(m, np.uint64)
            np.add.at(content, doc, mix(item * np.uint64(0xFF51AFD7ED558CCD) ^ mix(times.astype(np.uint64))))
            table = signatures(doc, item, times, m, bands * rows)
            flat = table.reshape(-1)
            starts = np.arange(m * bands) * rows
            keys = range_hash(flat, starts, starts + rows) + np.tile(np.arange(bands, dtype=np.uint64) * _GOLDEN, m)
            lists = pa.ListArray.from_arrays(np.arange(0, m * bands + 1, bands, dtype=np.int32), pa.array(mix(keys).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(mix(content).view(np.int64)), pa.array(size), lists], names=out.fieldNames()
            )

    return given.mapInArrow(sign, out)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Shared over joint weight of two sorted (item, times) multisets."""
    at = np.searchsorted(b[0], a[0])
    same = at < len(b[0])
    same[same] = b[0][at[same]] == a[0][same]
    low = np.minimum(a[1][same], b[1][at[same]]).sum()
    total = a[1].sum() + b[1].sum() - low
    return float(low / total) if total else 0.0


def _verified(pairs: DataFrame, texts: DataFrame, n: int, threshold: float, name: str) -> DataFrame:
    """The pairs (_u, _v) of representatives that reach the threshold exactly, with ``_sim``."""
    left = texts.select(F.col("_rep").alias("_u"), F.col("_text").alias("_a"))
    right = texts.select(F.col("_rep").alias("_v"), F.col("_text").alias("_b"))
    joined = pairs.join(left, "_u").join(right, "_v").select("_u", "_v", "_a", "_b")
    out = StructType([StructField("_u", LongType()), StructField("_v", LongType()), StructField("_sim", DoubleType())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One of the texts is often the same for many rows of a batch: read it once.
            texts_: dict[str, int] = {}
            both = [[texts_.setdefault(t, len(texts_)) for t in batch.column(i).to_pylist()] for i in (2, 3)]
            doc, item, times = shingles(words_of(pa.array(list(texts_), pa.large_string())), n)
            edge = np.searchsorted(doc, np.arange(len(texts_) + 1))
            bags = [(item[edge[i] : edge[i + 1]], times[edge[i] : edge[i + 1]]) for i in range(len(texts_))]
            sim = np.array([weighted_jaccard(bags[x], bags[y]) for x, y in zip(*both)])
            keep = pa.array(sim >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim)], names=out.fieldNames()).filter(keep)

    return stored(joined.mapInArrow(check, out), name)


def _block_links(rows: pd.DataFrame, n: int, threshold: float) -> pd.DataFrame:
    """Links between the two sides of a block of one bucket, all compared exactly.

    Every shingle, as often as it occurs, is a column that a text has or has not, so shared
    weights are products of 0/1 matrices; they are added up over slices of the columns. A
    pair counts in the first band it shares, and only between classes.
    """
    reps, where = np.unique(rows["_rep"].to_numpy(), return_index=True)
    texts = rows["_text"].to_numpy()[where]
    bands = np.stack(rows["_bands"].to_numpy()[where])
    classes = rows["_class"].to_numpy()[where]
    doc, item, times = shingles(words_of(pa.array(texts, pa.large_string())), n)
    size = np.bincount(doc, weights=times, minlength=len(reps))
    row, turn = np.repeat(doc, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    keys, column, seen = np.unique(mix(np.repeat(item, times) + turn.astype(np.uint64) * _GOLDEN), return_inverse=True, return_counts=True)
    shared = seen[column.ravel()] > 1
    row, column = row[shared], np.unique(column.ravel()[shared], return_inverse=True)[1].ravel()
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    x = np.searchsorted(reps, np.sort(rows["_rep"].to_numpy()[rows["_side"].to_numpy() == 0]))
    y = np.searchsorted(reps, np.sort(rows["_rep"].to_numpy()[rows["_side"].to_numpy() == 1]))
    both = np.zeros((len(x), len(y)), np.float32)
    last = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, last, 4096):
        lo, hi = np.searchsorted(column, [start, start + 4096])
        part = np.zeros((len(reps), 4096), np.float32)
        part[row[lo:hi], column[lo:hi] - start] = 1
        both += part[x] @ part[y].T
    similar = both / np.maximum(size[x][:, None] + size[y][None, :] - both, 1)
    at = int(np.flatnonzero(bands[0] == rows["_b"].iloc[0])[0])
    i, j = np.nonzero((similar >= threshold) & (classes[x][:, None] != classes[y][None, :]))
    if len(i):
        first = (bands[x[i]] == bands[y[j]]).argmax(1) == at
        i, j = i[first], j[first]
    u, v = reps[x[i]], reps[y[j]]
    return pd.DataFrame({"_u": np.minimum(u, v), "_v": np.maximum(u, v), "_sim": similar[i, j].astype(float)})


def components(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """``_rep``, ``_class``: the smallest node that edges (_u, _v) lead to.

    Alternating large-star and small-star steps, each a grouped minimum over edges, until
    no edge changes: a logarithmic number of rounds in practice. Every round is a written
    table, so its lineage is short and lost executors cost one round at most.
    """
    def stars(links: DataFrame, large: bool) -> DataFrame:
        if large:
            both = links.select(F.col("_u").alias("_c"), F.col("_v").alias("_x")).unionByName(links.select(F.col("_v").alias("_c"), F.col("_u").alias("_x")))
        else:
            both = links.select(F.greatest("_u", "_v").alias("_c"), F.least("_u", "_v").alias("_x"))
        least = both.groupBy("_c").agg(F.min("_x").alias("_m")).withColumn("_m", F.least("_m", "_c"))
        linked = both.join(least, "_c")
        if large:
            return linked.where(F.col("_x") > F.col("_c")).select(F.col("_x").alias("_u"), F.col("_m").alias("_v"))
        return linked.select(F.col("_x").alias("_u"), F.col("_m").alias("_v")).unionByName(least.select(F.col("_c").alias("_u"), F.col("_m").alias("_v")))

    current = stored(edges.select(F.greatest("_u", "_v").alias("_u"), F.least("_u", "_v").alias("_v")).where("_u <> _v").distinct(), f"{name}-0")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_u", "_v").cast("decimal(38,0)"))).first())
    before, step = mark(current), 0
    while before[0]:
        step += 1
        current = stars(stars(current, True).where("_u <> _v").distinct(), False).where("_u <> _v")
        current = stored(current.select(F.greatest("_u", "_v").alias("_u"), F.least("_u", "_v").alias("_v")).distinct(), f"{name}-{step}")
        after = mark(current)
        if after == before:
            break
        before = after
    least = current.groupBy(F.col("_u").alias("_rep")).agg(F.min("_v").alias("_class"))
    return nodes.join(least, "_rep", "left").withColumn("_class", F.coalesce("_class", "_rep"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 4,
    few_pairs: int = 2048, block: int = 1024,
) -> DataFrame:
    """Key (``_id``, ``_h``), ``_rep``, ``_class`` and number of ``_links`` of every document.

    Texts are multisets of ``shingle``-word shingles. Equal multisets form one
    representative (``_rep``) before anything else, so a group of copies is one node. The
    representatives' BagMinHash signatures are banded; two texts at the threshold share no
    band with odds of (1 - threshold**rows)**bands, 3e-6 at the defaults. Buckets are not
    expanded into pairs: in each, all are compared exactly with the one that meets most
    others, near the middle of its group; what is linked becomes one class. Where a bucket
    still holds several classes, its texts outside the largest class are compared with those
    of its other classes. Two texts of one class need no comparison, so no class is torn.

    Up to ``few_pairs`` such comparisons in a bucket are rows of a join. Beyond that they
    are not: the bucket is cut into blocks of ``block`` texts, each compared with the
    others in matrix form in one task, and only the links leave it. A group of texts that
    all lie just under the threshold of each other stays many classes and costs that work
    in full, spread over its blocks; memory is bounded by two blocks of texts.

    Classes are the connected components of the links found; ``_class`` is the smallest
    representative. A null text, or one without words, is a class of its own. Rows of equal
    id and text are one document. Other columns are ignored.
    """
    signed = stored(_bands(docs, id_col, text_col, shingle, bands, rows), "near-bands")
    place = F.struct(F.col("_id"), F.col("_h"))
    firsts = signed.where("_size > 0").groupBy("_content", "_size").agg(F.min(place).alias("_first"), F.first("_bands").alias("_bands"))
    reps = firsts.select(F.xxhash64("_content", "_size").alias("_rep"), "_content", "_size", "_first", "_bands")
    # Buckets of one text leave before anything is joined.
    banded = reps.select("_rep", "_size", F.explode("_bands").alias("_b"))
    shared = banded.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = stored(banded.join(shared, "_b"), "near-met")
    reach = met.groupBy("_rep").agg(F.sum("_n").alias("_reach"))
    reached = met.join(reach, "_rep")
    lead = reached.groupBy("_b").agg(F.max(F.struct("_reach", "_rep", "_size")).alias("_lead"))
    members = stored(reached.join(lead, "_b").select("_b", "_rep", "_size", "_n", "_lead"), "near-buckets")
    busy = members.select("_rep").distinct()
    near_first = reps.join(busy, "_rep").select("_rep", "_bands", F.col("_first._id").alias("_fid"), F.col("_first._h").alias("_fh"))
    whole = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("_text"))
    same = whole["_id"].eqNullSafe(near_first["_fid"]) & (whole["_h"] == near_first["_fh"])
    found = whole.join(near_first, same).select("_rep", "_bands", "_text").groupBy("_rep").agg(F.first("_text").alias("_text"), F.first("_bands").alias("_bands"))
    texts = stored(found, "near-texts")

    def pair(u: Column, v: Column) -> list:
        return [F.least(u, v).alias("_u"), F.greatest(u, v).alias("_v")]

    # The share of the smaller weight in the larger bounds the similarity from above.
    fits = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y)
    star = members.where((F.col("_rep") != F.col("_lead._rep")) & fits(F.col("_size"), F.col("_lead._size")))
    tried = stored(star.select(*pair(F.col("_rep"), F.col("_lead._rep"))).distinct(), "near-tried")
    links = _verified(tried, texts, shingle, threshold, "near-links-1")
    classes = stored(components(busy, links, "near-step-1"), "near-classes-1")
    by_class = members.drop("_lead").join(classes, "_rep")
    sizes = by_class.groupBy("_b", "_class").agg(F.count(F.lit(1)).alias("_m"))
    largest = sizes.groupBy("_b").agg(F.max(F.struct("_m", "_class")).alias("_top"), F.count(F.lit(1)).alias("_k")).where("_k > 1")
    largest = largest.select("_b", F.col("_top._class").alias("_main"), F.col("_top._m").alias("_m"))
    open_ = stored(by_class.join(largest, "_b").withColumn("_small", F.col("_n") - F.col("_m")), "near-open")
    # Each text outside its bucket's largest class meets the bucket's other classes.
    few = F.col("_small") * F.col("_n") <= few_pairs
    light, heavy = open_.where(few), open_.where(~few)
    small = light.where("_class <> _main").select(F.col("_b").alias("_b2"), F.col("_rep").alias("_r2"), F.col("_size").alias("_s2"), F.col("_class").alias("_c2"))
    across = (light["_b"] == small["_b2"]) & (light["_class"] != small["_c2"]) & fits(light["_size"], small["_s2"])
    rest = light.join(small, across).select(*pair(light["_rep"], small["_r2"])).distinct().join(tried, ["_u", "_v"], "left_anti")
    more = _verified(rest, texts, shingle, threshold, "near-links-2")
    parts = lambda size: F.ceil(F.col(size) / block).cast("int")
    own = lambda size: F.array(F.pmod(F.xxhash64("_rep"), parts(size)).cast("int"))
    every_part = lambda size: F.sequence(F.lit(0), parts(size) - 1)
    sides = heavy.where("_class <> _main").select("*", F.lit(0).alias("_side"), own("_small").alias("_xs"), every_part("_n").alias("_ys"))
    sides = sides.unionByName(heavy.select("*", F.lit(1).alias("_side"), every_part("_small").alias("_xs"), own("_n").alias("_ys")))
    dealt = sides.select("_b", "_rep", "_class", "_side", F.explode("_xs").alias("_x"), "_ys").select("_b", "_rep", "_class", "_side", "_x", F.explode("_ys").alias("_y"))
    link = StructType([StructField("_u", LongType()), StructField("_v", LongType()), StructField("_sim", DoubleType())])
    blocks = dealt.join(texts, "_rep").groupBy("_b", "_x", "_y").applyInPandas(lambda rows_: _block_links(rows_, shingle, threshold), link)
    every = links.unionByName(more).unionByName(stored(blocks, "near-links-3").dropDuplicates(["_u", "_v"]))
    classes = components(reps.select("_rep"), every, "near-step-2")
    ends = every.select(F.col("_u").alias("_rep")).unionByName(every.select(F.col("_v").alias("_rep")))
    counted = classes.join(ends.groupBy("_rep").agg(F.count(F.lit(1)).alias("_links")), "_rep", "left")
    counted = stored(counted.withColumn("_links", F.coalesce("_links", F.lit(0).cast("bigint"))), "near-classes-2")
    own = F.when(F.col("_size") > 0, F.xxhash64("_content", "_size")).otherwise(F.xxhash64("_id", "_h"))
    told = signed.select(*KEY, "_size", own.alias("_rep")).join(counted, "_rep", "left")
    return told.select(*KEY, "_rep", F.coalesce("_class", "_rep").alias("_class"), F.coalesce("_links", F.lit(0).cast("bigint")).alias("_links"))
