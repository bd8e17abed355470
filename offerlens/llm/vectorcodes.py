"""Vector codes from codebooks per part, searched by walking a trie of distinct parts."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from offerlens.plans.store import stored

#: Leaves of a subtree that is finished level by level: 512 distance vectors of 256 entries are 1 MB.
LEAVES = 512


def whole_numbers(vector: Column, scale: int, size: Column | None = None) -> Column:
    """``floor(scale * x)`` of each component as longs; null where the vector takes no part.

    No part take null vectors, empty ones, and those with a null, non-finite or too large
    component: beyond 2**30 / sqrt(dimensions) squared distances need not fit a long.
    """
    v = F.transform(vector, lambda x: x.cast("double") * scale)
    limit = F.lit(float(1 << 30)) / F.sqrt(F.size(vector).cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    fits = vector.isNotNull() & (F.size(vector) > 0) & fine
    return F.when(F.coalesce(fits, F.lit(False)), F.transform(v, lambda x: F.floor(F.when(F.abs(x) < float(1 << 31), x))))


def bounds(dimensions: int, parts: int) -> list[int]:
    """Where each part begins, and the end of the last: equal parts if the number divides."""
    return [i * dimensions // parts for i in range(parts + 1)]


@dataclass
class Codebooks:
    """``entries[p]``: whole numbers (entry, position) of part p; ``dimensions`` of a vector."""

    entries: list[np.ndarray]
    dimensions: int
    scale: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for part in self.entries for x in part.ravel()).encode()).hexdigest()


def trie_order(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lexicographic order of the rows, and for each sorted row the length of the prefix it
    shares with the one before (its length if they are equal, 0 for the first)."""
    n, d = points.shape
    order = np.lexsort(points.T[::-1]) if d else np.arange(n)
    if n < 2 or not d:
        return order, np.zeros(n, np.int64)
    differ = points[order[1:]] != points[order[:-1]]
    shared = np.where(differ.any(1), differ.argmax(1), d)
    return order, np.concatenate([[0], shared])


def walk(points: np.ndarray, shared: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (ties to the lower index) and squared distance of sorted distinct rows.

    The rows are the leaves of a trie over their components. A depth-first walk carries, for
    the prefix at hand, the distances to all entries over the dimensions so far; what stands
    below the prefix adds its own dimensions only. A subtree of at most ``LEAVES`` leaves
    is walked for all its prefixes of a depth at once. All sums are exact.
    """
    n, d = points.shape
    most = 2 * max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if d * most * most < 1 << 53 else np.int64
    x, c = points.astype(kind), entries.astype(kind)
    best, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    stack = [(0, n, 0, np.zeros(len(c), kind))] if n else []
    while stack:
        lo, hi, depth, sums = stack.pop()
        if hi - lo > LEAVES and depth < d:
            starts = lo + np.flatnonzero(np.concatenate([[True], shared[lo + 1 : hi] <= depth]))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), hi]):
                stack.append((a, b, depth + 1, sums + (x[a, depth] - c[:, depth]) ** 2))
            continue
        table, owner = sums[None, :], np.zeros(hi - lo, np.int64)
        for k in range(depth, d):
            fresh = np.concatenate([[True], shared[lo + 1 : hi] <= k])
            starts = np.flatnonzero(fresh)
            step = x[lo + starts, k][:, None] - c[:, k][None, :]
            step *= step
            step += table[owner[starts]]
            table, owner = step, np.cumsum(fresh) - 1
        best[lo:hi] = table.argmin(1)[owner]
        distance[lo:hi] = table.min(1).astype(np.int64)[owner]
    return best, distance


def nearest_entries(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each row; equal rows share one leaf."""
    order, shared = trie_order(points)
    leaf = np.concatenate([[True], shared[1:] < points.shape[1]]) if len(points) else np.zeros(0, bool)
    best, distance = walk(points[order][leaf], shared[leaf], entries)
    place = np.empty(len(points), np.int64)
    place[order] = np.cumsum(leaf) - 1
    return best[place], distance[place]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _sums(parts: DataFrame, entries: list[np.ndarray]) -> DataFrame:
    """Weighted component sums and weights per (part position, entry), one row a task and entry."""
    width = max(e.shape[1] for e in entries)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(e.shape, np.int64) for e in entries]
        count = [np.zeros(len(e), np.int64) for e in entries]
        for batch in batches:
            position, weight = batch["_p"].to_numpy(), batch["_n"].to_numpy()
            for p in np.unique(position).tolist():
                rows = np.flatnonzero(position == p)
                points = _matrix(batch["_part"].take(pa.array(rows)), entries[p].shape[1])
                best, _ = nearest_entries(points, entries[p])
                np.add.at(total[p], best, points * weight[rows][:, None])
                np.add.at(count[p], best, weight[rows])
        for p in range(len(entries)):
            used = np.flatnonzero(count[p])
            padded = np.zeros((len(used), width), np.int64)
            padded[:, : total[p].shape[1]] = total[p][used]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(count[p][used]), pa.array(list(padded), pa.list_(pa.int64()))],
                names=["_p", "_e", "_n", "_s"],
            )

    found = parts.mapInArrow(add, "_p int, _e int, _n long, _s array<long>")
    whole = lambda c: F.sum(c.cast("decimal(38,0)"))
    return found.groupBy("_p", "_e").agg(whole(F.col("_n")).alias("_n"), F.array(*[whole(F.col("_s")[i]) for i in range(width)]).alias("_s"))


def fit_codebooks(
    vectors: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024
) -> Codebooks | None:
    """Codebooks of whole numbers by exact rounds of assignment and floored means; None without vectors.

    A codebook starts as the part of the ``entries`` vectors of smallest id (null ids last,
    ties by content; fewer vectors give fewer entries). The distinct parts are counted
    first and written in lexicographic ranges, so copies are searched once and a task's trie
    shares prefixes. A round sends back one row per task and entry; the driver holds the
    codebooks, whose size the parameters give. The vector of smallest id sets the number of
    dimensions; vectors of another take no part.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).alias("_id"), whole_numbers(F.col(vec_col), scale).alias("_x")).where("_x is not null")
    first = kept.orderBy(F.asc_nulls_last("_id"), "_x").limit(1).collect()
    if not first:
        return None
    size = len(first[0]["_x"])
    kept = kept.where(F.size("_x") == size)
    seeds = kept.orderBy(F.asc_nulls_last("_id"), "_x").limit(entries).collect()
    edge = bounds(size, parts)
    start = np.array([r["_x"] for r in seeds], np.int64)
    books = [start[:, a:b].copy() for a, b in zip(edge, edge[1:])]
    cut = F.array(*[F.slice("_x", a + 1, b - a) for a, b in zip(edge, edge[1:])])
    counted = kept.select(F.posexplode(cut).alias("_p", "_part")).groupBy("_p", "_part").agg(F.count(F.lit(1)).alias("_n"))
    # The number of ranges is given: merged ranges would leave the search to few tasks.
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = stored(counted.repartitionByRange(ranges, "_p", "_part").sortWithinPartitions("_p", "_part"), "vector-parts")
    for _ in range(rounds):
        for r in _sums(distinct, books).collect():
            book = books[r["_p"]]
            book[r["_e"]] = [int(s) // int(r["_n"]) for s in r["_s"][: book.shape[1]]]
    return Codebooks(books, size, scale)


def encode(vectors: DataFrame, books: Codebooks | None, vec_col: str = "embedding") -> DataFrame:
    """The given rows that take part, with ``_codes`` (entry per part) and ``_error``.

    The error is the squared distance summed over the parts, in the codebooks' whole numbers.
    Equal vectors of an Arrow batch are searched once. Rows without a usable vector (see
    :func:`whole_numbers`) or of another number of dimensions are left out; columns of
    the names added are replaced.
    """
    given = [c for c in vectors.columns if c not in ("_codes", "_error")]
    schema = StructType([StructField("_row", StructType([vectors.schema[c] for c in given])), StructField("_codes", ArrayType(IntegerType())), StructField("_error", LongType())])
    size = books.dimensions if books else -1
    rows = vectors.select(F.struct(*[vectors[c] for c in given]).alias("_row"), whole_numbers(vectors[vec_col], books.scale if books else 1).alias("_x"))
    rows = rows.where(F.col("_x").isNotNull() & (F.size("_x") == size))
    edge = bounds(size, len(books.entries)) if books else []

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["_x"], size)
            found = [nearest_entries(x[:, a:b], e) for a, b, e in zip(edge, edge[1:], books.entries)]
            codes = np.stack([f[0] for f in found], 1).astype(np.int32)
            error = sum(f[1] for f in found)
            yield pa.RecordBatch.from_arrays([batch["_row"], pa.array(list(codes), pa.list_(pa.int32())), pa.array(error)], names=["_row", "_codes", "_error"])

    return rows.mapInArrow(search, schema).select("_row.*", "_codes", "_error")


def code_text(codes: Column, entries: int = 256) -> Column:
    """The entries as hex text, each with the digits that the largest needs."""
    digits = max(1, math.ceil(math.log(entries, 16)))
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), digits, "0"))), "")


def with_group_error(encoded: DataFrame, group_col: str, out: str = "group_error") -> DataFrame:
    """Adds the error summed over rows of an equal group, nulls together; null beyond a long.

    Sums meet the rows by a null-safe join, so a hot group is never in one task.
    """
    total = F.sum(F.col("_error").cast("decimal(38,0)"))
    sums = encoded.groupBy(F.col(group_col).alias("_g")).agg(total.alias("_t")).select("_g", F.expr("try_cast(_t as bigint)").alias(out))
    return encoded.join(sums, encoded[group_col].eqNullSafe(sums["_g"])).drop("_g")
