"""Nearest neighbours with a hierarchical k-means tree and best-bin-first search."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from offerlens.llm.sampling import place, under_quota
from offerlens.operators.scale import top_per_group
from offerlens.plans.store import stored


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components that are not all zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


@dataclass
class Tree:
    """Nodes in breadth-first order: ``centres``, first child and number of children (0 for
    a leaf), and the number of each leaf (-1 inside)."""

    centres: np.ndarray
    child: np.ndarray
    children: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest child, level by level."""
        node = np.zeros(len(x), np.int64)
        open_ = np.flatnonzero(self.children[node] > 0)
        while len(open_):
            for n in np.unique(node[open_]):
                rows = open_[node[open_] == n]
                kids = self.centres[self.child[n] : self.child[n] + self.children[n]]
                node[rows] = self.child[n] + _nearest(x[rows], kids)
            open_ = open_[self.children[node[open_]] > 0]
        return self.leaf[node]

    def best_bins(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a best-bin-first walk: the closest open node is opened next."""
        queue = [(0.0, 0)]
        while queue:
            _, n = heapq.heappop(queue)
            if self.children[n] == 0:
                yield int(self.leaf[n])
                continue
            kids = np.arange(self.child[n], self.child[n] + self.children[n])
            for d, k in zip(((self.centres[kids] - q) ** 2).sum(1).tolist(), kids.tolist()):
                heapq.heappush(queue, (d, k))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


def build_tree(x: np.ndarray, branch: int, leaf_rows: int, seed: int = 7, rounds: int = 12) -> Tree:
    """Hierarchical k-means over the rows of ``x``: a node with more than ``leaf_rows``
    distinct rows is split into at most ``branch`` clusters."""
    rng = np.random.default_rng(seed)
    centres, child, children = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [0], [0]
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop(0)
        if len(rows) <= leaf_rows:
            continue
        kids = x[rng.choice(rows, min(branch, len(rows)), replace=False)]
        kids = np.unique(kids, axis=0)
        for _ in range(rounds):
            near = _nearest(x[rows], kids)
            filled = np.unique(near)
            kids = np.stack([x[rows[near == k]].mean(0) for k in filled])
        near = _nearest(x[rows], kids)
        filled = np.unique(near)
        if len(filled) < 2:
            continue
        child[node], children[node] = len(centres), len(filled)
        for k in filled:
            todo.append((len(centres), rows[near == k]))
            centres.append(kids[k])
            child.append(0)
            children.append(0)
    counts = np.array(children)
    leaf = np.where(counts == 0, np.cumsum(counts == 0) - 1, -1)
    return Tree(np.array(centres), np.array(child), counts, leaf)


def nearest_neighbours(
    vectors: DataFrame, queries: Column, k: int = 10, recall: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
    sample: int = 20_000, branch: int = 16, leaf_rows: int = 64, calibration: int = 128, block_rows: int = 20_000,
) -> DataFrame:
    """The ``k`` nearest rows (smallest Euclidean distance) of every row that ``queries`` picks.

    The tree is fitted on at most ``sample`` vectors (by the order of a hash), so it has at
    most ``sample`` leaves; every usable vector is assigned to a leaf. The number of leaves
    to visit is calibrated: for up to ``calibration`` queries the exact neighbours are found
    by comparing them with all rows, and the visits are widened until ``recall`` of these
    neighbours lie in visited leaves. A query visits its leaves in best-bin-first order, at
    least that many, and on until they hold ``k`` other rows; the last ones are exact where
    the table is small. Neighbouring leaves are searched together, up to about ``block_rows`` rows
    in a task; a leaf that holds a third of all vectors is cut into blocks of that size.

    Returns ``query_id``, ``rank`` from 1, the neighbour's id, ``score`` (the distance in
    double precision on the original vectors), nearest first, ties to the smaller id. A
    query is no neighbour of its own row; other rows with an equal vector are. Unusable
    vectors (see :func:`usable`) or ones of another length than the most take no part; rows
    of equal id count as one, the first by vector; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("_v"), queries.alias("_q"), usable(F.col(vector_col)).alias("_ok"))
    rows = rows.where(F.col("_ok") & F.col("_id").isNotNull()).select("_id", "_v", F.coalesce("_q", F.lit(False)).alias("_q"))
    width = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out = StructType([
        StructField("query_id", vectors.schema[id_col].dataType), StructField("rank", IntegerType()),
        StructField(id_col, vectors.schema[id_col].dataType), StructField("score", DoubleType()),
    ])
    if width is None:
        return spark.createDataFrame([], out)
    rows = rows.where(F.size("_v") == width["d"])
    few = rows.where(under_quota(F.xxhash64("_v"), sample, int(width["count"])))
    fitted = few.select("_v").orderBy(place(F.xxhash64("_v")), "_v").limit(sample).collect()
    x = np.unique(np.array([r["_v"] for r in fitted]), axis=0)
    tree = build_tree(x, branch, leaf_rows)

    kind = StructType([StructField("_id", out["query_id"].dataType), StructField("_v", ArrayType(DoubleType())), StructField("_q", rows.schema["_q"].dataType), StructField("_leaf", IntegerType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.assign(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=kind.fieldNames())

    indexed = rows.groupBy("_id").agg(F.min(F.struct("_v", "_q")).alias("_x")).select("_id", "_x._v", "_x._q").mapInArrow(assign, kind)
    indexed = stored(indexed, "ann-index")
    fill = {r["_leaf"]: r["n"] for r in indexed.groupBy("_leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    visits = _calibrated(indexed, tree, k, recall, calibration)

    shard_of, blocks_of = _shards(fill, tree.leaves, block_rows)
    route = StructType([
        StructField("_shard", IntegerType()), StructField("_block", IntegerType()), StructField("_qid", kind["_id"].dataType),
        StructField("_qv", ArrayType(DoubleType())), StructField("_leaves", ArrayType(IntegerType())),
    ])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, block, row, leaves = [], [], [], []
            for i, q in enumerate(_matrix(batch.column(1)) if batch.num_rows else ()):
                seen, wanted = 0, {}
                for n, leaf in enumerate(tree.best_bins(q)):
                    if n >= visits and seen > k:
                        break
                    seen += fill.get(leaf, 0)
                    if fill.get(leaf, 0):
                        wanted.setdefault(int(shard_of[leaf]), []).append(leaf)
                for s, inside in wanted.items():
                    shard += [s] * blocks_of[s]
                    block += range(blocks_of[s])
                    row += [i] * blocks_of[s]
                    leaves += [inside] * blocks_of[s]
            take = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), pa.array(block, pa.int32()), batch.column(0).take(take), batch.column(1).take(take),
                 pa.array(leaves, pa.list_(pa.int32()))], names=route.fieldNames(),
            )

    asked = indexed.where("_q").select("_id", "_v").mapInArrow(walk, route)
    # One row per leaf of the tree, whose number the sample bounds.
    places = spark.createDataFrame(
        [(leaf, int(shard_of[leaf]), blocks_of[int(shard_of[leaf])]) for leaf in sorted(fill)], "_leaf int, _shard int, _blocks int"
    )
    held = indexed.join(F.broadcast(places), "_leaf")
    held = held.select("_shard", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int").alias("_block"), "_id", "_v", "_leaf")
    part = StructType([StructField("query_id", kind["_id"].dataType), StructField("_id", kind["_id"].dataType), StructField("score", DoubleType())])

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": left["_qid"][:0], "_id": right["_id"][:0], "score": pd.Series([], dtype=float)})
        right = right.sort_values("_id", kind="stable")
        x, ids, leaf = np.stack(right["_v"].to_numpy()), right["_id"].to_numpy(), right["_leaf"].to_numpy()
        found = []
        for start in range(0, len(left), 256):
            some = left.iloc[start : start + 256]
            q, own = np.stack(some["_qv"].to_numpy()), some["_qid"].to_numpy()
            open_ = np.stack([np.isin(leaf, inside) for inside in some["_leaves"]])
            for i, (near, far) in enumerate(_closest(x, ids, q, own, k, open_)):
                found.append((np.repeat(own[i : i + 1], len(near)), near, far))
        return pd.DataFrame({"query_id": np.concatenate([f[0] for f in found]), "_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})

    near = asked.groupBy("_shard", "_block").cogroup(held.groupBy("_shard", "_block")).applyInPandas(search, part)
    best = top_per_group(near, ["query_id"], [F.col("score"), F.col("_id")], k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("_id").alias(id_col), "score")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _shards(fill: dict[int, int], leaves: int, block_rows: int) -> tuple[np.ndarray, dict[int, int]]:
    """Shard of every leaf and blocks of every shard: neighbouring leaves together up to
    ``block_rows`` rows, a larger leaf alone in as many blocks as it needs."""
    shard_of, blocks_of, shard, held = np.zeros(leaves, np.int64), {}, -1, block_rows
    for leaf in range(leaves):
        n = fill.get(leaf, 0)
        if held + n > block_rows:
            shard, held = shard + 1, 0
        held += n
        shard_of[leaf] = shard
        blocks_of[shard] = max(1, -(-held // block_rows))
    return shard_of, blocks_of


def _closest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, open_: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query its nearest ``k`` rows but ``own``, among the ``open_`` ones.

    A matrix product gives all distances but for rounding; the rows that it cannot tell
    from the k-th are measured again as the sum of squared differences, and ties settled
    by id. ``ids`` must rise.
    """
    norms, lengths = (x**2).sum(1), (q**2).sum(1)
    rough = norms[None, :] - 2 * (q @ x.T) + lengths[:, None]
    rough[own[:, None] == ids[None, :]] = np.inf
    if open_ is not None:
        rough[~open_] = np.inf
    slack = 1e-12 * x.shape[1] * (norms.max(initial=0) + lengths)
    for i in range(len(q)):
        m = min(k, int(np.isfinite(rough[i]).sum()))
        if m == 0:
            yield ids[:0], rough[i, :0]
            continue
        edge = np.partition(rough[i], m - 1)[m - 1]
        at = np.flatnonzero(rough[i] <= edge + 2 * slack[i])
        d = np.sqrt(((x[at] - q[i]) ** 2).sum(1))
        order = np.lexsort((ids[at], d))[:m]
        yield ids[at][order], d[order]


def _calibrated(indexed: DataFrame, tree: Tree, k: int, recall: float, calibration: int) -> int:
    """Leaves to visit so that ``recall`` of the exact neighbours of some queries are met."""
    queries = indexed.where("_q").select("_id", "_v")
    few = queries.where(under_quota(F.xxhash64("_id"), calibration, queries.count()))
    asked = few.orderBy(place(F.xxhash64("_id")), "_id").limit(calibration).collect()
    if not asked:
        return 1
    ids, qs = [r["_id"] for r in asked], np.array([r["_v"] for r in asked])
    out = StructType([StructField("_query", IntegerType()), StructField("_id", indexed.schema["_id"].dataType), StructField("_d", DoubleType()), StructField("_leaf", IntegerType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, rows = _matrix(batch.column(1)), np.array(batch.column(0).to_pylist())
            order = np.argsort(rows, kind="stable")
            leaf = np.asarray(batch.column(3))[order]
            place = {v: i for i, v in enumerate(rows[order].tolist())}
            nearest = _closest(x[order], rows[order], qs, np.array(ids), k)
            found = [(i, v, d, int(leaf[place[v]])) for i, pair in enumerate(nearest) for v, d in zip(*map(np.ndarray.tolist, pair))]
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.from_numpy_dtype(t) if t else batch.schema.field(0).type) for c, t in zip(columns, (np.int32, None, np.float64, np.int32))], names=out.fieldNames())

    exact = top_per_group(indexed.mapInArrow(compare, out), ["_query"], [F.col("_d"), F.col("_id")], k).select("_query", "_leaf").collect()
    order = [{leaf: n for n, leaf in enumerate(tree.best_bins(q))} for q in qs]
    depth = sorted(order[r["_query"]][r["_leaf"]] for r in exact)
    if not depth:
        return 1
    return depth[min(len(depth) - 1, max(0, int(np.ceil(recall * len(depth))) - 1))] + 1
