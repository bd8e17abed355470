"""Merkle trees over the rows of a table, stored as blocks in van Emde Boas order."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.plans.store import stored

ARITY = 3
#: Levels of edges in a block: 3**6 leaves and 1,093 nodes of 32 bytes, 35 KB.
HEIGHT = 6
#: Every power of the arity a long can hold; a tree of n leaves is as high as there are smaller ones than n.
POWERS = [ARITY**i for i in range(40)]
TOP = "top"


@cache
def addresses(height: int) -> tuple[np.ndarray, ...]:
    """Place of each node of a complete tree, one array per depth, in van Emde Boas order.

    A tree of ``height + 1`` levels is cut at half its levels: the upper tree comes first, then
    the lower trees from left to right, each laid out in the same way. A subtree of any size
    therefore lies in few consecutive stretches.
    """
    levels = height + 1
    if levels == 1:
        return (np.zeros(1, np.int64),)
    upper = levels // 2
    above, below = addresses(upper - 1), addresses(levels - upper - 1)
    size = lambda n: (ARITY**n - 1) // (ARITY - 1)
    bases = size(upper) + np.arange(ARITY**upper, dtype=np.int64) * size(levels - upper)
    return (*above, *((bases[:, None] + places[None, :]).ravel() for places in below))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


class Block:
    """An aligned subtree: digests at their places; the first ``n`` leaves are filled."""

    def __init__(self, nodes: bytearray, height: int, n: int) -> None:
        self.nodes, self.height, self.n = nodes, height, n

    @classmethod
    def of(cls, leaves: Sequence[bytes], height: int) -> Block:
        place = addresses(height)
        block = cls(bytearray(32 * (int(place[-1].max()) + 1)), height, len(leaves))
        row = [d.hex() for d in leaves]
        for depth in range(height, -1, -1):
            for j, (at, d) in enumerate(zip(place[depth].tolist(), row)):
                block.nodes[32 * at : 32 * at + 32] = bytes.fromhex(d)
            row = [digest("".join(row[i : i + ARITY])) for i in range(0, len(row), ARITY)]
        return block

    @property
    def root(self) -> bytes:
        return bytes(self.nodes[:32])

    def width(self, depth: int) -> int:
        """Filled nodes of a depth."""
        return -(-self.n // ARITY ** (self.height - depth))

    def read(self, depth: int, first: int, last: int) -> list[str]:
        place = addresses(self.height)[depth]
        return [self.nodes[32 * at : 32 * at + 32].hex() for at in place[first:last].tolist()]

    def paths(self) -> list[list[tuple[str, str]]]:
        """For each leaf, the digests left and right of it in its run, level by level."""
        found: list[list[tuple[str, str]]] = [[] for _ in range(self.n)]
        for depth in range(self.height, 0, -1):
            wide = self.width(depth)
            step = ARITY ** (self.height - depth)
            for first in range(0, wide, ARITY):
                run = self.read(depth, first, min(first + ARITY, wide))
                for k in range(len(run)):
                    sides = ("".join(run[:k]), "".join(run[k + 1 :]))
                    for leaf in range((first + k) * step, min((first + k + 1) * step, self.n)):
                        found[leaf].append(sides)
        return found


def fold(leaf: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that a leaf leads to with the given siblings."""
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


class Manifest(NamedTuple):
    """Stored tables of the trees: ``leaves`` (_tree, _idx, _leaf and what else was given),
    ``levels`` (blocks of all trees, lowest level first), ``subroots`` (_tree, _digest, _idx),
    ``top`` (blocks over the subroots) and the one ``root`` (None for no leaf)."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    root: bytes | None


def field(value: Column) -> Column:
    """A value with its length in UTF-8 bytes before it, or ``-``: no two rows read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


def tree_key(name: Column) -> Column:
    """A key without nulls that sorts like the name, null first, by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("1"), name.cast("string")), F.lit("0"))


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``_idx``, the 0-based place of each row in its ``_tree`` under ``order``, and ``_n``.

    The rows are range-sorted by tree and order, so a hot tree is spread over many tasks. The
    sort is written with its row numbers; then each task's first number and count per tree
    give the offsets. A tree has one such row per task.
    """
    # The place of the digits: the partition in the upper bits, the row in the lower 33.
    rows = stored(df.orderBy("_tree", *order).withColumn("_mid", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("_task", F.shiftright("_mid", 33))
    runs = rows.groupBy("_tree", "_task").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy("_tree")
    before = F.sum("_c").over(whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_tree", "_task", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_c").over(whole).alias("_n"))
    return rows.join(runs, ["_tree", "_task"]).withColumn("_idx", F.col("_mid") + F.col("_shift")).drop("_mid", "_task", "_shift")


BLOCKS = "_tree string, _block long, _height int, _left int, _n int, _nodes binary, _root binary"


def _grow(rows: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Blocks over (_tree, _idx, _digest, _left), level by level, and the roots of all trees.

    ``_left`` is the height that the tree still has above a row. A level takes up to
    ``HEIGHT`` of it; block roots are the rows of the next level.
    """
    levels, done = [], rows.where("_left = 0").select("_tree", "_digest")
    highest = rows.agg(F.max("_left")).first()[0] or 0
    while highest > 0:
        step = F.least(F.lit(HEIGHT), F.col("_left"))
        width = F.element_at(F.array(*[F.lit(p) for p in POWERS[: HEIGHT + 1]]), step + 1)
        part = rows.where("_left > 0").select("_tree", "_idx", "_digest", "_left", step.alias("_height"), F.floor(F.col("_idx") / width).alias("_block"))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_idx")
            height = int(pdf["_height"].iloc[0])
            block = Block.of(pdf["_digest"].tolist(), height)
            head = pdf.iloc[0]
            return pd.DataFrame([(head["_tree"], head["_block"], height, head["_left"] - height, block.n, bytes(block.nodes), block.root)], columns=[c.split()[0] for c in BLOCKS.split(", ")])

        blocks = stored(part.groupBy("_tree", "_block").applyInPandas(build, BLOCKS), f"{name}-{len(levels)}")
        levels.append(blocks)
        rows = blocks.select("_tree", F.col("_block").alias("_idx"), F.col("_root").alias("_digest"), "_left")
        done = done.unionByName(rows.where("_left = 0").select("_tree", "_digest"))
        highest -= HEIGHT
    return levels, done


def _height(n: Column) -> Column:
    return F.size(F.filter(F.array(*[F.lit(p) for p in POWERS]), lambda p: p < n))


def merkle_manifest(leaves: DataFrame, order: Sequence[str]) -> Manifest:
    """Trees over rows with a ``_tree`` key (not null) and a ``_leaf`` of 32 bytes.

    Leaves of a tree follow ``order``, then their digests, so equal places hold equal leaves.
    Three consecutive nodes become their digest while a tree has several; the roots, in the
    order of their keys, are the leaves of one more tree. A tree is cut into aligned blocks
    of ``HEIGHT`` levels; only block roots go up, so no task or driver holds a tree.
    """
    rows = numbered(leaves, [*order, "_leaf"], "merkle-leaves").withColumn("_left", _height(F.col("_n"))).drop("_n")
    levels, roots = _grow(rows.withColumnRenamed("_leaf", "_digest"), "merkle-level")
    # The key of a tree is its order among the subroots.
    tops = numbered(roots.select(F.lit(TOP).alias("_tree"), F.col("_tree").alias("_of"), "_digest"), ["_of"], "merkle-subroots")
    tops = tops.withColumn("_left", _height(F.col("_n"))).drop("_n")
    top, last = _grow(tops, "merkle-top")
    root = last.first()
    subroots = tops.select(F.col("_of").alias("_tree"), "_digest", "_idx")
    return Manifest(rows, levels, subroots, top, bytes(root["_digest"]) if root else None)


PATH = "array<struct<l:string,r:string>>"


def _descend(levels: list[DataFrame], above: DataFrame | None, lowest: int) -> DataFrame | None:
    """Paths of the rows of level ``lowest`` (_tree, _idx, _above) from the root down.

    A block of the last level of its tree starts with what lies above the tree (``above``:
    _tree, _above), any other with the path of its own root one level up.
    """
    path = None
    for at in range(len(levels) - 1, lowest - 1, -1):
        path = _leaf_paths(_with_above(levels[at], path, above))
    return path


def _with_above(blocks: DataFrame, path: DataFrame | None, above: DataFrame | None) -> DataFrame:
    none = F.array().cast(PATH)
    last = blocks.where("_left = 0")
    last = last.join(above, "_tree") if above is not None else last.withColumn("_above", none)
    if path is None:
        return last
    lower = blocks.where("_left > 0").join(path.withColumnRenamed("_idx", "_block"), ["_tree", "_block"])
    return last.unionByName(lower)


def _leaf_paths(blocks: DataFrame) -> DataFrame:
    def spread(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False, name=None):
                tree, block, height, n, nodes, above = r
                higher = [(p["l"], p["r"]) for p in above]
                paths = Block(bytearray(nodes), height, n).paths()
                first = block * ARITY**height
                yield pd.DataFrame({
                    "_tree": [tree] * n, "_idx": range(first, first + n),
                    "_above": [[{"l": a, "r": b} for a, b in [*p, *higher]] for p in paths],
                })

    return blocks.select("_tree", "_block", "_height", "_n", "_nodes", "_above").mapInPandas(spread, f"_tree string, _idx long, _above {PATH}")


def proofs(manifest: Manifest, presented: str | None = None, siblings: bool = False) -> DataFrame:
    """Each leaf with the digest of its siblings and the root that its presented digest folds to.

    Adds ``subroot``, ``root``, ``proof_sha256`` and ``folded_root`` (hex) to the leaves, and
    ``siblings`` (level by level, left and right of the path) if asked. ``presented`` names a
    column of 32 bytes; where it is null, and without it, the leaf itself is folded. The
    siblings come out of the stored blocks: a block and its leaves meet in one task, with
    the path above the block; nothing else of the tree is read there.
    """
    leaves, root = manifest.leaves, manifest.root
    if root is None:
        empty = leaves.select(*leaves.columns, *[F.lit(None).cast("string").alias(c) for c in ("subroot", "root", "proof_sha256", "folded_root")])
        return empty.withColumn("siblings", F.lit(None).cast(PATH)) if siblings else empty
    over = _descend(manifest.top, None, 0)
    if over is None:
        over = manifest.subroots.select(F.lit(TOP).alias("_tree"), "_idx", F.array().cast(PATH).alias("_above"))
    above = manifest.subroots.join(over.drop("_tree"), "_idx").select("_tree", "_above", F.lower(F.hex("_digest")).alias("_subroot"))
    given = F.coalesce(F.col(presented), F.col("_leaf")) if presented else F.col("_leaf")
    width = F.element_at(F.array(*[F.lit(p) for p in POWERS[: HEIGHT + 1]]), F.least(F.lit(HEIGHT), F.col("_left")) + 1)
    rows = leaves.withColumn("_given", given).withColumn("_block", F.floor(F.col("_idx") / width))
    kept = [c for c in leaves.columns if c != "_left"]
    extra = [("_tree", "string"), ("_idx", "long"), ("proof_sha256", "string"), ("folded_root", "string"), *([("siblings", PATH)] if siblings else [])]
    schema = ", ".join(f"{name} {kind}" for name, kind in extra)
    names = [name for name, _ in extra]

    def one(tree, idx, leaf: bytes, path):
        told = (tree, idx, digest("".join(a + b for a, b in path)), fold(leaf.hex(), path))
        return (*told, [{"l": a, "r": b} for a, b in path]) if siblings else told

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tree, block, height, n, nodes, higher in right.itertuples(index=False, name=None):
            higher = [(p["l"], p["r"]) for p in higher]
            paths = Block(bytearray(nodes), height, n).paths()
            first = block * ARITY**height
            for idx, leaf in zip(left["_idx"].tolist(), left["_given"].tolist()):
                out.append(one(tree, idx, leaf, paths[idx - first] + higher))
        return pd.DataFrame(out, columns=names)

    blocks = None
    if manifest.levels:
        path = _descend(manifest.levels, above.drop("_subroot"), 1)
        blocks = _with_above(manifest.levels[0], path, above.drop("_subroot"))
    alone = rows.where("_left = 0").join(above.select("_tree", "_above"), "_tree")

    def single(batches):
        for pdf in batches:
            told = [one(t, i, g, [(p["l"], p["r"]) for p in a]) for t, i, g, a in pdf.itertuples(index=False, name=None)]
            yield pd.DataFrame(told, columns=names)

    found = alone.select("_tree", "_idx", "_given", "_above").mapInPandas(single, schema)
    if blocks is not None:
        asked = rows.where("_left > 0").select("_tree", "_block", "_idx", "_given").groupBy("_tree", "_block")
        held = blocks.select("_tree", "_block", "_height", "_n", "_nodes", "_above").groupBy("_tree", "_block")
        found = found.unionByName(asked.cogroup(held).applyInPandas(meet, schema))
    told = leaves.select(*kept).join(found, ["_tree", "_idx"])
    told = told.join(above.select("_tree", F.col("_subroot").alias("subroot")), "_tree").withColumn("root", F.lit(root.hex()))
    return told


def document_leaves(docs: DataFrame, columns: Sequence[str], tree_col: str, id_col: str, tampered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """Leaves of table rows: ``_tree``, ``_id``, ``_leaf`` over ``columns``, and ``_shown``.

    ``tampered`` replaces columns by what somebody presents in their place where ``when``
    holds; ``_shown`` is then the digest of that, else null. Only digests leave the scan.
    """
    row = lambda swap: row_digest(*[swap.get(c, docs[c]) for c in columns])
    shown = F.when(when, row(tampered)) if tampered else F.lit(None).cast("binary")
    return docs.select(tree_key(docs[tree_col]).alias("_tree"), docs[id_col].alias("_id"), row({}).alias("_leaf"), shown.alias("_shown"))
