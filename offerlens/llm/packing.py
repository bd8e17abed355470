"""Packing token sequences by deficit round-robin over source queues."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from offerlens.llm.cells import hash_cell, running_sum
from offerlens.plans.store import stored

SMALL = 1 << 16


def _tokenized(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Key, id, queue, count and ids of every row. Ids below 2**16 take two bytes each.

    The key is the writing task's number and a counter; it is fixed once the table is
    written, so it is only used from the stored copy.
    """
    given = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_s"), F.col(text_col).alias("_text"))
    out = StructType([
        StructField("_k", LongType()), StructField("_id", given.schema["_id"].dataType), StructField("_src", StringType()),
        StructField("_n", LongType()), StructField("_wide", IntegerType()), StructField("_ids", BinaryType()),
    ])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from offerlens.llm.tokens import byte_runs, encoder

        coder, key = encoder(path, "ids"), TaskContext.get().partitionId() << 40
        for batch in byte_runs(batches, 2):
            n = batch.num_rows
            ids, ends = coder.arrays(batch.column(2).fill_null(""))
            ids, edges = np.insert(ids, ends, np.uint32(end_id)), np.append(0, ends + np.arange(1, n + 1))
            wide = (np.maximum.reduceat(ids, edges[:-1]) >= SMALL) if n else np.zeros(0, bool)
            if wide.any():
                packed = pa.array([ids[a:b].astype("<u4" if w else "<u2").tobytes() for a, b, w in zip(edges, edges[1:], wide)], pa.binary())
            else:
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * edges).astype("<i4")), pa.py_buffer(ids.astype("<u2"))])
            queues = ["z" if s is None else "a" + s for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(key, key + n)), batch.column(0), pa.array(queues, pa.string()), pa.array(np.diff(edges)),
                 pa.array(np.where(wide, 4, 2).astype(np.int32)), packed],
                names=out.fieldNames(),
            )
            key += n
        coder.rest()

    return given.mapInArrow(encode, out)


def pack(
    docs: DataFrame, tokenizer_path: str, length: int = 2048, packet: int = 256, weights: DataFrame | None = None, end_id: int = 1,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Sequences of ``length`` tokens whose mixture of sources follows target proportions.

    Every source is a queue of packets: its documents in the order of a hash, cut into at
    most ``packet`` tokens. A round is one window; each round adds ``length`` times its
    proportion to a source's credit, and the source sends the packets its credit covers.
    What a packet still lacks is the deficit carried on, so after every round each source
    has sent its target less than one packet. A queue that is never empty before its end
    sends packet p in round ceil(end(p) / quantum), which needs no state: all rounds are
    found at once, and partitions carry deficits over exactly. Packets in the order
    (round, queue) fill the windows without a gap; only the last window has padding.

    ``weights`` (``source``, ``weight``) sets the proportions; without it each source has
    its own share of all tokens, so that all queues end together. With weights, a queue
    that ends early leaves its place to the others; a source without a weight gets 1.

    Returns pieces: id, ``source``, ``start`` and ``length`` in the document's ids,
    ``doc_tokens`` (with the end id), ``sequence_id``, ``offset``, ``ids`` (unsigned 32-bit,
    little-endian). A null or empty text is its end id alone; a null source is a queue of
    its own; repeated rows are packed one by one; an empty table gives an empty result.
    Other columns are ignored. ``packet`` must not exceed ``length``.
    """
    if not 0 < packet <= length:
        raise ValueError("packet must be between 1 and length")
    tokens = stored(_tokenized(docs, tokenizer_path, end_id, id_col, text_col, source_col), "pack-ids")
    narrow = tokens.select("_k", "_src", "_n", F.xxhash64("_id", "_n", "_k").alias("_o")).withColumn("_cell", hash_cell(F.col("_o")))
    queues = narrow.groupBy("_src").agg(F.sum("_n").alias("_all"))
    if weights is None:
        queues = queues.withColumn("_w", F.col("_all").cast("double"))
    else:
        named = weights.select(F.coalesce(F.concat(F.lit("a"), "source"), F.lit("z")).alias("_src"), F.col("weight").cast("double").alias("_w"))
        queues = queues.join(named, "_src", "left").withColumn("_w", F.coalesce("_w", F.lit(1.0)))
    share = F.col("_w") / F.sum("_w").over(Window.partitionBy())
    queues = queues.select("_src", (share * length).alias("_quantum"))
    placed = running_sum(narrow, ["_src"], "_cell", ["_o", "_k"], "_n", "_at").drop("_cell", "_o").join(queues, "_src")
    packets = placed.select("_k", "_src", "_n", "_at", "_quantum", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / packet))).alias("_i"))
    packets = packets.select(
        "_k", "_src", "_at", "_quantum", (F.col("_i") * packet).alias("_start"), F.least(F.lit(packet), F.col("_n") - F.col("_i") * packet).cast("bigint").alias("_len"),
    )
    ends = F.col("_at") + F.col("_start") + F.col("_len")
    packets = packets.withColumn("_round", F.ceil(ends / F.col("_quantum")).cast("bigint")).withColumn("_axis", ends)
    packets = packets.withColumn("_cell", F.shiftright("_round", 4)).drop("_quantum", "_at")
    packets = running_sum(packets, [], "_cell", ["_round", "_src", "_axis"], "_len", "_pos")
    room = length - F.col("_pos") % length
    first = F.struct(F.col("_start").alias("start"), F.least("_len", room).alias("length"), F.col("_pos").alias("pos"))
    rest = F.struct((F.col("_start") + room).alias("start"), (F.col("_len") - room).alias("length"), (F.col("_pos") + room).alias("pos"))
    parts = F.when(F.col("_len") > room, F.array(first, rest)).otherwise(F.array(first))
    pieces = packets.groupBy("_k").agg(F.sort_array(F.flatten(F.collect_list(parts))).alias("_pieces"))
    joined = tokens.join(pieces, "_k").select("_id", "_src", "_n", "_wide", "_ids", "_pieces")
    out = StructType([
        StructField(id_col, joined.schema["_id"].dataType), StructField("source", StringType()), StructField("start", LongType()),
        StructField("length", LongType()), StructField("doc_tokens", LongType()), StructField("sequence_id", LongType()),
        StructField("offset", LongType()), StructField("ids", BinaryType()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            row_of = []
            for row, (src, n, wide, raw, pieces_) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(1, 6)))):
                ids = np.frombuffer(raw, f"<u{wide}").astype("<u4")
                joined_: list[list[int]] = []
                for p in pieces_:
                    # Packets sent one after the other stand next to each other: one piece.
                    last = joined_[-1] if joined_ else None
                    if last and last[2] + last[1] == p["pos"] and p["pos"] % length:
                        last[1] += p["length"]
                    else:
                        joined_.append([p["start"], p["length"], p["pos"]])
                for start, size, pos in joined_:
                    row_of.append(row)
                    values = (src[1:] if src[0] == "a" else None, start, size, n, pos // length, pos % length, ids[start : start + size].tobytes())
                    for column, value in zip(columns, values):
                        column.append(value)
            kinds = [f.dataType for f in out.fields[1:]]
            arrow = {LongType: pa.int64(), StringType: pa.string(), BinaryType: pa.binary()}
            arrays = [pa.array(c, arrow[type(k)]) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row_of, pa.int32())), *arrays], names=out.fieldNames())

    return joined.mapInArrow(cut, out)
