"""Removal of repeated byte strings with a distributed sparse suffix array."""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.sampling import place, under_quota
from offerlens.llm.words import mix, range_hash, text_bytes
from offerlens.plans.store import stored

GRAM = 8
_B = 0x9E3779B97F4A7C15
#: Bytes of text looked at together; a longer text is looked at in such pieces.
PIECE = 1 << 20
SMALL = 2048
#: Suffixes whose sides are gathered together.
ROWS = 1 << 15
LOWEST = -(1 << 63)
#: Marks have 48 bits: two of them that agree by chance only make one more candidate.
MARK = np.uint64((1 << 48) - 1)
SHORT = (1 << 24) - 1


class Anchors(NamedTuple):
    """Suffixes that stand for windows: row of the text, byte place in it, the least and
    greatest distance from a window's start to the anchor, and two marks (-1: none).

    ``ahead`` marks the gram and half of what a window has beside it to the right, ``back``
    the gram and half of it to the left. A window holds at least one of the two whole, so
    two anchors without a common mark share no window.
    """

    row: np.ndarray
    at: np.ndarray
    near: np.ndarray
    far: np.ndarray
    ahead: np.ndarray
    back: np.ndarray


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place, by doubling."""
    h, width, power = data.astype(np.uint64) + np.uint64(1), 1, _B
    while width < GRAM:
        h = h[:-width] * np.uint64(power) + h[width:]
        width, power = 2 * width, power * power % (1 << 64)
    return mix(h)


def _least_of_next(h: np.ndarray, count: int) -> np.ndarray:
    """For each place, the distance to the first least value among the next ``count``."""
    value, offset, width = h, np.zeros(len(h), np.uint8), 1
    while width < count:
        step = min(width, count - width)
        later = value[step:] < value[:-step]
        offset = np.where(later, offset[step:] + np.uint8(step), offset[:-step])
        value = np.minimum(value[:-step], value[step:])
        width += step
    return offset


def anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> Anchors:
    """Anchors of all windows of ``length`` bytes of all texts.

    The anchor of a window is the first of the least-hashed grams inside it. It follows from
    the window's bytes alone, so equal windows have it at the same distance: comparing
    suffixes at anchors, with what stands left of them, finds every equal window. Windows in
    a row share an anchor; about one byte in ``(length - GRAM + 2) / 2`` is one, and a row of
    the result stands for as many windows.
    """
    out: list[tuple[np.ndarray, ...]] = []
    sizes = np.diff(bounds)
    rows = np.flatnonzero(sizes >= length)
    i = 0
    while i < len(rows):
        # Neighbouring texts together, or one long text in pieces of window starts.
        j = i + 1
        while j < len(rows) and bounds[rows[j] + 1] - bounds[rows[i]] <= PIECE:
            j += 1
        first, last = int(bounds[rows[i]]), int(bounds[rows[j - 1] + 1])
        for a in range(first, max(last - length + 1, first + 1), PIECE):
            b = min(last, a + PIECE + length - 1)
            h = _gram_hashes(data[a:b])
            offset = _least_of_next(h, length - GRAM + 1)
            starts = np.arange(a, a + len(offset))
            row = np.searchsorted(bounds, starts, "right") - 1
            inside = starts + length <= bounds[row + 1]
            starts, row = starts[inside], row[inside]
            at = starts + offset[inside]
            if not len(at):
                continue
            new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
            end = np.concatenate([new[1:], [len(at)]]) - 1
            near, far, place = at[new] - starts[end], at[new] - starts[new], at[new] - a
            values = data[a:b].astype(np.uint64) + np.uint64(1)
            half = (length - GRAM) // 2
            ahead, back = np.full(len(new), -1), np.full(len(new), -1)
            pick = near <= half
            ahead[pick] = (range_hash(values, place[pick], place[pick] + length - half) & MARK).astype(np.int64)
            pick = far > half
            back[pick] = (mix(range_hash(values, place[pick] - half - 1, place[pick] + GRAM)) & MARK).astype(np.int64)
            out.append((row[new], at[new] - bounds[row[new]], near, far, ahead, back))
        i = j
    if not out:
        return Anchors(*[np.zeros(0, np.int64)] * 6)
    return Anchors(*[np.concatenate(c) for c in zip(*out)])


def _context(data: np.ndarray, at: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """Bytes from each place onward (``step`` 1) or backward (-1), padded with zeros."""
    k = np.arange(width)
    out = np.zeros((len(at), width), np.uint8)
    for lo in range(0, len(at) if len(data) else 0, ROWS):
        part = slice(lo, lo + ROWS)
        places = at[part, None] + (k if step > 0 else -1 - k)[None, :]
        np.clip(places, 0, max(0, len(data) - 1), out=places)
        np.copyto(out[part], data[places], where=k[None, :] < size[part, None])
    return out


def multikey_order(keys: np.ndarray) -> np.ndarray:
    """Sorted order of byte strings of equal width, by multikey quicksort.

    A character is eight bytes. A part is split in three by one character of a pivot: less,
    equal, more; only the equal part goes on to the next character. Parts of at most
    ``SMALL`` strings are finished by a sort of the characters that are left.
    """
    n, width = keys.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = keys
    chars = padded.view(">u8").astype(np.uint64)
    order, stack = np.arange(n), [(0, n, 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2 or depth == chars.shape[1]:
            continue
        part = order[lo:hi]
        if hi - lo <= SMALL:
            order[lo:hi] = part[np.lexsort(chars[part, depth:].T[::-1])]
            continue
        char = chars[part, depth]
        few = np.sort(char[:: len(char) // 9])
        pivot = few[len(few) // 2]
        less, more = char < pivot, char > pivot
        a, b = lo + int(less.sum()), hi - int(more.sum())
        order[lo:hi] = np.concatenate([part[less], part[~(less | more)], part[more]])
        stack += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def _neighbours(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each sorted row with the one before; 0 for the first."""
    if len(order) < 2:
        return np.zeros(len(order), np.int64)
    return np.concatenate([[0], _shared(keys[order[1:]], keys[order[:-1]])])


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``_o`` (its order: a null id counts as the smallest long), ``_text``, ``_h``."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].alias("_id"), F.coalesce(docs[id_col].cast("bigint"), F.lit(LOWEST)).alias("_o"), text.alias("_text"), F.hash(text).alias("_h"))


def _copies(rows: DataFrame) -> DataFrame:
    """Per order, the hashes (_hs) of its texts that a text of smaller order equals whole.

    Texts meet by digest, already reduced to one row per task and digest. Of equal texts only
    the first is searched: the others go whole, and add nothing to what the first one shows.
    """
    told = rows.select("_o", "_h", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("_d"))
    first = told.groupBy("_d").agg(F.min("_o").alias("_first"), F.max("_o").alias("_last")).where("_first < _last").select("_d", "_first")
    return told.join(first, "_d").where("_o > _first").groupBy("_o").agg(F.collect_set("_h").alias("_hs"))


def _key_texts(right: np.ndarray, left: np.ndarray) -> np.ndarray:
    keys = np.ascontiguousarray(np.hstack([right, left]))
    return keys.view(f"S{keys.shape[1]}").ravel()


def _marks(found: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """Index of the suffix and mark, for every mark there is."""
    mark = np.concatenate([found.ahead, found.back])
    which = np.concatenate([np.arange(len(found.row))] * 2)
    return which[mark >= 0], mark[mark >= 0]


def _sampled(rows: DataFrame, length: int, docs: int, total: int) -> DataFrame:
    """Suffixes of about ``docs`` texts chosen by a hash: mark, order of the text, sort key."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch["_text"])
            found = anchors(data, bounds, length)
            for lo in range(0, len(found.row), ROWS):
                part = Anchors(*[c[lo : lo + ROWS] for c in found])
                keys = np.hstack(_sides(data, bounds, part, length))
                which, mark = _marks(part)
                whole = _ragged(keys[which], np.full(len(which), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(mark), pa.array(batch["_o"].to_numpy()[part.row[which]]), whole], names=["_g", "_o", "_k"])

    chosen = rows.where(under_quota(F.xxhash64("_o", "_h"), docs, total)).select("_o", "_text")
    return chosen.mapInArrow(cut, "_g long, _o long, _k binary")


def _sides(data: np.ndarray, bounds: np.ndarray, found: Anchors, length: int) -> tuple[np.ndarray, np.ndarray]:
    """What the anchor's windows hold from the anchor on, and, reversed, left of it."""
    at = bounds[found.row] + found.at
    return _context(data, at, length - found.near, length, 1), _context(data, at, found.far, length - GRAM, -1)


def _separator(keys: list[bytes], at: int, slack: int) -> bytes:
    """The shortest key that cuts sorted ``keys`` within ``slack`` places of ``at``.

    It ends with the first byte that tells its two neighbours apart, so few suffixes share
    more with it. Where all keys around are one, that key itself.
    """
    best = (len(keys[at]), 0, at)
    for p in range(max(1, at - slack), min(len(keys), at + slack + 1)):
        common = len(os.path.commonprefix([keys[p - 1], keys[p]]))
        best = min(best, (common, abs(p - at), p))
    return keys[best[2]][: best[0] + 1]


def _splitters(sample: DataFrame, buckets: int, at_least: int) -> list[bytes]:
    """Sort keys that cut the suffixes into ``buckets`` ranges, repeated where one key is hot.

    Half of them are quantiles of marks seen in several sampled texts, half of all marks:
    frequent passages and rare pairs both fall into ranges of their own weight. A splitter
    stands within half a range of its quantile, where neighbours differ soonest: only
    suffixes that share a gram or more with a splitter have windows in two ranges, and their
    number must not follow the number of splitters. The driver gets at most about eight keys
    a bucket, or ``at_least``.
    """
    if buckets < 2:
        return []
    wanted = max(at_least, 8 * buckets)
    shared = sample.groupBy("_g").agg((F.min("_o") < F.max("_o")).alias("_many"))
    marked = sample.join(shared, "_g")
    whole: list[bytes] = []
    short: set[bytes] = set()
    for rows in (marked.where("_many"), marked):
        n = rows.count()
        spread = F.xxhash64("_k", "_o")
        held = rows.where(under_quota(spread, wanted, n)).orderBy(place(spread)).limit(wanted).select("_k").collect()
        keys = sorted(bytes(r["_k"]) for r in held)
        parts = buckets // 2 + 1
        for i in range(1, parts) if keys else ():
            cut = _separator(keys, i * len(keys) // parts, len(keys) // (2 * parts))
            # A shortened key stands once: only a whole one may be hot.
            if len(cut) == len(keys[0]):
                whole.append(cut)
            else:
                short.add(cut)
    return sorted([*whole, *(short - {c.rstrip(b"\0") for c in whole})])


def _hot(sample: DataFrame, docs: int) -> np.ndarray:
    """Marks in at least a 256th of the sampled texts, and in two of them: surely shared."""
    counts = sample.groupBy("_g").agg(F.countDistinct("_o").alias("_n"))
    found = counts.where(F.col("_n") >= max(2, docs // 256)).orderBy(F.desc("_n"), "_g").limit(1 << 16).collect()
    return np.sort(np.array([r["_g"] for r in found], np.int64))


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _shared_marks(rows: DataFrame, length: int, hot: np.ndarray, partitions: int) -> DataFrame:
    """For each order of a text, the marks of its anchors that a text of another order has too.

    A text sends each of its marks once. They are sorted by mark and order inside hash
    partitions, and a pass over the sorted stream keeps those that change the order within a
    mark. Hot marks, known from the sample, are left out here, so no mark fills a partition.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch["_text"])
            found = anchors(data, bounds, length)
            which, mark = _marks(found)
            keep = ~_among(mark, hot)
            row, mark = found.row[which[keep]], mark[keep]
            by = np.lexsort((mark, row))
            row, mark = row[by], mark[by]
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (mark[1:] != mark[:-1])]) if len(row) else np.zeros(0, bool)
            # The mark comes last: its two empty bytes run on into the next row's head.
            yield pa.RecordBatch.from_arrays([pa.array(batch["_o"].to_numpy()[row[new]]), pa.array(mark[new])], names=["_o", "_g"])

    # What goes back is a mark's last bits: within one text they tell it well enough.
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last mark of a batch, its first order, and whether that row has gone out.
        mark, order, sent = None, 0, True
        for batch in batches:
            g, o = batch["_g"].to_numpy(), batch["_o"].to_numpy()
            if not len(g):
                continue
            if mark is not None and not sent and g[0] == mark:
                g, o = np.concatenate([[mark], g]), np.concatenate([[order], o])
            start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            end = np.concatenate([start[1:], [len(g)]])
            many = o[start] != o[end - 1]
            goes_on = mark is not None and g[0] == mark
            many[0] |= goes_on and sent
            keep = np.repeat(many, end - start)
            order = order if goes_on and len(start) == 1 else o[start[-1]]
            mark, sent = g[-1], bool(many[-1])
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(o[keep]), pa.array((g[keep] & SHORT).astype(np.int32))], names=["_o", "_g"])

    marks = rows.mapInArrow(cut, "_o long, _g long").repartition(partitions, "_g").sortWithinPartitions("_g", "_o")
    return marks.mapInArrow(stream, "_o long, _g int").groupBy("_o").agg(F.collect_set("_g").alias("_gs"))


SUFFIX = "_b int, _o long, _h int, _place long, _run long, _key binary"


def _suffixes(rows: DataFrame, length: int, hot: np.ndarray, splitters: list[bytes]) -> DataFrame:
    """The suffixes at anchors with a shared mark, with their range.

    ``_place`` packs the place and the two distances, ``_key`` is the right side followed by
    the reversed left one. Equal suffixes that follow each other closely in a periodic text
    are one row; ``_run`` is the way from the first to the last.
    """
    width = 2 * length - GRAM
    cuts = np.array(splitters, f"S{width}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch["_text"])
            found = anchors(data, bounds, length)
            lists = batch["_gs"]
            known, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
            size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), size, 0)
            owner = np.repeat(np.arange(len(lists)), size)
            ahead, back = (_among(m, hot) | ((m >= 0) & _pairs_in(found.row, m & SHORT, owner, known)) for m in (found.ahead, found.back))
            # Without the one mark only windows that hold the other whole can be shared.
            half = (length - GRAM) // 2
            found = found._replace(far=np.where(back, found.far, np.minimum(found.far, half)), near=np.where(ahead, found.near, np.maximum(found.near, half + 1)))
            keep = (ahead | back) & (found.near <= found.far)
            found = Anchors(*[c[keep] for c in found])
            for lo in range(0, len(found.row), ROWS):
                part = Anchors(*[c[lo : lo + ROWS] for c in found])
                right, left = _sides(data, bounds, part, length)
                near = np.diff(part.at) <= length - GRAM
                same = (right[1:] == right[:-1]).all(1) & (left[1:] == left[:-1]).all(1) & near
                for c in (part.row, part.near, part.far):
                    same &= c[1:] == c[:-1]
                first = np.flatnonzero(np.concatenate([[True], ~same]))
                last = np.concatenate([first[1:], [len(part.row)]]) - 1
                keys = _key_texts(right[first], left[first])
                # Sorted rows of a range stand together and pack well.
                by = np.argsort(keys, kind="stable")
                first, last, keys = first[by], last[by], keys[by]
                order, text = batch["_o"].to_numpy()[part.row[first]], batch["_h"].to_numpy()[part.row[first]]
                below, upto = np.searchsorted(cuts, keys, "left"), np.searchsorted(cuts, keys, "right")
                # Rows at a repeated splitter are dealt over its ranges.
                spread = (mix(order.astype(np.uint64)) % np.maximum(upto - below, 1).astype(np.uint64)).astype(np.int64)
                bucket = np.where(upto > below, below + 1 + spread, upto)
                n_right, n_left = length - part.near[first], part.far[first]
                sides = np.hstack([right[first], left[first]])
                inside = np.hstack([np.arange(length)[None, :] < n_right[:, None], np.arange(length - GRAM)[None, :] < n_left[:, None]])
                place = part.at[first] << 16 | part.near[first] << 8 | part.far[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.astype(np.int32)), pa.array(order), pa.array(text), pa.array(place), pa.array(part.at[last] - part.at[first]), _bytes_column(sides[inside], n_right + n_left)],
                    names=[c.split()[0] for c in SUFFIX.split(", ")],
                )

    return rows.mapInArrow(cut, SUFFIX)


def _pairs_in(row: np.ndarray, mark: np.ndarray, known_row: np.ndarray, known_mark: np.ndarray) -> np.ndarray:
    """True for the pairs (row, mark) that stand in the known ones."""
    rows, marks = np.concatenate([known_row, row]), np.concatenate([known_mark, mark])
    order = np.lexsort((marks, rows))
    r, g = rows[order], marks[order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (g[1:] != g[:-1])]) if len(r) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    has = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
    has[group[order < len(known_row)]] = True
    out = np.zeros(len(rows), bool)
    out[order] = has[group]
    return out[len(known_row) :]


def _ragged(table: np.ndarray, size: np.ndarray) -> pa.Array:
    """The first ``size`` bytes of each row as a binary column."""
    return _bytes_column(table[np.arange(table.shape[1])[None, :] < size[:, None]], size)


def _bytes_column(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


class Suffixes(NamedTuple):
    """Rows of one range: order and hash of the text, place, run, distances, padded sides."""

    order: np.ndarray
    text: np.ndarray
    at: np.ndarray
    run: np.ndarray
    near: np.ndarray
    far: np.ndarray
    right: np.ndarray
    left: np.ndarray


def _read(table: pa.Table, length: int) -> Suffixes:
    order, text, place, run = (table[c].to_numpy() for c in ("_o", "_h", "_place", "_run"))
    at, near, far = place >> 16, place >> 8 & 255, place & 255
    key = table["_key"].cast(pa.large_binary()).combine_chunks()
    key = key.chunk(0) if isinstance(key, pa.ChunkedArray) else key
    start = np.frombuffer(key.buffers()[1], np.int64)[key.offset : key.offset + len(key)]
    data = np.frombuffer(key.buffers()[2], np.uint8)
    right = _context(data, start, length - near, length, 1)
    return Suffixes(order, text, at, run, near, far, right, _context(data, start + length - near, far, length - GRAM, 1))


def _edge(right: np.ndarray, bounds: list[bytes], length: int) -> np.ndarray:
    """Bytes that each right side shares with one of the splitters beside its range, -1 without any.

    Sides on both sides of a shortened splitter differ within its bytes.
    """
    edge = np.full(len(right), -1)
    for bound in bounds:
        splitter = np.frombuffer(bound.ljust(length, b"\0")[:length], np.uint8)
        edge = np.maximum(edge, np.minimum(_shared(right, np.broadcast_to(splitter, right.shape)), len(bound) - 1))
    return edge


def _beside(table: pa.Table, splitters: list[bytes]) -> tuple[int, list[bytes]]:
    bucket = table["_b"][0].as_py()
    return bucket, splitters[max(0, bucket - 1) : bucket + 1] if bucket else splitters[:1]


def settle(s: Suffixes, edge: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, int, np.ndarray]]]:
    """Windows of one range: what is settled inside, and what may go on in another range.

    Right and left sides are sorted. In the sorted right sides, suffixes that share
    ``length - r`` bytes are a run between drops of the common prefix, and so are those that
    share ``r`` bytes in the sorted left sides. Two windows that begin r bytes before their
    anchors are equal when both runs are. A run that reaches a splitter (``edge``) may go on
    behind it, so its windows stay open. Returns the least and greatest removed r of each
    suffix (-1 as the greatest: none) and the open ones: suffixes, r, least order.
    """
    n, reach = len(s.order), length - GRAM
    by_right, by_left = multikey_order(np.hstack([s.right, s.left])), multikey_order(s.left)
    right_lcp, left_lcp = _neighbours(s.right, by_right), _neighbours(s.left, by_left)
    run_right, run_left = np.empty(n, np.int64), np.empty(n, np.int64)
    least_r, most_r = np.full(n, reach + 1), np.full(n, -1)
    opened: list[tuple[np.ndarray, int, np.ndarray]] = []
    for r in range(reach + 1):
        has = np.flatnonzero((s.near <= r) & (r <= s.far))
        if not len(has):
            continue
        run_right[by_right] = np.cumsum(right_lcp < length - r)
        run_left[by_left] = np.cumsum(left_lcp < r)
        group = run_right[has] * (n + 1) + run_left[has]
        sort = np.argsort(group, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], group[sort][1:] != group[sort][:-1]]))
        least = np.empty(len(has), np.int64)
        least[sort] = np.repeat(np.minimum.reduceat(s.order[has][sort], start), np.diff(np.concatenate([start, [len(has)]])))
        open_ = edge[has] >= length - r
        gone = has[(least < s.order[has]) & ~open_]
        least_r[gone] = np.minimum(least_r[gone], r)
        most_r[gone] = r
        if open_.any():
            opened.append((has[open_], r, least[open_]))
    return least_r, most_r, opened


SPAN = "_o long, _h int, _at long, _len long"


def _settled_spans(table: pa.Table, splitters: list[bytes], length: int) -> pa.Table:
    s = _read(table, length)
    _, beside = _beside(table, splitters)
    least_r, most_r, _ = settle(s, _edge(s.right, beside, length), length)
    gone = np.flatnonzero(most_r >= 0)
    # Removed windows of a suffix overlap, so they are one span.
    return pa.table({"_o": s.order[gone], "_h": s.text[gone], "_at": s.at[gone] - most_r[gone], "_len": s.run[gone] + length + most_r[gone] - least_r[gone]})


OPEN = "_suffix boolean, _b int, _q int, _o long, _h int, _at long, _len long, _r int, _w binary, _m long"


def _open_rows(table: pa.Table, splitters: list[bytes], length: int) -> pa.Table:
    """Suffixes with open windows, and for each different one its windows.

    ``_q`` numbers the different suffixes of the range by content. Equal ones, however many,
    send their windows once, with the least order among them.
    """
    s = _read(table, length)
    bucket, beside = _beside(table, splitters)
    edge = _edge(s.right, beside, length)
    rows = np.flatnonzero(edge >= length - s.far)
    s, edge = Suffixes(*[c[rows] for c in s]), edge[rows]
    opened = settle(s, edge, length)[2] if len(rows) else []
    n = len(s.order)
    key = np.ascontiguousarray(np.hstack([s.right, s.left, s.near[:, None].astype(np.uint8), s.far[:, None].astype(np.uint8)]))
    _, first, kind = np.unique(key.view(f"V{key.shape[1]}").ravel(), return_index=True, return_inverse=True) if n else (None, np.zeros(0, int), np.zeros(0, int))
    shown = np.zeros(n, bool)
    shown[first] = True
    who, dist, least = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for suffix, r, m in opened:
        pick = shown[suffix]
        who, dist, least = [*who, suffix[pick]], [*dist, np.full(int(pick.sum()), r)], [*least, m[pick]]
    who, dist, least = np.concatenate(who), np.concatenate(dist), np.concatenate(least)
    windows = [s.left[i, :r][::-1].tobytes() + s.right[i, : length - r].tobytes() for i, r in zip(who.tolist(), dist.tolist())]
    kind, w = kind.ravel().astype(np.int32), len(who)
    none = lambda m, t: pa.nulls(m, t)
    columns = {
        "_suffix": pa.array([True] * n + [False] * w, pa.bool_()), "_b": pa.array(np.full(n + w, bucket, np.int32)), "_q": pa.array(np.concatenate([kind, kind[who]])),
        **{c: pa.concat_arrays([pa.array(v), none(w, pa.array(v).type)]) for c, v in (("_o", s.order), ("_h", s.text), ("_at", s.at), ("_len", s.run))},
        "_r": pa.concat_arrays([none(n, pa.int32()), pa.array(dist.astype(np.int32))]), "_w": pa.concat_arrays([none(n, pa.binary()), pa.array(windows, pa.binary())]),
        "_m": pa.concat_arrays([none(n, pa.int64()), pa.array(least)]),
    }
    return pa.table(columns)


def repeated_spans(
    rows: DataFrame, dealt: DataFrame, copies: DataFrame, length: int = 50, bucket_bytes: int = 8 << 20, sample_docs: int = 4096, sample_keys: int = 16_384
) -> DataFrame:
    """Per order ``_o``: ``_spans``, an array of (_h, _at, _len) of repeated strings.

    See :func:`without_repeats`. ``dealt`` are ``rows`` dealt by ``_o``; its readers here and at
    the caller take all columns, so that they share one exchange. Copies are left out.
    """
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("_text").cast("bigint")), F.lit(0)).alias("b")).first()
    sample = stored(_sampled(rows, length, sample_docs, told["n"]), "suffix-sample")
    hot = _hot(sample, min(sample_docs, told["n"]))
    buckets = max(1, told["b"] // bucket_bytes)
    splitters = _splitters(sample, buckets, sample_keys)
    first = ~F.coalesce(F.array_contains("_hs", F.col("_h")), F.lit(False))
    searched = dealt.join(copies, "_o", "left").where(first).select("_id", "_o", "_text", "_h")
    marks = _shared_marks(searched, length, hot, partitions)
    suffixes = _suffixes(searched.join(marks, "_o", "left").select("_id", "_o", "_text", "_h", "_gs"), length, hot, splitters)
    # Three readings of one exchange. The two of the open windows look at few suffixes: those
    # whose leading bytes are a splitter's, and at a hot one's place all of its copies.
    ranges = suffixes.groupBy("_b")
    settled = ranges.applyInArrow(lambda t: _settled_spans(t, splitters, length), SPAN)
    windows = ranges.applyInArrow(lambda t: _open_rows(t, splitters, length), OPEN).where(~F.col("_suffix")).select("_b", "_q", "_r", "_w", "_m")
    least = windows.groupBy("_w").agg(F.min("_m").alias("_m"))
    known = windows.drop("_m").join(least, "_w").groupBy("_b", "_q").agg(F.collect_list(F.struct("_r", "_m")).alias("_ws"))
    waiting = ranges.applyInArrow(lambda t: _open_rows(t, splitters, length), OPEN).where("_suffix").select("_b", "_q", "_o", "_h", "_at", "_len")
    gone = F.transform(F.filter("_ws", lambda w: w["_m"] < F.col("_o")), lambda w: w["_r"])
    late = waiting.join(known, ["_b", "_q"]).withColumn("_gone", gone).where(F.size("_gone") > 0)
    late = late.select("_o", "_h", (F.col("_at") - F.array_max("_gone")).alias("_at"), (F.col("_len") + length + F.array_max("_gone") - F.array_min("_gone")).alias("_len"))
    spans = settled.unionByName(late)
    return spans.groupBy("_o").agg(F.collect_list(F.struct("_h", "_at", "_len")).alias("_spans"))


def _merged(at: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Spans as disjoint (start, end) in order; those that touch are one."""
    out: list[tuple[int, int]] = []
    for a, n in sorted(zip(at.tolist(), size.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], a + n))
        else:
            out.append((a, a + n))
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, **limits: int) -> DataFrame:
    """Texts less every byte of a ``length``-byte string that also starts in a text of smaller id.

    Returns ``_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` (start, end in UTF-8
    bytes, disjoint, in order) and ``kept`` (binary: a cut may fall inside a character), one
    row per given row. Matches never cross texts; strings are judged on the given texts.

    Suffixes are taken at anchors only (see :func:`anchors`), and only where a text of another
    id has one of the same marks; of equal texts only the first is searched. Splitters sampled from a bounded number of texts cut them into
    ranges of their leading bytes; each range is sorted by multikey quicksort, neighbours
    are compared, and windows whose run reaches a splitter are compared across ranges by
    one more exchange. The number of ranges follows the bytes of the table. A hot passage
    only makes its windows open: they meet by content, already reduced to one row per
    range. A null text is empty, a null id counts as the smallest long, rows of equal id
    never remove from each other, equal rows get equal results, an empty table gives none.
    """
    if not GRAM < length < 256:
        raise ValueError(f"length must lie between {GRAM + 1} and 255")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _documents(docs, id_col, text_col)
    dealt, copies = rows.repartition(partitions, "_o"), _copies(rows)
    spans = repeated_spans(rows, dealt, copies, length, **limits)
    copy = F.coalesce(F.array_contains("_hs", F.col("_h")), F.lit(False))
    held = dealt.join(copies, "_o", "left").select("_id", "_o", "_text", "_h", copy.alias("_copy")).join(spans, "_o", "left")
    id_type = held.schema["_id"].dataType.simpleString()
    schema = f"_id {id_type}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch["_text"])
            lists, hashes = batch["_spans"], batch["_h"].to_numpy()
            flat = lists.flatten()
            own, at, size = (flat.field(i).to_numpy() for i in range(3)) if len(flat) else (np.zeros(0, np.int64),) * 3
            copies = batch["_copy"].to_numpy(zero_copy_only=False)
            edges, valid = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
            edges = edges - edges[0] if len(edges) else edges
            removed, counts, where, kept = [], [], [], []
            for i in range(len(batch)):
                text = data[bounds[i] : bounds[i + 1]]
                merged: list[tuple[int, int]] = []
                if copies[i] and len(text) >= length:
                    merged = [(0, len(text))]
                elif valid[i]:
                    mine = slice(edges[i], edges[i + 1])
                    pick = own[mine] == hashes[i]
                    merged = _merged(at[mine][pick], size[mine][pick])
                stops = [0, *[x for span in merged for x in span], len(text)]
                kept.append(b"".join(text[a:b].tobytes() for a, b in zip(stops[::2], stops[1::2])))
                removed.append(len(text) - len(kept[-1]))
                counts.append(len(merged))
                where.append([{"start": a, "end": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays(
                [batch["_id"], pa.array(np.diff(bounds)), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
            )

    return held.select("_id", "_o", "_text", "_h", "_copy", "_spans").mapInArrow(cut, schema)
