"""Best cards of very many queries by lists of cards that no other cards push out.

A query's price term depends on the range of its own matches, so its order of two cards is
known only then. But in every such order a card stands behind one that is not dearer and
scores no worse in the other factors. A card behind ``k`` such cards is in nobody's top
``k``; what is left of any set is its dominance list, which stays short, and the list of a
union follows from the lists of its parts.

Queries that differ only in their price limits share one sweep over the matching cards in
order of price, cut into chunks: each chunk has a list, the lists of earlier chunks are
merged and handed on, and a query reads the list at its own ceiling.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.plans.store import stored

#: Scores are compared after rounding to six digits: less than this apart they may be equal.
MARGIN = 3e-6
CHUNK = 1 << 14
PENDING = 256

#: Order of events at one price: a floor asks before ranges end there, cards come before ceilings.
ASK, CARD, QUERY, CLOSE = 0, 1, 2, 3


class Front:
    """The dominance list of the cards seen so far, with their price range and number."""

    def __init__(self, k: int, weight: float, span: int, floors: bool) -> None:
        # No query's price range is wider than the profile's, so no slope is flatter than this.
        self.k, self.weight, self.floors, self.slope = k, weight, floors, weight / max(span, 1)
        self.median, self.rest, self.top = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.key = np.zeros(0, object)
        self.stairs = np.zeros((2, 0), np.int64)  # (median, top): dearest cards for every floor
        self.lo, self.hi, self.n, self.closed = None, None, 0, 0
        self._late: list[tuple[np.ndarray, ...]] = []
        self._waiting = 0

    def add(self, median: np.ndarray, rest: np.ndarray, top: np.ndarray, key: np.ndarray, counted: bool = True) -> None:
        if not len(median):
            return
        if counted:
            self.n += len(median)
            self.lo = int(median.min()) if self.lo is None else min(self.lo, int(median.min()))
            self.hi = int(median.max()) if self.hi is None else max(self.hi, int(median.max()))
        if self.floors:
            self.stairs = _stairs(np.hstack([self.stairs, np.stack([median, top])]))
        elif len(self.median) >= self.k:
            # Already pushed out by the list as it stands.
            at = np.searchsorted(self.median, median, "right") - 1
            keep = (at < 0) | (self._kth[at] < rest - self.slope * median + MARGIN)
            median, rest, top, key = median[keep], rest[keep], top[keep], key[keep]
        for lo in range(0, len(median), PENDING):
            part = slice(lo, lo + PENDING)
            self._late.append((median[part], rest[part], top[part], key[part]))
            self._waiting += len(median[part])
            if self._waiting >= PENDING:
                self.settle()

    def settle(self) -> None:
        """Merge what waits into the list."""
        if not self._late:
            return
        median, rest, top, key = (np.concatenate(c) for c in zip((self.median, self.rest, self.top, self.key), *self._late))
        self._late, self._waiting = [], 0
        order = sorted(range(len(median)), key=lambda i: (median[i], -rest[i], -top[i], key[i]))
        median, rest, top, key = median[order], rest[order], top[order], key[order]
        height = rest - self.slope * median
        keep = np.ones(len(median), bool)
        # Of cards equal in all three the first k by key stand before the others.
        same = np.concatenate([[False], (median[1:] == median[:-1]) & (rest[1:] == rest[:-1]) & (top[1:] == top[:-1])])
        run = 0
        for i, equal in enumerate(same.tolist()):
            run = run + 1 if equal else 1
            keep[i] = run <= self.k
        if self.floors:
            for lo in range(0, len(median), 512):
                part = slice(lo, lo + 512)
                ahead = (median[None, :] <= median[part, None]) & (height[None, :] >= height[part, None] + MARGIN) & (top[None, :] >= top[part, None])
                keep[part] &= ahead.sum(1) < self.k
        else:
            best: list[float] = []
            for i, h in enumerate(height.tolist()):
                if len(best) == self.k:
                    keep[i] &= best[0] < h + MARGIN
                    heapq.heappushpop(best, h)
                else:
                    heapq.heappush(best, h)
        self.median, self.rest, self.top, self.key = median[keep], rest[keep], top[keep], key[keep]
        if not self.floors:
            best, kth = [], []
            for h in (self.rest - self.slope * self.median).tolist():
                heapq.heappushpop(best, h) if len(best) == self.k else heapq.heappush(best, h)
                kth.append(best[0] if len(best) == self.k else -np.inf)
            self._kth = np.array(kth)

    def ask(self, floor: int | None) -> tuple[int, int, np.ndarray] | None:
        """Price range of the matches, and the keys among which the best ``k`` are."""
        median, rest, top, key = (np.concatenate(c) for c in zip((self.median, self.rest, self.top, self.key), *self._late))
        lo, hi = self.lo, self.hi
        if floor is not None:
            fits = top >= floor
            if not fits.any():
                return None
            median, rest, key = median[fits], rest[fits], key[fits]
            lo, hi = int(median.min()), int(self.stairs[0][self.stairs[1] >= floor].max())
        if not len(median):
            return None
        price = (median - lo) / (hi - lo) if hi > lo else np.full(len(median), 0.5)
        score = self.weight * (1 - price) + rest
        if len(score) > self.k:
            keep = score >= np.partition(score, len(score) - self.k)[len(score) - self.k] - MARGIN
            key = key[keep]
        return lo, hi, key


def _stairs(steps: np.ndarray) -> np.ndarray:
    """Cards (median, top) without another of at least both."""
    order = np.lexsort((-steps[1], -steps[0]))
    steps = steps[:, order]
    before = np.concatenate([[np.iinfo(np.int64).min], np.maximum.accumulate(steps[1])[:-1]]) if steps.shape[1] else np.zeros(0)
    return steps[:, steps[1] > before]


EVENT = "_set string, _at long, _kind int, _id string, _median long, _rest double, _top long, _floor long, _weight double, _span long, _floors boolean"
SUMMARY = "_set string, _chunk long, _what string, _median long, _rest double, _top long, _key string, _n long, _closed long, _lo long, _hi long, _weight double, _span long, _floors boolean"
ANSWER = "_profile string, _part string, _key string, _lo long, _hi long, _n long"


def _front(row, k: int) -> Front:
    return Front(k, float(row["_weight"]), int(row["_span"]), bool(row["_floors"]))


def _cards_of(part: pd.DataFrame) -> tuple[np.ndarray, ...]:
    return part["_median"].to_numpy(np.int64), part["_rest"].to_numpy(float), part["_top"].to_numpy(np.int64), part["_id"].to_numpy(object)


def _summary_rows(front: Front, of: str, chunk: int, what: str, head) -> pd.DataFrame:
    front.settle()
    common = {"_set": of, "_chunk": chunk, "_weight": head["_weight"], "_span": head["_span"], "_floors": head["_floors"]}
    blocks = [
        pd.DataFrame({"_what": what, "_median": front.median, "_rest": front.rest, "_top": front.top, "_key": front.key}),
        pd.DataFrame({"_what": f"{what} stair", "_median": front.stairs[0], "_top": front.stairs[1]}),
        pd.DataFrame({"_what": [f"{what} count"], "_n": [front.n], "_closed": [front.closed], "_lo": [front.lo], "_hi": [front.hi]}),
    ]
    return _whole(pd.concat([b.assign(**common) for b in blocks if len(b)], ignore_index=True), SUMMARY)


def _whole(frame: pd.DataFrame, schema: str) -> pd.DataFrame:
    """The columns of a schema; absent whole numbers, texts and truth values as None."""
    out = {}
    for column in schema.split(", "):
        name, kind = column.split()
        values = frame[name] if name in frame else pd.Series([None] * len(frame), dtype=object)
        if kind == "double":
            out[name] = pd.to_numeric(values).to_numpy(float)
        else:
            real = {"long": int, "boolean": bool, "string": str}[kind]
            out[name] = pd.Series([None if pd.isna(v) else real(v) for v in values.tolist()], dtype=object)
    return pd.DataFrame(out)


def _take(front: Front, rows: pd.DataFrame, what: str) -> None:
    """Fold a summary into a front."""
    entry = rows[rows["_what"] == what]
    front.add(entry["_median"].to_numpy(np.int64), entry["_rest"].to_numpy(float), entry["_top"].to_numpy(np.int64), entry["_key"].to_numpy(object), counted=False)
    stair = rows[rows["_what"] == f"{what} stair"]
    if len(stair):
        front.stairs = _stairs(np.hstack([front.stairs, np.stack([stair["_median"].to_numpy(np.int64), stair["_top"].to_numpy(np.int64)])]))
    for r in rows[rows["_what"] == f"{what} count"].to_dict("records"):
        front.n += int(r["_n"])
        front.closed += int(r["_closed"])
        if not pd.isna(r["_lo"]):
            front.lo = int(r["_lo"]) if front.lo is None else min(front.lo, int(r["_lo"]))
            front.hi = int(r["_hi"]) if front.hi is None else max(front.hi, int(r["_hi"]))


def best_by_sweep(events: DataFrame, k: int) -> DataFrame:
    """Answers of all queries: ``_part`` is ``top`` (``_key``, the best ``k`` among them),
    ``range`` (``_lo``, ``_hi``, ``_n`` cards at or under the ceiling) or ``under`` (``_n``
    cards that end under the floor).

    ``events`` has the columns of ``EVENT``: for each set of queries the cards it allows
    (at their cheapest price), the queries (at their ceiling) and, where a set has floors,
    the ends of the cards' ranges and the floors. They are range-sorted once, so a large
    set is spread over many tasks, and cut into chunks of at most ``CHUNK`` rows. Only the
    last set of a chunk can go on in the next one, so a chunk sends one summary.
    """
    ordered = events.orderBy("_set", "_at", "_kind", "_id").withColumn("_mid", F.monotonically_increasing_id())
    rows = stored(ordered.withColumn("_chunk", F.shiftright("_mid", CHUNK.bit_length() - 1)), "sweep")

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_mid")
        chunk, sets = int(pdf["_chunk"].iloc[0]), pdf["_set"].to_numpy()
        tail = pdf[sets == sets[-1]]
        head = tail.iloc[0]
        front = _front(head, k)
        front.add(*_cards_of(tail[tail["_kind"] == CARD]))
        front.closed = int((tail["_kind"] == CLOSE).sum())
        wants = pd.DataFrame({"_set": [sets[0]], "_chunk": [chunk], "_what": ["wants"]})
        return _whole(pd.concat([wants, _summary_rows(front, sets[-1], chunk, "own", head)], ignore_index=True), SUMMARY)

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        out, front, head = [], None, None
        for chunk, part in sorted(pdf.groupby("_chunk"), key=lambda g: g[0]):
            if front is not None and (part["_what"] == "wants").any():
                out.append(_summary_rows(front, part["_set"].iloc[0], int(chunk), "carry", head))
            own = part[part["_what"] != "wants"]
            if len(own):
                head = own.iloc[0]
                front = front or _front(head, k)
                _take(front, own, "own")
        return _whole(pd.concat(out, ignore_index=True) if out else pd.DataFrame(), SUMMARY)

    def answer(pdf: pd.DataFrame, carried: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_mid")
        out: list[tuple] = []
        for of, part in pdf.groupby("_set", sort=False):
            front = _front(part.iloc[0], k)
            mine = carried[carried["_set"] == of]
            if len(mine):
                _take(front, mine, "carry")
            kind, ids, floors = part["_kind"].to_numpy(), part["_id"].to_numpy(object), part["_floor"].to_numpy()
            median, rest, top, key = (c for c in _cards_of(part.assign(_median=part["_median"].fillna(0), _top=part["_top"].fillna(0))))
            at = 0
            for q in np.flatnonzero((kind == QUERY) | (kind == ASK)).tolist():
                cards = at + np.flatnonzero(kind[at:q] == CARD)
                front.add(median[cards], rest[cards], top[cards], key[cards])
                front.closed += int((kind[at:q] == CLOSE).sum())
                at = q
                if kind[q] == ASK:
                    out.append((ids[q], "under", None, None, None, front.closed))
                    continue
                found = front.ask(None if pd.isna(floors[q]) else int(floors[q]))
                if found is not None:
                    out.append((ids[q], "range", None, found[0], found[1], front.n))
                    out.extend((ids[q], "top", c, None, None, None) for c in found[2].tolist())
        return _whole(pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")]), ANSWER)

    summaries = rows.groupBy("_chunk").applyInPandas(summarise, SUMMARY)
    carried = summaries.groupBy("_set").applyInPandas(carry, SUMMARY)
    return rows.groupBy("_chunk").cogroup(carried.groupBy("_chunk")).applyInPandas(answer, ANSWER)
