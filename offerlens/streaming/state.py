"""Keyed state machines: alerts, history, source health, consent.

Each keeps one small state per key. The rows of one key in one micro-batch are
put in time order; the source's trigger bounds how many there can be, so read it
with a limit (``ingest.parquet_stream`` sets one).
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from offerlens.operators.accounts import LEDGER_SCHEMA, step

Step = Callable[[dict[str, Any] | None, Any], tuple[dict[str, Any] | None, dict[str, Any] | None]]

ALERT_SCHEMA = "search_id string, spec_key string, run_at timestamp, old_median bigint, new_median bigint, pct double"
POINT_SCHEMA = "spec_key string, t timestamp, median bigint, n bigint, retired boolean"
OPENING_SCHEMA = "host string, ts timestamp, open_until timestamp"


def keyed_rows(stream: DataFrame, key: str, order: list[str], schema: str, step_row: Step, on_expiry=None, expires_after_ms: int | None = None, times: tuple[str, ...] = ()) -> DataFrame:
    """Run ``step_row(state, row) -> (state, output)`` over each key's rows in order.

    The state is stored as JSON; its ``times`` are timestamps for the steps and whole
    microseconds in the store, turned once a batch and not once a row. With an expiry the
    key's state is closed when the watermark passes its last row by that much, through
    ``on_expiry(key, state)``.
    """
    columns = [part.split()[0] for part in schema.split(", ")]
    names = stream.columns
    row_of = namedtuple("Row", names, rename=True)
    places = [names.index(c) for c in order]
    # Nulls come last.
    in_order = lambda row: [(row[i] is None or row[i] != row[i], row[i]) for i in places]

    def run(keys: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(group.get[0]) if group.exists else None
        if state is not None and times:
            state = {**state, **{t: _at(state[t]) for t in times}}
        out: list[dict[str, Any]] = []
        if group.hasTimedOut:
            out.append(on_expiry(keys[0], state))
            group.remove()
        else:
            # Plain tuples: most keys have few rows, and sorting a frame of them takes far longer.
            rows = [row for batch in batches for row in zip(*[batch[c].tolist() for c in names])]
            for row in sorted(rows, key=in_order):
                state, made = step_row(state, row_of(*row))
                if made is not None:
                    out.append(made)
            if state is not None:
                kept = {**state, **{t: None if state[t] is None else _us(state[t]) for t in times}} if times else state
                group.update((json.dumps(kept),))
                if expires_after_ms is not None and state.get("us") is not None:
                    group.setTimeoutTimestamp(max(state["us"] // 1000 + expires_after_ms, group.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame([[made[c] for c in columns] for made in out], columns=columns)

    timeout = GroupStateTimeout.NoTimeout if expires_after_ms is None else GroupStateTimeout.EventTimeTimeout
    return stream.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", timeout)


def _us(at: pd.Timestamp) -> int:
    return int(at.value // 1000)


def _at(us: int | None) -> pd.Timestamp | None:
    return None if us is None else pd.Timestamp(us, unit="us")


def alert_stream(runs: DataFrame, repeat_days: int = 7) -> DataFrame:
    """``search_id, spec_key, run_at, median, reliable, alert_pct`` to alerts.

    The first quoted run sets the baseline and every quoted run moves it; a move of
    the threshold alerts unless the same value was mailed in the last days.
    """
    repeat = repeat_days * 86_400_000_000

    def one(state, row):
        if not row.reliable:
            return state, None
        old, sent = (state or {}).get("last"), dict((state or {}).get("sent", {}))
        now, median = _us(row.run_at), int(row.median)
        sent = {k: at for k, at in sent.items() if now - at < repeat}
        made = None
        if old:
            pct = (median - old) * 100.0 / old
            name = f"{row.spec_key}|{median}"
            if abs(pct) >= float(row.alert_pct) and name not in sent:
                sent[name] = now
                made = {"search_id": row.search_id, "spec_key": row.spec_key, "run_at": row.run_at, "old_median": old, "new_median": median, "pct": pct}
        return {"last": median, "sent": sent}, made

    return keyed_rows(runs, "search_id", ["run_at"], ALERT_SCHEMA, one)


def history_stream(points: DataFrame, gap_seconds: int = 600, retire_days: int = 60, reliable: int = 3) -> DataFrame:
    """``spec_key, t, median, n`` (watermarked on ``t``) to stored points.

    A key seen no more for the given days gives one row marked ``retired``.
    """

    def one(state, row):
        now = _us(row.t)
        kept = (state or {}).get("kept")
        keep = row.n >= reliable and (kept is None or now - kept >= gap_seconds * 1_000_000)
        made = {"spec_key": row.spec_key, "t": row.t, "median": int(row.median), "n": int(row.n), "retired": False} if keep else None
        # A late row must not bring the retirement forward.
        return {"kept": now if keep else kept, "us": max(now, (state or {}).get("us") or now)}, made

    gone = lambda key, state: {"spec_key": key, "t": _at(state["us"]), "median": None, "n": None, "retired": True}
    return keyed_rows(points, "spec_key", ["t"], POINT_SCHEMA, one, gone, retire_days * 86_400_000)


def breaker_stream(log: DataFrame, strikes: int = 3, open_seconds: int = 1800) -> DataFrame:
    """``host, ts, event_id, failed`` to breaker openings."""

    def one(state, row):
        count = (state or {}).get("strikes", 0) + 1 if row.failed else 0
        if count < strikes:
            return {"strikes": count}, None
        return {"strikes": 0}, {"host": row.host, "ts": row.ts, "open_until": row.ts + pd.Timedelta(seconds=open_seconds)}

    return keyed_rows(log, "host", ["ts", "event_id"], OPENING_SCHEMA, one)


def consent_stream(events: DataFrame) -> DataFrame:
    """``email, at, action, source`` to every change of an address's state."""
    times = ("confirmed_at", "unsubscribed_at", "last_sent_at")

    def one(state, row):
        after = step(state, row.action, row.at, row.source)
        if after is state or after is None:
            return state, None
        return after, {"email": row.email, **after, "changed_at": row.at}

    return keyed_rows(events, "email", ["at", "action"], LEDGER_SCHEMA + ", changed_at timestamp", one, times=times)
