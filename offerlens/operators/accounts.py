"""Account and subscriber reports and the consent ledger."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.text import defuse_formula
from offerlens.operators.sequences import LEVELS, first_at_or_after, micros, next_of, reached
from offerlens.plans.store import stored

RESEND_SECONDS, MAX_UNANSWERED = 15 * 60, 3

LEDGER_SCHEMA = "email string, source string, confirmed_at timestamp, unsubscribed_at timestamp, last_sent_at timestamp, sends int"


def mailable() -> Column:
    """The list that may be mailed, written once for the export and the count."""
    return F.col("confirmed_at").isNotNull() & F.col("unsubscribed_at").isNull()


def mailable_export(subscribers: DataFrame) -> DataFrame:
    """CSV-ready rows with formula cells defused."""
    confirmed = F.date_format(F.col("confirmed_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return subscribers.where(mailable()).select(
        defuse_formula(F.col("email")).alias("email"), defuse_formula(F.col("source")).alias("source"), confirmed.alias("confirmed_at")
    )


def dashboard(users: DataFrame, saved: DataFrame, sessions: DataFrame, messages: DataFrame, subscribers: DataFrame, now: Column) -> DataFrame:
    """Eight counters in one row; one pass over each table."""
    count = F.count(F.lit(1))
    u = users.agg(F.struct(count.alias("users"), F.count("verified_at").alias("verified"), F.count_if("marketing_consent").alias("marketing_optin")).alias("c")).scalar()
    active = F.col("revoked_at").isNull() & (F.col("expires_at") > now)
    s = sessions.agg(F.count_if(active)).scalar()
    m = messages.agg(F.count_if(F.col("handled_at").isNull())).scalar()
    sub = subscribers.agg(F.struct(count.alias("subscribers"), F.count_if(mailable()).alias("confirmed")).alias("c")).scalar()
    row = saved.agg(count.alias("saved_searches")).withColumns({"_u": u, "_b": sub})
    return row.select(
        F.col("_u.users").alias("users"), F.col("_u.verified").alias("verified"), "saved_searches", s.alias("active_sessions"),
        m.alias("unread_contact"), F.col("_b.subscribers").alias("subscribers"), F.col("_b.confirmed").alias("subscribers_confirmed"),
        F.col("_u.marketing_optin").alias("marketing_optin"),
    )


def page_of(rows: DataFrame, at: str, id_: str, limit: int, offset: int = 0) -> DataFrame:
    """One page, newest first with the id as tiebreak, and the total."""
    total = rows.agg(F.count(F.lit(1))).scalar()
    return rows.orderBy(F.desc(at), F.desc(id_)).offset(offset).limit(limit).withColumn("total", total)


def backfill_subscribers(users: DataFrame, subscribers: DataFrame, label: str = "register") -> DataFrame:
    """Consenting users missing from the list, as confirmed rows; nothing is overwritten."""
    missing = users.where("marketing_consent").join(subscribers.select("email").distinct(), "email", "left_anti")
    rows = missing.select("email", F.lit(label).alias("source"), F.col("created_at").alias("confirmed_at"))
    return subscribers.unionByName(rows, allowMissingColumns=True)


def step(state: dict | None, action: str, at: pd.Timestamp, source: str | None) -> dict | None:
    """One consent event applied to an address; the rules of the list live here."""
    if action == "subscribe":
        if state is None:
            return {"source": source, "confirmed_at": None, "unsubscribed_at": None, "last_sent_at": at, "sends": 1}
        returned = state["confirmed_at"] is not None and state["unsubscribed_at"] is not None
        pending = state["confirmed_at"] is None and state["unsubscribed_at"] is None
        rested = state["last_sent_at"] is None or (at - state["last_sent_at"]).total_seconds() > RESEND_SECONDS
        if state["sends"] < MAX_UNANSWERED and (returned or (pending and rested)):
            return {"source": source, "confirmed_at": None, "unsubscribed_at": None, "last_sent_at": at, "sends": state["sends"] + 1}
    elif action == "add_confirmed":
        if state is None:
            return {"source": source, "confirmed_at": at, "unsubscribed_at": None, "last_sent_at": None, "sends": 0}
        if state["confirmed_at"] is None and state["unsubscribed_at"] is None:
            return {**state, "confirmed_at": at, "sends": 0}
    elif state is not None and action == "confirm":
        if state["unsubscribed_at"] is None and state["confirmed_at"] is None:
            return {**state, "confirmed_at": at}
    elif state is not None and action == "unsubscribe" and state["unsubscribed_at"] is None:
        return {**state, "unsubscribed_at": at}
    return state


#: Actions in the order in which they count within one moment.
ACTIONS = ("add_confirmed", "confirm", "subscribe", "unsubscribe")


def consent_ledger(events: DataFrame) -> DataFrame:
    """Current state per address from its consent events (``email, at, action, source``).

    What an accepted subscription leads to depends on itself alone: on its time, on how many
    have gone unanswered with it (one to three), and on the next events of each kind. So
    each subscription, at each count, has one link to the next one that is accepted, or
    none; the state after the last link is the address's. All links are found at once by
    looking ahead on the tree of time cells and followed by doubling, so an address with
    most of the events is no more in one task than any other. Events without an address or
    a time, and other actions, say nothing; equal ones count once.
    """
    kind = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action")).cast("bigint") - 1
    slots = len(ACTIONS)
    place = micros("at") * slots + kind
    told = events.where(F.col("email").isNotNull() & F.col("at").isNotNull() & F.col("action").isin(*ACTIONS))
    told = told.select("email", place.alias("p"), kind.alias("kind"), "source").groupBy("email", "p", "kind").agg(F.min("source").alias("source"))
    sub, add, leave = (F.col("kind") == ACTIONS.index(a) for a in ("subscribe", "add_confirmed", "unsubscribe"))
    levels = tuple(size * slots for size in LEVELS)
    told = stored(next_of(told, ["email"], "p", {"x": ~sub, "u": leave, "n": sub}, levels), "consent-events")
    kind_of = lambda c: F.pmod(F.col(c), F.lit(slots))

    # The first subscription more than the resend time after each one.
    subs = told.where(sub)
    asked = subs.select("email", ((F.floor(F.col("p") / slots) + RESEND_SECONDS * 1_000_000 + 1) * slots).alias("p"), F.col("p").alias("of"))
    again = first_at_or_after(subs, asked, ["email"], "p", "again", levels).select("email", F.col("of").alias("p"), "again")
    # What follows a confirmation: the next goodbye, and the next subscription after that.
    leaving = told.select("email", F.col("p").alias("x"), F.col("u").alias("left"))
    returning = told.where(leave).select("email", F.col("p").alias("left"), F.col("n").alias("back"))
    confirmed = lambda rows: rows.join(leaving, ["email", "x"], "left").join(returning, ["email", "left"], "left")
    ahead = confirmed(subs.join(again, ["email", "p"]).select("email", "p", "source", "x", "again"))

    # A place is an accepted subscription with the number of unanswered ones.
    places = ahead.withColumn("s", F.explode(F.array(*[F.lit(i) for i in range(1, MAX_UNANSWERED + 1)])))
    resent = (F.col("s") < MAX_UNANSWERED) & F.col("again").isNotNull() & (F.col("x").isNull() | (F.col("again") < F.col("x")))
    answered = F.col("x").isNotNull() & (kind_of("x") != ACTIONS.index("unsubscribe"))
    sends = F.when(answered & (kind_of("x") == ACTIONS.index("add_confirmed")), 0).otherwise(F.col("s"))
    node = lambda p, s: p * (MAX_UNANSWERED + 1) + s
    onward = F.when(resent, node(F.col("again"), F.col("s") + 1)).when(
        answered & F.col("back").isNotNull() & (sends < MAX_UNANSWERED), node(F.col("back"), sends + 1)
    )
    places = stored(places.select("email", node(F.col("p"), F.col("s")).alias("at"), onward.alias("to"), "p", "source", "x", "left", answered.alias("answered"), sends.alias("sends")), "consent-places")

    # The first event that puts an address on the list.
    first = told.where(sub | add).groupBy("email").agg(F.min(F.struct("p", "kind", "source", "u")).alias("f")).select("email", "f.*")
    invited = first.where(sub).select("email", node(F.col("p"), F.lit(1)).alias("at"))
    added = first.where(add).select("email", "source", F.col("p").alias("x"), F.col("u").alias("left")).join(returning, ["email", "left"], "left")
    starts = invited.unionByName(added.where("back is not null").select("email", node(F.col("back"), F.lit(1)).alias("at")))
    last = reached(starts, places.select("email", "at", "to"), ["email"], "at", "to").groupBy("email").agg(F.max("at").alias("at"))

    moment = lambda c: F.timestamp_micros(F.floor(F.col(c) / slots).cast("bigint"))
    never = F.lit(None).cast("timestamp")
    ended = last.join(places, ["email", "at"]).select(
        "email", "source", F.when(F.col("answered"), moment("x")).alias("confirmed_at"),
        F.when(F.col("answered"), moment("left")).otherwise(moment("x")).alias("unsubscribed_at"), moment("p").alias("last_sent_at"), F.col("sends").cast("int").alias("sends"),
    )
    quiet = added.where("back is null").select("email", "source", moment("x").alias("confirmed_at"), moment("left").alias("unsubscribed_at"), never.alias("last_sent_at"), F.lit(0).alias("sends"))
    return ended.unionByName(quiet)
