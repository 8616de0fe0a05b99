"""SES-1 as a live stream: the inactivity warning and the logout, each when its time has come.

A user's timers run from the last activity: after 23 h 50 min without any comes a warning, after
24 h the logout. Activity in between starts both again. The state of a user is the list of *stretches*
of activity without a gap that long, each with its first and last event and its number of events.
An event-time timer is set at the next thing due; it fires when the watermark has passed
it, that is, when no activity before it can still come. So nothing is announced too early and
nothing is taken back, whatever the order of events within ``delay``.

* State: stretches lie 23 h 50 min apart, and those behind the watermark are gone once their fate is known; a user
  has one for each day of ``delay`` at most, not one per event.
* Users come in groups by hash, with one call and one state row a group; its timer is that of the user due first.
* Hot users: before the shuffle, each task joins its events of a user to stretches, batch by batch; the user's
  group sees those.
* Time passes with any row, also one without a user (a heartbeat). Rows without a time are left out.
* A stretch that ends behind the watermark is late by more than ``delay`` and is not taken, as its alerts are out;
  a feed in no order at all is for `session_partials` and `merge_sessions`.
* Repeated rows count as events of their own; an empty feed gives no alerts; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfspark.operators.sessions import GAP_SECONDS, WARN_SECONDS

NOBODY = -(1 << 62)  # the user of a row that has none
STRETCH = "user_id long, first long, last long, events long"
# Of each user of a group: what has come due, and how many stretches of the three long lists are the user's.
STATE = ("user array<long>, warned array<boolean>, start array<long>, before array<long>, size array<long>, "
         "first array<long>, last array<long>, events array<long>")
GROUPS = 1024  # groups of users that share a call, a state row and a timer; part of a checkpoint
NO_GROUP = -1  # of rows without a user
ALERT = "user_id long, kind string, at long, start long, last long, events long"

Stretch = tuple[int, int, int]  # first and last activity in microseconds, number of events


def join_stretches(stretches: list[Stretch], quiet_us: int) -> list[Stretch]:
    """Stretches in order, those less than ``quiet_us`` apart joined."""
    out: list[Stretch] = []
    for first, last, n in sorted(stretches):
        if out and first - out[-1][1] < quiet_us:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


def due(stretches: list[Stretch], warned: bool, start: int | None, before: int, now: int, quiet_us: int,
        gap_us: int) -> tuple[list[tuple], list[Stretch], bool, int | None, int]:
    """What has come due by ``now``: (alerts, stretches left, whether the first of them was warned of, and its
    session's start and number of earlier events)."""
    alerts, k = [], 0
    for k, (first, last, n) in enumerate(stretches):
        begun = first if start is None else start
        if not warned:
            if last + quiet_us > now:
                return alerts, stretches[k:], False, start, before
            alerts.append(("warning", last + quiet_us, begun, last, before + n))
        again = k + 1 < len(stretches) and stretches[k + 1][0] - last < gap_us
        if again:
            start, before = begun, before + n  # the session goes on in the next stretch
        elif last + gap_us <= now:
            alerts.append(("logout", last + gap_us, begun, last, before + n))
            start, before = None, 0
        else:
            return alerts, stretches[k:], True, start, before
        warned = False
    return alerts, [], False, None, 0


def _stretches(quiet_us: int) -> Callable:
    """Events of a task's batches as stretches, to shuffle few rows of a hot user."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            user, us = pdf["user_id"].to_numpy("int64"), pdf["us"].to_numpy("int64")
            order = np.lexsort((us, user))
            user, us = user[order], us[order]
            at = np.flatnonzero(np.r_[True, (user[1:] != user[:-1]) | (us[1:] - us[:-1] >= quiet_us)])
            ends = np.r_[at[1:], len(us)]
            yield pd.DataFrame({"user_id": user[at], "first": us[at], "last": us[ends - 1], "events": ends - at})

    return of


User = tuple[list[Stretch], bool, int | None, int]  # stretches, warned of the first, its session's start and earlier events


def unpack(state: tuple) -> dict[int, User]:
    """The users of a group's state row."""
    user, warned, start, before, size, first, last, events = [list(c) for c in state]
    stretches, held, at = list(zip(map(int, first), map(int, last), map(int, events))), {}, 0
    for u, w, s, b, n in zip(user, warned, start, before, size):
        held[int(u)] = stretches[at:at + int(n)], bool(w), None if s == NOBODY else int(s), int(b)
        at += int(n)
    return held


def pack(held: dict[int, User]) -> tuple:
    """The state row of a group's users."""
    flat = [stretch for stretches, _, _, _ in held.values() for stretch in stretches]
    return (list(held), [w for _, w, _, _ in held.values()], [NOBODY if s is None else s for _, _, s, _ in held.values()],
            [b for _, _, _, b in held.values()], [len(x) for x, _, _, _ in held.values()],
            *[[stretch[k] for stretch in flat] for k in range(3)])


def _step(quiet_us: int, gap_us: int) -> Callable:
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fresh: dict[int, list[Stretch]] = {}
        for pdf in batches:
            if key[0] == NO_GROUP:
                continue
            new: dict[int, list[Stretch]] = {}
            for u, *stretch in zip(*[pdf[c].tolist() for c in ("user_id", "first", "last", "events")]):
                new.setdefault(u, []).append(tuple(stretch))
            for u, stretches in new.items():
                fresh[u] = join_stretches(fresh.get(u, []) + stretches, quiet_us)
        if key[0] == NO_GROUP:
            return
        held = unpack(state.get) if state.exists else {}
        now = state.getCurrentWatermarkMs() * 1000
        rows, left, soonest = [], {}, None
        for u in held.keys() | fresh.keys():
            old, warned, start, before = held.get(u, ([], False, None, 0))
            known = join_stretches(old + fresh[u], quiet_us) if u in fresh else old
            alerts, ahead, warned, start, before = due(known, warned, start, before, now, quiet_us, gap_us)
            rows += [(u, *alert) for alert in alerts]
            if ahead:
                left[u] = ahead, warned, start, before
                at = ahead[0][1] + (gap_us if warned else quiet_us)
                soonest = at if soonest is None else min(soonest, at)
        if left:
            state.update(pack(left))
            state.setTimeoutTimestamp(-(-soonest // 1000))
        elif state.exists:
            state.remove()
        users, kind, at, begun, last, n = [list(c) for c in zip(*rows)] or [[]] * 6
        yield pd.DataFrame({"user_id": np.asarray(users, "int64"), "kind": pd.Series(kind, dtype=object),
                            **{c: np.asarray(v, "int64") for c, v in (("at", at), ("start", begun), ("last", last), ("events", n))}})

    return step


def stream_session_alerts(activity: DataFrame, delay: str = "1 day", user: str = "user_id", ts: str = "created_at",
                          gap_s: int = GAP_SECONDS, warn_s: int = WARN_SECONDS) -> DataFrame:
    """One row per warning and logout of a stream of activity: user_id, kind ('warning' or 'logout'), fires_at,
    session_start, last_activity and the session's events so far. A warning without its logout was
    followed by activity in time."""
    quiet_us, gap_us = (gap_s - warn_s) * 1_000_000, gap_s * 1_000_000
    events = activity.where(F.col(ts).isNotNull()).select(
        F.coalesce(F.col(user).cast("long"), F.lit(NOBODY)).alias("user_id"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    seen = events.mapInPandas(_stretches(quiet_us), STRETCH)
    timed = seen.withColumn("until", F.timestamp_micros("last")).withWatermark("until", delay)
    group = F.when(F.col("user_id") == NOBODY, F.lit(NO_GROUP)).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(GROUPS))).cast("int")
    alerts = timed.withColumn("_group", group).groupBy("_group").applyInPandasWithState(
        _step(quiet_us, gap_us), ALERT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return alerts.select("user_id", "kind", F.timestamp_micros("at").alias("fires_at"),
                         F.timestamp_micros("start").alias("session_start"), F.timestamp_micros("last").alias("last_activity"), "events")
