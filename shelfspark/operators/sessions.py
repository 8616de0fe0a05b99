"""Login and session behaviour as batch views (SES-1..3, ST-4 batch twin).

SES-1 and SES-2 are ordered per-user computations. Instead of a window
partitioned by user (one task per user, whatever its size), they run on
range-partitioned (user, time) data: the previous event and the running
"last login" cross partition borders through tables of at most one row per
partition, so a user with a third of all events is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.scan import PID, range_sorted, running_total, with_previous

GAP_SECONDS = 24 * 3600
WARN_SECONDS = 10 * 60
TTL_SECONDS = 8 * 3600
LOCK_AFTER = 5
LOCK_SECONDS = 10 * 60


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


# ---------------------------------------------------------------------------
# SES-1 sessions by inactivity
# ---------------------------------------------------------------------------
def sessions(events: DataFrame, user: str = "user_id", ts: str = "created_at", gap_s: int = GAP_SECONDS,
             warn_s: int = WARN_SECONDS, partitions: int | None = None) -> DataFrame:
    """A gap of ``gap_s`` or more without activity ends a session (the
    inactivity timer fires at exactly ``gap_s``). One row per session:
    start, last activity, logout time (last + gap), warning time
    (logout - ``warn_s``) and number of events."""
    ev = events.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(user).alias("_u"), F.col(ts).alias("_ts"), _micros(ts).alias("_us")
    )
    parts = range_sorted(ev, ["_u", "_us"], partitions)
    prev = with_previous(parts, ["_u"], ["_us"], "_us", "_prev")
    flagged = prev.withColumn(
        "_new", F.when(F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") >= gap_s * 1_000_000), 1).otherwise(0)
    )
    numbered = running_total(flagged, ["_u"], ["_us"], "_new", "session_no", presorted=True)
    g = numbered.groupBy("_u", "session_no").agg(
        F.min("_ts").alias("session_start"), F.max("_ts").alias("last_activity"), F.count(F.lit(1)).alias("events")
    )
    logout = F.col("last_activity") + F.expr(f"INTERVAL {gap_s} SECONDS")
    return g.select(
        F.col("_u").alias(user),
        "session_no",
        "session_start",
        "last_activity",
        logout.alias("logout_at"),
        (logout - F.expr(f"INTERVAL {warn_s} SECONDS")).alias("warning_at"),
        "events",
    )


def merge_sessions(partials: DataFrame, gap_s: int = GAP_SECONDS, partitions: int | None = None) -> DataFrame:
    """Sessions from sessions of parts of the events (user_id, session_start,
    last_activity, events), in any order: a partial session that starts
    ``gap_s`` or more after all earlier ones of the user have ended begins a
    new one."""
    order = ["_s", "_e"]
    p = partials.withColumn("_s", _micros("session_start")).withColumn("_e", _micros("last_activity"))
    parts = range_sorted(p, ["user_id", *order], partitions)
    reach = running_total(parts, ["user_id"], order, "_e", "_reach", presorted=True, op="max")
    prev = with_previous(reach, ["user_id"], order, "_reach", "_prev")
    flagged = prev.withColumn(
        "_new", F.when(F.col("_prev").isNull() | (F.col("_s") - F.col("_prev") >= gap_s * 1_000_000), 1).otherwise(0))
    numbered = running_total(flagged, ["user_id"], order, "_new", "session_no", presorted=True)
    g = numbered.groupBy("user_id", "session_no").agg(
        F.min("session_start").alias("session_start"), F.max("last_activity").alias("last_activity"),
        F.sum("events").alias("events"))
    logout = F.col("last_activity") + F.expr(f"INTERVAL {gap_s} SECONDS")
    return g.select("user_id", "session_start", "last_activity", logout.alias("logout_at"), "events")


# ---------------------------------------------------------------------------
# SES-2 activity after the absolute session expiry
# ---------------------------------------------------------------------------
def expired_activity(log: DataFrame, user: str = "user_id", ts: str = "created_at", login_action: str = "LOGIN",
                     ttl_s: int = TTL_SECONDS, partitions: int | None = None) -> DataFrame:
    """Non-login activity with its user's latest login at or before it;
    ``unauthorised`` when there is none or it is more than ``ttl_s`` old
    (the 8-hour token expiry). The latest login is a running max over
    (user, time) order; logins sort before other actions at the same time."""
    ev = log.where(F.col(user).isNotNull()).select(
        "*",
        _micros(ts).alias("_us"),
        F.when(F.col("action") == login_action, 0).otherwise(1).alias("_kind"),
    ).withColumn("_login_us", F.when(F.col("_kind") == 0, F.col("_us")))
    run = running_total(ev, [user], ["_us", "_kind", "log_id"], "_login_us", "_last_login_us", partitions, op="max")
    act = run.where(F.col("_kind") == 1)
    last = F.timestamp_micros(F.col("_last_login_us")).cast("timestamp_ntz")
    return act.select(
        "log_id", user, F.col(ts), "action",
        last.alias("last_login"),
        (F.col("_last_login_us").isNull() | (F.col("_us") - F.col("_last_login_us") > ttl_s * 1_000_000)).alias(
            "unauthorised"),
    )


# ---------------------------------------------------------------------------
# SES-3 last login per user
# ---------------------------------------------------------------------------
def last_login(log: DataFrame, user: str = "user_id", ts: str = "created_at", login_action: str = "LOGIN") -> DataFrame:
    return log.where(F.col("action") == login_action).groupBy(user).agg(F.max(ts).alias("last_login"))


# ---------------------------------------------------------------------------
# ST-4 batch twin: login lockout
# ---------------------------------------------------------------------------
# State between attempts: (count, until_us); until_us is None when unlocked.
# While locked the count stays at n (as the reference keeps it).


def _step(state, us, ok, active, n, lock_us):
    """One attempt: (outcome, failures after, new state)."""
    count, until = state
    if until is not None and us < until:
        return "refused", count, state
    if until is not None:
        count, until = 0, None
    if not active:
        return "inactive", count, (count, None)
    if ok:
        return "success", 0, (0, None)
    count += 1
    if count >= n:
        return "locked", count, (count, us + lock_us)
    return "failure", count, (count, None)


class _Fold:
    """The rule over one username's attempts from any clean start, in linear time.

    From a clean start the next lock is the n-th failure since the start or
    since a later success; the attempt that first finds the lock expired is
    a clean start again. So each start leads to one later start or to a final
    state, and the final states follow from right to left."""

    def __init__(self, us, ok, active, n: int, lock_us: int):
        self.us, self.n, self.lock_us = us, n, lock_us
        failed = active & ~ok
        self.fails = np.flatnonzero(failed)
        m = len(self.fails)
        self.wins = np.cumsum(active & ok)  # successes up to each attempt
        streak = self.wins[self.fails]
        nth = np.arange(m) + n - 1
        long_enough = (nth < m) & (streak[np.minimum(nth, m - 1)] == streak) if m else np.zeros(0, dtype=bool)
        first = np.concatenate(([True], streak[1:] != streak[:-1])) if m else np.zeros(0, dtype=bool)
        self.starts = np.flatnonzero(first & long_enough)  # streaks that lock, by their first failure
        self.next_streak = np.searchsorted(streak, streak, side="right")
        self.streak, self.long_enough = streak, long_enough
        lock = self._lock_after(np.searchsorted(self.fails, np.arange(len(us))))
        self.end = [self._open_end(j) if at < 0 else (n, int(us[at]) + lock_us) for j, at in enumerate(lock.tolist())]
        again = np.searchsorted(us, us[np.maximum(lock, 0)] + lock_us, side="left")
        for j in range(len(us) - 1, -1, -1):
            if lock[j] >= 0 and again[j] < len(us):
                self.end[j] = self.end[int(again[j])]

    def _lock_after(self, k):
        """Attempt that locks when counting starts with failure number k (-1: none does)."""
        m = len(self.fails)
        inside = np.minimum(k, max(m - 1, 0))
        at = np.full(len(k), -1, dtype=np.int64)
        if m:
            here = (k < m) & self.long_enough[inside]
            at[here] = self.fails[k[here] + self.n - 1]
            later = np.searchsorted(self.starts, self.next_streak[inside])
            there = ~here & (k < m) & (later < len(self.starts))
            at[there] = self.fails[self.starts[later[there]] + self.n - 1]
        return at

    def _open_end(self, j: int):
        """Final state from a clean start without any lock: the failures since the last success."""
        since = np.searchsorted(self.streak, self.wins[-1]) if len(self.fails) else 0
        return (len(self.fails) - max(int(np.searchsorted(self.fails, j)), int(since)), None)

    def from_count(self, c: int):
        """Final state when the first attempt finds c failures counted, unlocked."""
        if c == 0:
            return self.end[0]
        need = self.n - c - 1  # this many failures more before the one that locks
        m = len(self.fails)
        if need < m and self.streak[need] == 0 and self.fails[need] >= 0:
            return self._locked_at(int(self.fails[need]))
        wins = np.flatnonzero(np.diff(np.concatenate(([0], self.wins))) > 0)
        if len(wins):  # the first success clears the count: a clean start behind it
            return self.end[int(wins[0])]
        return (c + m, None)

    def _locked_at(self, at: int):
        until = int(self.us[at]) + self.lock_us
        again = int(np.searchsorted(self.us, until, side="left"))
        return self.end[again] if again < len(self.us) else (self.n, until)


def _segments(users):
    """[(start, end)) index ranges of equal consecutive users."""
    cuts = [0] + [i for i in range(1, len(users)) if users[i] != users[i - 1]] + [len(users)]
    return list(zip(cuts[:-1], cuts[1:]))


SUMMARY_SCHEMA = T.StructType([
    T.StructField("pid", T.IntegerType()),
    T.StructField("first_user", T.StringType()),
    T.StructField("last_user", T.StringType()),
    T.StructField("single", T.BooleanType()),
    # end state of the first segment for incoming unlocked counts 0..n-1
    T.StructField("out_by_count", T.ArrayType(T.ArrayType(T.LongType()))),
    # End state when the segment restarts clean at an attempt an incoming
    # lock can expire before (first lock window + one), run-length encoded:
    # runs of consecutive attempts (first time, last time) with one end state.
    T.StructField("restart_first_us", T.ArrayType(T.LongType())),
    T.StructField("restart_last_us", T.ArrayType(T.LongType())),
    T.StructField("restart_out", T.ArrayType(T.ArrayType(T.LongType()))),
    # end state of the last segment when it starts clean (not single)
    T.StructField("last_clean", T.ArrayType(T.LongType())),
])


def _enc(st):
    return [int(st[0]), -1 if st[1] is None else int(st[1])]


def _dec(v):
    return (int(v[0]), None if v[1] < 0 else int(v[1]))


def _lock_summary(n: int, lock_us: int):
    def fn(batches):
        parts = list(batches)
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        if pdf.empty:
            return
        us, ok, act = pdf["_us"].to_numpy(), pdf["success"].to_numpy(), pdf["_active"].to_numpy()
        users = pdf["_user"].tolist()
        segs = _segments(users)
        a, b = segs[0]
        fold = _Fold(us[a:b], ok[a:b].astype(bool), act[a:b].astype(bool), n, lock_us)
        out_by = [_enc(fold.from_count(c)) for c in range(n)]
        horizon = int(us[a]) + lock_us
        r_first, r_last, r_out = [], [], []
        for j in range(a, b):
            out = _enc(fold.end[j - a])
            if r_out and r_out[-1] == out:
                r_last[-1] = int(us[j])
            else:
                r_first.append(int(us[j]))
                r_last.append(int(us[j]))
                r_out.append(out)
            if int(us[j]) >= horizon:
                break
        c, d = segs[-1]
        last = _enc(_Fold(us[c:d], ok[c:d].astype(bool), act[c:d].astype(bool), n, lock_us).end[0]) if len(segs) > 1 else None
        yield pd.DataFrame([{
            "pid": int(pdf["_pid"].iloc[0]), "first_user": users[a], "last_user": users[-1],
            "single": len(segs) == 1, "out_by_count": out_by, "restart_first_us": r_first,
            "restart_last_us": r_last, "restart_out": r_out,
            "last_clean": last,
        }])

    return fn


def _resolve(summaries: list, n: int) -> dict[int, tuple]:
    """Incoming state of every partition's first segment, chained over the
    partitions in order (one small row per partition)."""
    incoming: dict[int, tuple] = {}
    prev_user, prev_out = None, None
    for r in sorted(summaries, key=lambda r: r["pid"]):
        st = prev_out if (prev_user is not None and r["first_user"] == prev_user) else (0, None)
        incoming[r["pid"]] = st
        count, until = st
        if until is None:
            out_first = _dec(r["out_by_count"][min(count, n - 1)])
        else:
            # the first attempt at or after the expiry lies in the first run
            # whose last attempt is at or after it
            nxt = [k for k, t in enumerate(r["restart_last_us"]) if t >= until]
            out_first = _dec(r["restart_out"][nxt[0]]) if nxt else st
        if r["single"]:
            prev_out = out_first
        else:
            prev_out = _dec(r["last_clean"])
        prev_user = r["last_user"]
    return incoming


def _lock_replay(n: int, lock_us: int):
    def fn(batches):
        parts = list(batches)
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        if pdf.empty:
            return
        us, ok, act = pdf["_us"].to_numpy(), pdf["success"].to_numpy(), pdf["_active"].to_numpy()
        users = pdf["_user"].tolist()
        c0, u0 = pdf["_in_count"].iloc[0], pdf["_in_until"].iloc[0]
        first = (int(c0), None if pd.isna(u0) else int(u0)) if not pd.isna(c0) else (0, None)
        outs, fails = [], []
        for k, (a, b) in enumerate(_segments(users)):
            st = first if k == 0 else (0, None)
            for i in range(a, b):
                o, f, st = _step(st, int(us[i]), bool(ok[i]), bool(act[i]), n, lock_us)
                outs.append(o)
                fails.append(f)
        yield pd.DataFrame({"attempt_id": pdf["attempt_id"].astype("int64"), "outcome": outs,
                            "failures": np.asarray(fails, dtype="int32")})

    return fn


def lockouts(attempts: DataFrame, n: int = LOCK_AFTER, lock_s: int = LOCK_SECONDS,
             partitions: int | None = None) -> DataFrame:
    """Outcome of every login attempt under the lockout rule, keyed by the
    lower-cased username: the ``n``-th failure in a row locks for
    ``lock_s``; attempts while locked are refused and not counted; the first
    attempt after expiry starts from zero; a success clears the count;
    attempts on a non-Active account ('inactive') change nothing.

    ``attempts``: attempt_id, ts, username, success, active.

    The fold is sequential per username, but a username is not one task:
    attempts are range-partitioned by (username, time); each partition
    summarises how its first username segment maps an incoming state to an
    outgoing one (n unlocked counts, plus restarts inside one lock window
    for an incoming lock). The driver chains those summaries - one row per
    partition - and a second pass replays each partition from its resolved
    incoming state (broadcast, one row per partition)."""
    spark = attempts.sparkSession
    lock_us = lock_s * 1_000_000
    a = attempts.select(
        "attempt_id", F.lower("username").alias("_user"), _micros("ts").alias("_us"), "success",
        F.coalesce(F.col("active"), F.lit(True)).alias("_active"),
    ).where(F.col("_user").isNotNull() & F.col("_us").isNotNull())
    parts = range_sorted(a, ["_user", "_us", "attempt_id"], partitions)
    summaries = [r.asDict() for r in parts.mapInPandas(_lock_summary(n, lock_us), SUMMARY_SCHEMA).collect()]
    incoming = _resolve(summaries, n)
    inc = spark.createDataFrame([(pid, st[0], st[1]) for pid, st in incoming.items()],
                                "_pid int, _in_count int, _in_until long")
    j = parts.join(F.broadcast(inc), PID, "left")
    res = j.mapInPandas(_lock_replay(n, lock_us), LOCKOUT_SCHEMA)
    return attempts.join(res, "attempt_id", "inner")


LOCKOUT_SCHEMA = T.StructType([
    T.StructField("attempt_id", T.LongType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("failures", T.IntegerType()),
])
