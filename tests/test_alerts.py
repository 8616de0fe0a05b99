"""SES-1 warnings and logouts as a stream: stretches and due alerts against the plain gaps."""

import datetime as dt
import os
import random
import tempfile

from shelfspark.streaming import alerts as AL
from shelfspark.streaming.core import run_to_table

QUIET, GAP = 20, 24


def plain(times):
    """Alerts from the sorted activity of one user."""
    out, start, n = [], None, 0
    for k, t in enumerate(times):
        start, n = (t, 1) if start is None else (start, n + 1)
        left = times[k + 1] - t if k + 1 < len(times) else GAP
        out += [("warning", t + QUIET, start, t, n)] if left >= QUIET else []
        if left >= GAP:
            out.append(("logout", t + GAP, start, t, n))
            start = None
    return sorted(out)


def test_due_alerts_whatever_the_order_within_the_delay():
    rnd = random.Random(5)
    for _ in range(500):
        delay = rnd.randrange(0, 60)
        times = sorted(rnd.randrange(400) for _ in range(rnd.randrange(1, 25)))
        arriving = sorted(times, key=lambda t: t + rnd.random() * delay)
        held, warned, start, before, got, now, most = [], False, None, 0, [], -1, 0
        while arriving:
            k = rnd.randrange(1, 5)
            batch, arriving = arriving[:k], arriving[k:]
            assert all(t > now for t in batch)
            held = AL.join_stretches(held + [(t, t, 1) for t in batch], QUIET)
            fired, held, warned, start, before = AL.due(held, warned, start, before, now, QUIET, GAP)
            got += fired
            most = max(most, *batch)
            now = max(now, most - delay - 1)
            assert len(held) <= (delay + GAP) // QUIET + 2 + len(batch) * 2
        got += AL.due(held, warned, start, before, 10_000, QUIET, GAP)[0]
        assert sorted(got) == plain(times)


def test_stream_over_restarts(spark):
    src, base = tempfile.mkdtemp(prefix="shelfspark-alerts-"), tempfile.mkdtemp(prefix="shelfspark-alerts-out-")
    t0 = dt.datetime(2026, 1, 1, 8)

    def at(hours, minutes=0):
        return t0 + dt.timedelta(hours=hours, minutes=minutes)

    big = (1 << 60) + 1  # ids beyond doubles, beside rows without a user
    parts = [[(big, at(0), "x"), (2, at(0), "x"), (2, at(0), "x"), (None, at(1), "x"), (3, None, "x")],
             [(big, at(23, 55), "x"), (2, at(24), "y"), (None, at(60), "x")],  # warned of but in time; logged out
             [(None, at(200), "beat")]]
    schema = "user_id long, created_at timestamp_ntz, kind string"
    for rows in parts:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(os.path.join(src, "x"))
        feed = spark.readStream.schema(schema).parquet(os.path.join(src, "x"))
        out = run_to_table(AL.stream_session_alerts(feed, "1 day"), "alerts", base=base)
    got = sorted((r.user_id, r.kind, r.fires_at, r.session_start, r.last_activity, r.events) for r in out.collect())
    warn = dt.timedelta(hours=23, minutes=50)
    day = dt.timedelta(hours=24)
    assert got == sorted([
        (big, "warning", at(0) + warn, at(0), at(0), 1),
        (big, "warning", at(23, 55) + warn, at(0), at(23, 55), 2), (big, "logout", at(23, 55) + day, at(0), at(23, 55), 2),
        (2, "warning", at(0) + warn, at(0), at(0), 2), (2, "logout", at(0) + day, at(0), at(0), 2),
        (2, "warning", at(24) + warn, at(24), at(24), 1), (2, "logout", at(24) + day, at(24), at(24), 1)])


def test_empty_feed(spark):
    src = tempfile.mkdtemp(prefix="shelfspark-alerts-")
    spark.createDataFrame([], "user_id long, created_at timestamp").write.mode("append").parquet(os.path.join(src, "x"))
    feed = spark.readStream.schema("user_id long, created_at timestamp").parquet(os.path.join(src, "x"))
    assert run_to_table(AL.stream_session_alerts(feed), "alerts-none").count() == 0


def test_users_share_calls_and_a_state_row(spark):
    held = {5: ([(1, 2, 3), (90, 95, 2)], True, 1, 4), -7: ([(4, 4, 1)], False, None, 0)}
    assert AL.unpack(AL.pack(held)) == held and AL.unpack(AL.pack({})) == {}

    class State:
        exists, get, timeout = False, None, None

        def getCurrentWatermarkMs(self):
            return 0

        def update(self, value):
            self.exists, self.get = True, value

        def setTimeoutTimestamp(self, ms):
            self.timeout = ms

    import pandas as pd

    state, hour = State(), 3_600_000_000
    pdf = pd.DataFrame({"user_id": [1, 2, 1], "first": [5 * hour, hour, hour], "last": [6 * hour, 2 * hour, 4 * hour], "events": [2, 3, 4]})
    out = list(AL._step(20 * hour, 24 * hour)((3,), iter([pdf]), state))
    assert sum(map(len, out)) == 0
    assert AL.unpack(state.get) == {1: ([(hour, 6 * hour, 6)], False, None, 0), 2: ([(hour, 2 * hour, 3)], False, None, 0)}
    assert state.timeout == 22 * 3_600_000  # the user due first
