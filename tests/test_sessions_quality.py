"""SES-1/2, ST-4 lockout rules, DQ rules."""

import datetime as dt

from shelfspark.operators import quality as Q
from shelfspark.operators import sessions as S

T0 = dt.datetime(2026, 1, 17, 8, 0, 0)


def test_sessions_gap_boundaries(spark):
    rows = [(1, 1, T0), (2, 1, T0 + dt.timedelta(hours=23, minutes=59)),
            (3, 1, T0 + dt.timedelta(hours=23, minutes=59) + dt.timedelta(hours=24, minutes=1))]
    log = spark.createDataFrame(rows, "log_id long, user_id long, created_at timestamp_ntz")
    got = sorted((r.session_no, r.events) for r in S.sessions(log).collect())
    assert got == [(1, 2), (2, 1)]
    s1 = [r for r in S.sessions(log).collect() if r.session_no == 1][0]
    assert s1.warning_at == rows[1][2] + dt.timedelta(hours=24) - dt.timedelta(minutes=10)


def test_expired_activity(spark):
    rows = [(1, 1, "LOGIN", T0), (2, 1, "VIEW_REPORT", T0 + dt.timedelta(hours=7)),
            (3, 1, "VIEW_REPORT", T0 + dt.timedelta(hours=9)), (4, 2, "VIEW_REPORT", T0)]
    log = spark.createDataFrame(rows, "log_id long, user_id long, action string, created_at timestamp_ntz")
    got = {r.log_id: r.unauthorised for r in S.expired_activity(log).collect()}
    assert got == {2: False, 3: True, 4: True}


def _attempts(spark, seq, user="Ann"):
    rows = [(i, T0 + dt.timedelta(minutes=m), user if i % 2 else user.lower(), ok, True)
            for i, (m, ok) in enumerate(seq)]
    return spark.createDataFrame(rows, "attempt_id long, ts timestamp_ntz, username string, success boolean, "
                                       "active boolean")


def test_lockout_rules(spark):
    # 4 failures, success, 4 failures: never locked; usernames mixed case
    seq = [(i, False) for i in range(4)] + [(4, True)] + [(5 + i, False) for i in range(4)]
    out = [r.outcome for r in S.lockouts(_attempts(spark, seq)).orderBy("attempt_id").collect()]
    assert "locked" not in out and out[4] == "success"
    # 5 failures lock; attempt while locked refused (even a success); after expiry count restarts
    seq = [(i, False) for i in range(5)] + [(6, True), (16, False)]
    got = [(r.outcome, r.failures) for r in S.lockouts(_attempts(spark, seq)).orderBy("attempt_id").collect()]
    assert got[4] == ("locked", 5) and got[5] == ("refused", 5) and got[6] == ("failure", 1)


def test_quality_rules_one_violation_each(spark):
    o = spark.createDataFrame([
        ("PO1", "Received", None, 1, 1.0, 1, 1), ("PO2", "Pending", dt.date(2026, 1, 1), 1, 1.0, 1, 1),
        ("PO3", "Lost", None, 1, 1.0, 1, 1), ("PO4", "Pending", None, 0, 1.0, 1, 1),
        ("PO4", "Pending", None, 1, 1.0, 1, 9)],
        "order_code string, status string, date_received date, quantity_ordered int, cost_per_unit double, "
        "supplier_id long, item_id long")
    inv = spark.createDataFrame([(1, "ITM001")], "item_id long, item_code string")
    sup = spark.createDataFrame([(1, "SUP001", "S")], "supplier_id long, supplier_code string, supplier_name string")
    v = {(r.rule_id, r.row_key, r.column_name) for r in
         Q.validate({"restock_orders": o, "inventory": inv, "suppliers": sup}).collect()}
    assert ("DQ-3", "PO1", "date_received") in v and ("DQ-3", "PO2", "date_received") in v
    assert ("DQ-1", "PO3", "status") in v and ("DQ-2", "PO4", "quantity_ordered") in v
    assert ("DQ-5", "PO4", "order_code") in v and ("DQ-6", "PO4", "item_id") in v
    clean = {r.order_code for r in Q.quarantine(o, Q.validate({"restock_orders": o, "inventory": inv,
                                                                "suppliers": sup}), "restock_orders").collect()}
    assert clean == set()


def test_lockout_hot_user_across_partitions_matches_sequential(spark):
    """One username with most attempts, spread over many range partitions,
    including locks that are still running at partition borders."""
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(5)
    rows, t = [], T0
    for i in range(1500):
        t = t + dt.timedelta(minutes=rnd.choice([1, 1, 2, 3, 7, 15]))
        user = "Hot" if rnd.random() < 0.7 else f"u{rnd.randint(1, 9)}"
        rows.append((i, t, user if i % 3 else user.upper(), rnd.random() < 0.2, rnd.random() > 0.05))
    df = spark.createDataFrame(rows, "attempt_id long, ts timestamp_ntz, username string, success boolean, "
                                     "active boolean")
    got = {r.attempt_id: (r.outcome, r.failures) for r in S.lockouts(df, lock_s=600, partitions=9).collect()}
    want, state = {}, {}
    for i, ts, user, ok, active in sorted(rows, key=lambda r: (r[2].lower(), r[1], r[0])):
        us = int(ts.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
        o, f, st = S._step(state.get(user.lower(), (0, None)), us, ok, active, 5, 600_000_000)
        state[user.lower()] = st
        want[i] = (o, f)
    assert got == want
    assert "refused" in {o for o, _ in got.values()}


def test_lockout_fold_is_exact_and_linear():
    """Final states from every clean start and count equal a step-by-step run; a long attack stays fast."""
    import random
    import time

    import numpy as np

    from shelfspark.operators import sessions as S

    rng = random.Random(1)
    for _ in range(300):
        m, n, lock = rng.randrange(1, 25), rng.randrange(1, 5), rng.randrange(1, 12)
        us = np.sort(np.array([rng.randrange(40) for _ in range(m)], dtype=np.int64))
        ok = np.array([rng.random() < 0.25 for _ in range(m)])
        active = np.array([rng.random() < 0.85 for _ in range(m)])
        fold = S._Fold(us, ok, active, n, lock)

        def run(state, start):
            for i in range(start, m):
                state = S._step(state, int(us[i]), bool(ok[i]), bool(active[i]), n, lock)[2]
            return state

        assert fold.end == [run((0, None), j) for j in range(m)]
        assert [fold.from_count(c) for c in range(n)] == [run((c, None), 0) for c in range(n)]
    began = time.time()
    S._Fold(np.arange(100_000, dtype=np.int64), np.zeros(100_000, bool), np.ones(100_000, bool), 5, 10**9)
    assert time.time() - began < 20
