"""Long jobs store the rows between their wide shuffles, so that the disk holds one step's shuffles and not all of them."""

import os
import zlib

import numpy as np
import pytest
from helpers import rows
from shelfspark.operators import etl as E
from shelfspark.plans import q_io, q_raw, q_stream
from shelfspark.plans.catalog import AS_OF
from shelfspark.sources import io as IO
from shelfspark.sources import raw as W
from shelfspark.streaming import core
from shelfspark.streaming import replay as RP

D = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def kept(monkeypatch):
    """Steps of a query: (name, plan of the frame that was stored), and the folder."""
    class Seen(IO.Steps):
        def __call__(self, df, name):
            out = super().__call__(df, name)
            if out is not df:
                seen.append((name, _plan(df)))
                roots.append(self.root)
            return out

    seen, roots = [], []
    monkeypatch.setattr(q_raw, "Steps", Seen)
    return seen, roots


def _left(root):
    return sorted(f for f in os.listdir(root.removeprefix("file:")) if not f.startswith("."))


def test_load_sales_holds_one_step_at_a_time(spark, kept):
    seen, roots = kept
    good = q_raw.q_load_sales(spark, D)
    assert [n for n, _ in seen] == ["raw", "items", "firsts"]
    assert "Window" not in seen[0][1] and "Join" not in seen[2][1]  # a step reads the one before
    assert _left(roots[0]) == ["firsts"]
    _, inv, usr = q_raw._loaded(spark, D)
    want, _ = E.load_sales(W.raw_sales(spark, D), inv, usr, AS_OF)
    assert rows(good) == rows(want) and good.count() > 1000


def test_rejects_store_no_step_that_they_do_not_read(spark, kept):
    seen, roots = kept
    q_raw.q_load_sales_rejects(spark, D)
    assert [n for n, _ in seen] == ["raw", "items"] and _left(roots[0]) == ["items"]


def test_load_orders_holds_one_step_at_a_time(spark, kept):
    seen, roots = kept
    good = q_raw.q_load_orders(spark, D)
    assert [n for n, _ in seen] == ["raw", "suppliers", "items"]
    assert "Join" not in _plan(good) and _left(roots[0]) == ["items"]


def test_csv_appends_take_little_room_and_read_back_whole(spark, tmp_path):
    path = f"{tmp_path}/log"
    cells = [(f"1/2/20{k % 30:02d}", f"Item, \"{k % 40}\"\nsecond line", str(k)) for k in range(6000)]
    df = spark.createDataFrame(cells, "Date string, Item_Name string, Quantity_Sold string")
    for _ in range(2):
        IO.append_csv(df, path, df.columns)
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert files and sum(os.path.getsize(f"{path}/{f}") for f in files) * 3 < 2 * sum(len("".join(c)) for c in cells)
    assert rows(IO.read_raw(spark, path)) == sorted(cells * 2)


def test_append_readback_keeps_no_copy_beside_what_it_wrote(spark, monkeypatch):
    roots = []
    start = IO.Steps.__init__
    monkeypatch.setattr(IO.Steps, "__init__", lambda self, *a: (start(self, *a), roots.append(self.root))[0])
    assert q_io.q_append_readback(spark, D).count() == 2 * W.raw_sales(spark, D).count() and _left(roots[0]) == []


def test_replay_leaves_its_revisions_only(spark, tmp_path, monkeypatch):
    roots, names = [], []
    plain = q_stream.scratch
    monkeypatch.setattr(q_stream, "scratch", lambda s, name: (roots.append(plain(s, name)), roots[-1])[1])
    monkeypatch.setattr(core, "scratch", lambda s, name: (names.append(f"{tmp_path}/{name}"), names[-1])[1])
    out = q_stream.q_stream_ledger_receipts(spark, D)
    assert _left(names[0]) == ["data"]  # no state, no log of the stream
    dealt = [r.removeprefix("file:") for r in roots if "/replay-" in r]
    assert dealt and not any(os.path.exists(r) for r in dealt)
    assert out.count() > 6000


def test_state_is_packed_by_byte_places_and_old_state_is_read():
    rng = np.random.default_rng(3)
    rows = np.zeros(20_000, dtype=RP.EVENTS)
    rows["us"] = np.sort(rng.integers(9 * 10 ** 14, 10 ** 15, len(rows)) // 10 ** 6 * 10 ** 6)
    rows["txn"], rows["qty"], rows["avail"] = (rng.integers(0, n, len(rows)) for n in (10 ** 8, 50, 90))
    rows["ok"] = rows["qty"] <= rows["avail"]
    old = zlib.compress(b"".join(np.ascontiguousarray(rows[c]).tobytes() for c in rows.dtype.names), 1)
    new = RP._pack(rows)
    assert len(new) < 0.8 * len(old)
    for data in (old, new, bytearray(new)):
        assert (RP._unpack(data, RP.EVENTS) == rows).all()
    assert len(RP._unpack(RP._pack(rows[:0]), RP.EVENTS)) == 0


def test_newest_revisions_come_slice_after_slice(spark, tmp_path):
    rest = "event_us long, receipt boolean, transaction_id long, line_no long, quantity long, copy long, accepted boolean, batch_id int"
    data = [(k % 7 if k % 11 else None, k, False, k, 1, 2, 0, (k + b) % 2 == 0, b) for k in range(200) for b in range(1 + k % 3)]
    revisions = spark.createDataFrame(data, f"item_id long, {rest}")
    newest = RP.latest_stored(revisions, f"{tmp_path}/newest", slices=3)
    assert _left(f"{tmp_path}/newest") == ["slice=0", "slice=1", "slice=2"]
    assert sorted(newest.collect(), key=str) == sorted(RP.latest(revisions).collect(), key=str) and newest.count() == 200
