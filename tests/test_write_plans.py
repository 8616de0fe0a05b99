"""What queries that write their input several times, or in several runs, hand to the writers."""

import pytest

from shelfspark.plans import q_io, q_stream
from shelfspark.sources import raw as W

D = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("query", ["q_append_readback", "q_append_twice"])
def test_raw_sales_are_derived_once_however_often_they_are_written(spark, monkeypatch, query):
    """No append repeats the joins behind the rows; before, every write did."""
    written = []
    append, attempt = q_io.IO.append_csv, q_io.AP.AppendLog.write_attempt
    monkeypatch.setattr(q_io.IO, "append_csv", lambda df, *a: (written.append(_plan(df)), append(df, *a))[1])
    monkeypatch.setattr(q_io.AP.AppendLog, "write_attempt", lambda self, df, *a: (written.append(_plan(df)), attempt(self, df, *a))[1])
    assert "Join" in _plan(W.raw_sales(spark, D))
    rows = getattr(q_io, query)(spark, D).count()
    assert written and not any("Join" in plan for plan in written)
    assert rows == W.raw_sales(spark, D).count() * (2 if query == "q_append_readback" else 1)


def test_intake_takes_only_columns_that_choose_or_leave(spark, monkeypatch):
    feeds = []
    monkeypatch.setattr(q_stream, "run_intake", lambda feed, *a, **k: feeds.append(feed))
    q_stream.q_stream_dedup_no_horizon(spark, D)
    assert len(feeds) == q_stream.FILES
    assert all(set(f.columns) == {"transaction_code", "sale_date", "sale_time", "item_id", "quantity_sold"} for f in feeds)
