"""Shuffles and state grow in number with the tables, not in size."""

from shelfspark import session
from shelfspark.session import WIDTH, configure, shuffle_width, state_width


def test_width_follows_the_tables_and_state_follows_the_width(spark, tmp_path, monkeypatch):
    plain = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.range(200_000).repartition(2).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert shuffle_width(spark, str(tmp_path)) == plain  # small tables: the session's own
    monkeypatch.setattr(session, "WIDTH_BYTES", 20_000)
    wide = shuffle_width(spark, str(tmp_path))
    assert wide > 4 * plain
    try:
        configure(spark, str(tmp_path))
        assert int(spark.conf.get(WIDTH)) == wide
        with state_width(spark):
            assert int(spark.conf.get("spark.sql.shuffle.partitions")) == wide
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == plain
    finally:
        configure(spark)
    assert spark.conf.get(WIDTH, None) is None  # the training-data operators keep the session's width
