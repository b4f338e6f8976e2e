"""Log sets of files with more than 100 lines."""

import datetime as dt

import pytest

from boardlens.plans import code as P


@pytest.fixture
def long_day(spark, tmp_path):
    """A day of one board with 249 lines without errors and a panic in the last one, and a short day."""
    at = dt.datetime(2024, 1, 1)
    rows = [(k, at + dt.timedelta(seconds=k), 8, "view", float(k)) for k in range(249)]
    rows += [(300, at + dt.timedelta(hours=1), 8, "error", 1.0), (301, at + dt.timedelta(days=1), 8, "view", 1.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_lines_after_the_hundredth_count(spark, long_day):
    address = f"0x{134217728 + 4 * 300:08x}"
    got = {r.set_id: r for r in P.logset_parse(spark, long_day).collect()}
    a, b = got["board00_20240101.log"], got["board00_20240102.log"]
    assert (a.error_count, a.warning_count, a.severity, a.error_type) == (1, 0, "CRITICAL", "panic")
    assert a.summary == f"2024-01-01 01:00:00 kernel panic at {address}" and b.severity == "INFO"
    assert P._sets(spark, long_day).where("set_id = 'board00_20240101.log'").first().n_lines == 250
    query = {r.set_id: r.query for r in P.logset_query(spark, long_day).collect()}
    assert query["board00_20240101.log"].startswith("panic ") and P.logset_addresses(spark, long_day).count() == 2
    assert P.batch_counts(spark, long_day).first().asDict() == {"succeeded": 1, "failed": 1, "total": 2}
