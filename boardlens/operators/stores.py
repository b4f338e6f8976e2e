"""Views of the newest rows, and rolling windows of readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boardlens.functions import vocabulary as V
from boardlens.operators import ordered


def newest(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The `most` newest rows, newest first. A sort with a limit keeps at most that many rows of each task."""
    return rows.orderBy(*order).limit(most)


def recent_logs(rows: DataFrame, seq: list[str], limit: int = 100, most: int = V.RECENT_LOGS) -> DataFrame:
    """The last `limit` of the newest `most` rows; none for 0. Their order of arrival is that of seq."""
    return newest(rows, [F.desc(c) for c in seq], min(limit, most)).orderBy(*seq)


def recent_alerts(rows: DataFrame, seq: list[str], limit: int = V.RECENT_ALERTS) -> DataFrame:
    return newest(rows, [F.desc(c) for c in seq], min(limit, V.RECENT_ALERTS))


def rolling(readings: DataFrame, key: str, order: list[str], value: str, samples: int = 60, slice_rows: int = ordered.SLICE) -> DataFrame:
    """Mean, least and most of the last `samples` values of a key at each row.

    Rows are numbered in the order of key and time; a window spans a slice of them and the samples - 1 rows before it, so a key with
    any share of the rows is many tasks. Rows that tie in `order` may come in either order.
    """
    own = ordered.sliced(ordered.numbered(readings, [key, *order]), samples - 1, slice_rows=slice_rows)
    w = W.partitionBy("slice_", key).orderBy("place").rowsBetween(1 - samples, 0)
    return own.withColumns({"mean": F.avg(value).over(w), "least": F.min(value).over(w), "most": F.max(value).over(w)}).where("own_").drop("slice_", "own_", "place")


def latest(readings: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    return readings.groupBy(key).agg(*(F.max_by(v, order).alias(v) for v in values))


def page(rows: DataFrame, order: list[str], offset: int, limit: int, most: int = 2000) -> DataFrame:
    """One page with the total; offsets below 0 are refused."""
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit are not negative")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(min(limit, most)).crossJoin(F.broadcast(total))
