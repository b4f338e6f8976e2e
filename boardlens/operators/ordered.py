"""Windows over one long order without one task that holds it: places by a distributed sort, and slices with a halo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boardlens.sources.stages import written

#: Rows of a slice.
SLICE = 1 << 14


def numbered(rows: DataFrame, order: list[str | Column], name: str = "place") -> DataFrame:
    """rows with `name`: 0, 1, 2 ... in this order over the whole table.

    The rows are sorted by ranges and written with their places inside a range; only the row counts of ranges meet in one task.
    """
    sorted_ = written(rows.orderBy(*order).withColumn("at_", F.monotonically_increasing_id()), "sorted")
    before = F.sum("n_").over(W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1))
    counts = sorted_.groupBy(F.shiftright("at_", 33).alias("range_")).agg(F.count("*").alias("n_")).select("range_", F.coalesce(before, F.lit(0)).alias("before_"))
    out = sorted_.withColumn("range_", F.shiftright("at_", 33)).join(F.broadcast(counts), "range_")
    return out.withColumn(name, F.col("before_") + F.col("at_").bitwiseAND((1 << 33) - 1)).drop("at_", "range_", "before_")


def sliced(rows: DataFrame, before: int, after: int = 0, place: str = "place", slice_rows: int = SLICE) -> DataFrame:
    """Numbered rows with `slice_` and `own_`: each row in its slice, and those near an edge also, as a halo (own_ false), in the slice beside it.

    A window of at most `before` rows before and `after` rows after a row lies whole in the row's slice.
    """
    if max(before, after) > slice_rows:
        raise ValueError("a slice holds the rows that a window sees")
    k, at = F.floor(F.col(place) / slice_rows), F.col(place) % slice_rows
    own = F.struct(k.alias("slice_"), F.lit(True).alias("own_"))
    follows = F.when(at >= slice_rows - before, F.struct((k + 1).alias("slice_"), F.lit(False).alias("own_")))
    leads = F.when((at < after) & (k > 0), F.struct((k - 1).alias("slice_"), F.lit(False).alias("own_")))
    return rows.select("*", F.inline(F.filter(F.array(own, follows, leads), lambda s: s.isNotNull())))
