"""A set of 64-bit keys as a bitmap of bounded size: never misses a key, may admit others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 32
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28


class KeyFilter:
    """Two probes per key into 2**k bits, at most MOST_BITS (32 MB). Beyond its capacity it admits more, and never less."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 64 - 1)

    def __contains__(self, key: int) -> bool:
        return bool(self.admits(np.array([key], np.uint64))[0])

    def admits(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64, copy=False)
        out = np.ones(len(keys), bool)
        for probe in (keys & self.mask, (keys >> np.uint64(32)) & self.mask):
            out &= (self.bits[(probe >> np.uint64(6)).astype(np.int64)] >> (probe & np.uint64(63))) & np.uint64(1) == 1
        return out


def key_filter(keys: DataFrame, column: str) -> KeyFilter:
    """The filter of a long column of well-mixed keys. Bits are or-ed by word in Spark; the driver gets words of bits, MOST_BITS / 64 at most."""
    n = keys.count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_KEY * max(n, 1) - 1).bit_length()))
    low, high = F.col(column).bitwiseAND(size - 1), F.shiftrightunsigned(column, 32).bitwiseAND(size - 1)
    words = (
        keys.select(F.explode(F.array(low, high)).alias("p"))
        .groupBy(F.shiftright("p", 6).cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    )
    got = words.toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return KeyFilter(bits)


def docs_filter(ids: DataFrame, *columns: str) -> Broadcast[KeyFilter]:
    """The filter of xxhash64 of the columns, for the tasks."""
    return ids.sparkSession.sparkContext.broadcast(key_filter(ids.select(F.xxhash64(*columns).alias("h")), "h"))


def admitted(admit: Broadcast[KeyFilter], hashes: pa.Array) -> np.ndarray:
    """Which xxhash64 values of ids the filter admits."""
    return admit.value.admits(hashes.to_numpy().view(np.uint64))


def may_be_in(ids: DataFrame, *columns: str) -> F.Column:
    """Whether a row may be among the rows of ids by these columns; only hashes go to Python."""
    admit = docs_filter(ids, *columns)

    @F.arrow_udf("boolean")
    def may(h: pa.Array) -> pa.Array:
        return pa.array(admitted(admit, h))

    return may(F.xxhash64(*columns))


def split_by_ids(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs whose id may be in ids, the other docs): only texts of the first need go on to meet their rows in ids."""
    may = may_be_in(ids, "id")
    return docs.where(may), docs.where(~may)


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id_col is not in the column `id` of ids. Only rows that the filter admits are shuffled."""
    keyed = docs.withColumn("id", F.col(id_col)) if id_col != "id" else docs
    may, sure = split_by_ids(keyed, ids.select("id").distinct())
    return may.join(ids.select("id").distinct(), "id", "left_anti").select(docs.columns).unionByName(sure.select(docs.columns))
