"""Crash addresses of log lines, and their functions and instructions by as-of joins.

Addresses are decimal(20,0), which holds unsigned 64 bits. Every table has an `image`; addresses are cut into buckets of 2**BUCKET_BITS bytes, so a
window spans one bucket; what comes before a bucket is carried over a tree of buckets, so no window spans an image.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boardlens.functions import text as X
from boardlens.functions import vocabulary as V

BUCKET_BITS, LEVEL_BITS = 16, 16


def line_addresses(line: Column) -> Column:
    """array<struct<pattern, at, hex>> of all addresses of a line."""

    def of(k: int, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(line, F.lit(pattern), 1), lambda a, i: F.struct(F.lit(k).alias("pattern"), i.alias("at"), F.lower(a).alias("hex")))

    parts = [of(k, pattern) for k, pattern in enumerate(V.CRASH_ADDRESSES)]
    return reduce(lambda a, b: F.concat(a, b), parts)


def crash_addresses(lines: DataFrame, key: str = "file") -> DataFrame:
    """(key, address, line_number, raw): each address of a log once, at its first place (line, pattern, position)."""
    found = lines.select(key, "line_number", "raw", F.explode(line_addresses(F.col("raw"))).alias("a")).withColumn("address", X.hex_to_decimal(F.col("a.hex"))).where("address is not null")
    place = F.struct("line_number", "a.pattern", "a.at")
    return found.groupBy(key, "address").agg(F.min_by(F.struct("line_number", "raw"), place).alias("first")).select(key, "address", "first.*")


def _carried(ends: DataFrame, bits: int = 64 - BUCKET_BITS) -> DataFrame:
    """ends (i, b, r), a row for each bucket that has rows -> (i, b, carried): the last r that isn't null in the buckets before b.

    Buckets of an image are a tree of LEVEL_BITS bits a level: the last row of each group of buckets is carried over among the groups first, and
    then into the buckets of a group. So a window has at most 2**LEVEL_BITS rows, however large the image.
    """
    if bits <= LEVEL_BITS:
        return ends.select("i", "b", F.last("r", ignorenulls=True).over(W.partitionBy("i").orderBy("b").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    own = ends.withColumn("up", F.shiftright("b", LEVEL_BITS))
    groups = own.groupBy("i", "up").agg(F.max_by("r", F.when(F.col("r").isNotNull(), F.col("b"))).alias("r"))
    above = _carried(groups.withColumnRenamed("up", "b"), bits - LEVEL_BITS).withColumnsRenamed({"b": "up", "carried": "above"})
    inside = F.last("r", ignorenulls=True).over(W.partitionBy("i", "up").orderBy("b").rowsBetween(W.unboundedPreceding, -1))
    return own.withColumn("inside", inside).join(above, ["i", "up"]).select("i", "b", F.coalesce("inside", "above").alias("carried"))


def as_of(left: DataFrame, right: DataFrame, at: str, start: str, seq: str, name: str, image: str = "image") -> DataFrame:
    """left with `name`: the row of right (a struct) with the last start at or before `at` in the same image; of equal starts the last by seq.

    Each address is looked up once, however many rows of left have it; a window spans one bucket of 2**BUCKET_BITS addresses.
    """
    whole = F.struct(*right.columns)
    kind = right.select(whole.alias("r")).schema["r"].dataType
    asked = left.select(F.col(image).alias("i"), F.col(at).cast("decimal(20,0)").alias("p")).where("i is not null and p is not null").distinct()
    ls = asked.select("i", _bucket(F.col("p")).alias("b"), "p", F.lit(1).alias("kind"), F.lit(None).cast(right.schema[seq].dataType).alias("s"), F.lit(None).cast(kind).alias("r"))
    rs = right.select(F.col(image).alias("i"), _bucket(F.col(start)).alias("b"), F.col(start).cast("decimal(20,0)").alias("p"), F.lit(0).alias("kind"), F.col(seq).alias("s"), whole.alias("r"))
    both = ls.unionByName(rs)
    # One row for each bucket that has rows: its last start.
    ends = both.groupBy("i", "b").agg(F.max_by("r", F.when(F.col("kind") == 0, F.struct("p", "s"))).alias("r"))
    inside = F.last("r", ignorenulls=True).over(W.partitionBy("i", "b").orderBy("p", "kind", "s").rowsBetween(W.unboundedPreceding, 0))
    found = both.withColumn("r", inside).where("kind = 1").join(_carried(ends), ["i", "b"]).select(F.col("i").alias("i_"), F.col("p").alias("p_"), F.coalesce("r", "carried").alias(name))
    return left.join(found, (F.col(image) == F.col("i_")) & (F.col(at).cast("decimal(20,0)") == F.col("p_")), "left").drop("i_", "p_")


def _bucket(address: Column) -> Column:
    return F.floor(address.cast("decimal(20,0)") / F.lit(1 << BUCKET_BITS)).cast("long")


def resolve_functions(addresses: DataFrame, symbols: DataFrame, at: str = "address") -> DataFrame:
    """Adds function and offset: of the symbol (size > 0) that starts last before the address, if it reaches that far; else ??? and 0."""
    got = as_of(addresses, symbols.where("size > 0"), at, "start", "seq", "sym")
    inside = F.col(at) < F.col("sym.start") + F.col("sym.size")
    return got.select(*addresses.columns, F.when(inside, F.col("sym.name")).otherwise("???").alias("function"), F.when(inside, (F.col(at) - F.col("sym.start")).cast("long")).otherwise(F.lit(0)).alias("offset"))


def _beside(ends: DataFrame, around: int, bits: int = 64 - BUCKET_BITS) -> DataFrame:
    """ends (image, b, head, tail), the first and last rows of each bucket that has rows -> (image, b, before, after): those next to it on
    both sides. Over the same tree of buckets as _carried.
    """
    none = F.array().cast(ends.schema["head"].dataType)

    def near(w, before: Column, after: Column) -> tuple[Column, Column]:
        up = F.concat(before, *(F.coalesce(F.lag("tail", k).over(w), none) for k in range(around, 0, -1)))
        down = F.concat(*(F.coalesce(F.lead("head", k).over(w), none) for k in range(1, around + 1)), after)
        return F.reverse(F.slice(F.reverse(up), 1, around)).alias("before"), F.slice(down, 1, around).alias("after")

    if bits <= LEVEL_BITS:
        return ends.select("image", "b", *near(W.partitionBy("image").orderBy("b"), none, none))
    own = ends.withColumn("up", F.shiftright("b", LEVEL_BITS))

    def sides(c: str) -> Column:
        return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("b", c))), lambda s: s[c]))

    groups = own.groupBy("image", "up").agg(F.slice(sides("head"), 1, around).alias("head"), F.reverse(F.slice(F.reverse(sides("tail")), 1, around)).alias("tail"))
    above = _beside(groups.withColumnRenamed("up", "b"), around, bits - LEVEL_BITS).select("image", F.col("b").alias("up"), F.col("before").alias("far"), F.col("after").alias("beyond"))
    return own.join(above, ["image", "up"]).select("image", "b", *near(W.partitionBy("image", "up").orderBy("b"), F.col("far"), F.col("beyond")))


def with_nearby(instructions: DataFrame, around: int = 2) -> DataFrame:
    """Adds the instructions up to two places before and after, in the order of addresses of the whole image.

    A window spans one bucket; its first and last rows are carried over to the buckets beside it, of which there is a row each.
    """
    one = F.struct("address", "mnemonic", "op_str")
    own = instructions.withColumn("b", _bucket(F.col("address")))
    w = W.partitionBy("image", "b").orderBy("address")
    own = own.withColumns({"up": F.collect_list(one).over(w.rowsBetween(-around, -1)), "down": F.collect_list(one).over(w.rowsBetween(1, around))})
    # The first rows of a bucket have few before them, the last ones few after them; with those, they are its ends.
    first = F.concat(F.array(one), "down")
    last = F.concat("up", F.array(one))
    ends = own.groupBy("image", "b").agg(F.slice(F.min_by(first, "address"), 1, around).alias("head"), F.reverse(F.slice(F.reverse(F.max_by(last, "address")), 1, around)).alias("tail"))
    out = own.join(_beside(ends, around), ["image", "b"])
    up = F.reverse(F.slice(F.reverse(F.concat("before", "up")), 1, around))
    return out.select(*instructions.columns, F.concat(up, F.array(one), F.slice(F.concat("down", "after"), 1, around)).alias("nearby"))


def resolve_instructions(addresses: DataFrame, instructions: DataFrame, at: str = "address") -> DataFrame:
    """Adds instruction (text) and nearby of the instruction that covers the address; both null if none does."""
    ready = with_nearby(instructions)
    got = as_of(addresses, ready.select("image", "address", "mnemonic", "op_str", "byte_len", "nearby").withColumnRenamed("address", "at_"), at, "at_", "at_", "ins")
    covers = F.col(at) < F.col("ins.at_") + F.col("ins.byte_len")
    return got.select(*addresses.columns, F.when(covers, X.strip(F.concat_ws(" ", "ins.mnemonic", "ins.op_str"))).alias("instruction"), F.when(covers, F.col("ins.nearby")).alias("nearby"))


def anomalies(lines: DataFrame, symbols: DataFrame, instructions: DataFrame) -> DataFrame:
    """Crash addresses whose function or instruction is known, with a severity by the line's words and a description."""
    found = crash_addresses(lines).withColumn("image", F.lit("image"))
    out = resolve_instructions(resolve_functions(found, symbols), instructions)
    out = out.where("function <> '???' or nearby is not null")
    at = F.concat(F.lit("0x"), F.lower(F.hex(F.col("address").cast("long"))))
    shown = F.concat(F.lit("Crash at "), F.when(F.col("function") == "???", at).otherwise(F.col("function")), F.lit("+0x"), F.lower(F.hex("offset")))
    return out.withColumn("severity", F.when(F.lower("raw").contains("fault"), "CRITICAL").otherwise("WARNING")).withColumn("description", shown)
