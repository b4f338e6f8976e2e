"""Documents drawn towards a target distribution by importance weights of hashed n-grams, in DataFrame functions only.

Texts are lower-cased A-Z; words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. Features are all runs of 1 to `most_words` words joined
by one blank, repeats counted; a feature's bucket is its crc32 modulo `buckets`.

1. Features of all documents and of all target texts are counted by bucket: counts combine in each task, so at most `buckets`
   rows of a task are shuffled. A bucket's gain is floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) for s of S features
   of the documents and t of T of the target.
2. The gain table, `buckets` rows whatever the input, is broadcast; gains are summed by document in the task that read it, so
   one small row a document is shuffled, and no text.
3. score = weight + floor(-1000 ln(-ln((h + 0.5) / 2**32))), h the first 8 hex digits of sha256(`seed:id`): the Gumbel trick, so the
   highest scores are a sample without replacement.
4. One distributed sort (eligible documents first, then by score, id and row) is written with each row's place; a place's rank is
   the number of rows in the partitions before it and its own place. Only the row counts of partitions meet in one task.

Cases: null or empty texts, and texts of signs only, have no features, weight 0 and are eligible only if `least_words` is 0; very long
texts are taken whole; repeated rows and repeated ids are documents of their own, with ranks of their own; equal scores go to smaller
ids, equal ids to the earlier row; a null id is seeded as an empty text and comes last among ties; an empty document table gives no rows, an empty
target counts as T = 0; columns that aren't named in `carry` are not read, so their names can't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boardlens.llm.store import discard, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD)
    return F.filter(parts, lambda w: w != "")


def features(own: Column, most_words: int) -> Column:
    """All runs of 1 to most_words words of an array, joined by a blank."""
    if most_words == 1:
        return own

    def runs(k: int) -> Column:
        n = F.greatest(F.size(own) - k + 1, F.lit(0))
        parts = [F.slice(own, F.lit(j + 1), n) for j in range(k)]
        return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, F.lit(" "), y)), parts)

    return F.concat(own, *(runs(k) for k in range(2, most_words + 1)))


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucket_counts(texts: DataFrame, text_col: str, buckets: int, most_words: int) -> DataFrame:
    """(bucket, n): how many features of all texts fall into a bucket; buckets without any are left out."""
    each = texts.select(F.explode(features(words(F.col(text_col)), most_words)).alias("f"))
    return each.groupBy(bucket(F.col("f"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of all buckets, from two tables of bucket counts."""
    every = target.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    total = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    share = ((F.col("t") + 1).cast("double") * (F.col("all_s") + buckets)) / ((F.col("s") + 1).cast("double") * (F.col("all_t") + buckets))
    return both.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(share)).cast("long").alias("gain"))


def gumbel(identity: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))) for u from the hash of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def ranked(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with `name`: 1, 2, 3 ... in this order over the whole table. The rows are written once, sorted by ranges, so places stay."""
    placed = saved(rows.orderBy(*order).withColumn("at_", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at_", 33).alias("part_")
    before = F.sum("n_").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1))
    counts = placed.groupBy(part).agg(F.count("*").alias("n_")).select("part_", F.coalesce(before, F.lit(0)).alias("before_"))
    out = placed.withColumn("part_", part).join(F.broadcast(counts), "part_")
    return out.withColumn(name, F.col("before_") + F.col("at_").bitwiseAND((1 << 33) - 1) + 1).drop("at_", "part_", "before_")


def importance_sample(
    docs: DataFrame,
    target: DataFrame,
    buckets: int = 10_000,
    most_words: int = 1,
    least_words: int = 20,
    percent: int = 10,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id_col, n_features, n_words, weight, score, rank, *carry), a row for each row of docs; rank is null where it isn't drawn.

    Of the N documents with least_words words or more, floor(percent N / 100) are drawn. With carry (say the text), the
    documents are written once with their row numbers, and what is carried joins the scores by these.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*(F.col(c) for c in carry)).alias("carry") if carry else F.lit(None).alias("carry"))
    own = own.withColumn("row", F.monotonically_increasing_id())
    if carry:
        own = saved(own, "documents")
    source = saved(bucket_counts(own, "text", buckets, most_words), "source")
    gain = saved(gains(source, bucket_counts(target, target_col, buckets, most_words), buckets), "gains")
    discard(source)
    each = own.select("row", "id", words(F.col("text")).alias("w")).select("row", "id", F.size("w").alias("n_words"), F.explode_outer(features(F.col("w"), most_words)).alias("f"))
    each = each.withColumn("bucket", bucket(F.col("f"), buckets)).join(F.broadcast(gain), "bucket", "left")
    # A document's features are all made in one task, which adds them up before anything is shuffled.
    summed = each.groupBy("row", "id", "n_words").agg(F.count("f").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    scored = summed.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)).withColumn("may", F.col("n_words") >= least_words)
    placed = ranked(scored, [F.desc("may"), F.desc("score"), F.asc_nulls_last("id"), F.asc("row")])
    drawn = placed.agg(F.expr(f"{percent} * count_if(may) div 100").alias("drawn"))
    out = placed.crossJoin(F.broadcast(drawn)).withColumn("rank", F.when(F.col("may") & (F.col("place") <= F.col("drawn")), F.col("place")))
    out = out.select("row", F.col("id").alias(id_col), "n_features", F.col("n_words").cast("long").alias("n_words"), "weight", "score", "rank")
    return out.join(own.select("row", "carry"), "row").drop("row").select("*", "carry.*").drop("carry") if carry else out.drop("row")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return importance_sample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op12_importance": op12_importance}
#: crc32 is taken byte by byte from its table, once for each distinct word.
_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
ORACLE = {
    "op12_importance": rf"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
f AS (SELECT r, unnest(w) AS word FROM d), g AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
v AS (SELECT DISTINCT word, hex(encode(word)) AS hx FROM (SELECT word FROM f UNION ALL SELECT word FROM g)),
b AS (SELECT word, xor(list_reduce([4294967295] || list_transform(range(len(hx) // 2), lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT)), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM v, crc),
s AS (SELECT bucket, count(*) AS s FROM f JOIN b USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM g JOIN b USING (word) GROUP BY bucket),
tot AS (SELECT (SELECT count(*) FROM f) AS ns, (SELECT count(*) FROM g) AS nt),
ga AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * (ns + 10000) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * (nt + 10000)))) AS BIGINT) AS gain FROM (SELECT DISTINCT bucket FROM b) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), tot),
x AS (SELECT r, sum(gain) AS weight FROM f JOIN b USING (word) JOIN ga USING (bucket) GROUP BY r),
y AS (SELECT d.r, doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, (CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296.0 AS u FROM d LEFT JOIN x USING (r)),
z AS (SELECT r, doc_id, CAST(n_features AS BIGINT) AS n_features, weight, weight + CAST(floor(-1000 * ln(-ln(u))) AS BIGINT) AS score FROM y),
k AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id NULLS LAST, r) END AS place FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM z WHERE n_features >= 20) // 100 THEN place END AS rank FROM k"""
}
