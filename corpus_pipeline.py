"""A corpus pipeline: quality, near-dedup, substring dedup, decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. Rows with a null doc_id pass near-dedup and substring dedup as they are, since neither can name them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.llm import bpe_codec, decontamination, minhash_dedup, quality, substring_dedup
from boardlens.llm.filters import split_by_ids, without_ids
from boardlens.llm.store import saved

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, and no others; one that is missing is null (n_chars: counted)."""
    absent = {c: F.char_length("text").cast("long") if c == "n_chars" else F.lit(None).cast("string") for c in COLUMNS if c not in docs.columns}
    return docs.withColumns(absent).select(*COLUMNS) if absent else docs.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of low quality and toxic ones. A row is judged by its content, so equal rows share a key, and go or stay together.

    Null and empty texts are judged by their site alone; very long texts whole; an empty table stays empty; columns beside those of documents
    are left out, of any name.
    """
    docs = with_columns(docs)
    models = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    keyed = docs.withColumn("row_key", F.xxhash64(*COLUMNS))
    judged = quality.judge(keyed, models, F.col("source"), F.col("lang"), id_col="row_key")
    rejected = saved(judged.where("rejected").select(F.col("row_key").alias("id")).distinct(), "rejected")
    return without_ids(keyed, rejected, "row_key").drop("row_key")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, similarity 0.8): that of the smallest doc_id.

    Documents are told apart by id and text: an id that comes with several texts has each of them judged for itself, and a document that
    repeats one row for row stays once. Where all copies of a group share the smallest id with other texts, one of that id stays for each class of texts.
    Null, empty and blank texts are near nothing and stay, as do rows without an id; very long texts are judged whole; an empty table stays empty.
    """
    own = with_columns(docs).withColumn("key", F.struct("doc_id", F.unhex(F.sha2("text", 256)).alias("digest")))
    found = minhash_dedup.near_duplicates(own.where("doc_id is not null"), id_col="key")
    gone = saved(found.where("not kept").select(F.col("key").alias("id")).distinct(), "gone")
    kept = without_ids(own, gone, "key")
    repeated = found.groupBy(F.col("key").alias("id")).count().where("count > 1").select("id")
    may, sure = split_by_ids(kept.withColumn("id", F.col("key")), saved(repeated, "repeated"))
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)) & F.col("doc_id").isNotNull()
    once = may.where(has_words).dropDuplicates(["key"]).unionByName(may.where(~has_words))
    return once.unionByName(sure).select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words out that lie in windows of 50 words which a document with a smaller id has; other texts stay as they are, white space included.

    A text that is covered whole becomes empty and its row stays; texts of fewer words, null and empty ones have no windows; very long texts
    are judged whole; rows of one id (ties, repeated rows) take nothing from each other; an empty table stays empty.
    """
    got = substring_dedup.substring_dedup(with_columns(docs).withColumn("own", F.col("doc_id")), id_col="own", carry=COLUMNS)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return got.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark passages are a twentieth of the words or more.

    Null, empty and blank texts have no words and stay; very long texts are searched whole; each row is judged for itself, repeated ones
    alike; without benchmark rows all stay; an empty table stays empty.
    """
    rows = with_columns(docs).select(F.struct(*COLUMNS).alias("row"), "text")
    got = decontamination.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row")
    return got.where("not contaminated").select("row.*")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256), a row for each row: ids are little-endian unsigned 32-bit integers.

    A null text is an empty one, with no ids; very long texts are encoded whole; repeated rows and ids come out as often as they come in; an
    empty table gives no rows; other columns are not read.
    """
    got = bpe_codec.encode(docs, bpe_codec.model_path("byte_bpe_50k.json"))
    return got.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]
#: The trained classifier of the first stage has no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after the other; each but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
