"""The log pipeline as a stream: files in; lines, readings, errors and alerts out, a quarantine beside them, and a store of the newest rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from boardlens.operators import diagnosis, logs
from boardlens.sources import files

TABLES = ("log_entry", "metrics", "error_context", "alert")
#: States of a file in the table `file`.
DONE, PENDING, REFUSED = "done", "pending", "refused"


def tables_of(batch: DataFrame, at: Column) -> dict[str, DataFrame]:
    """The tables of a batch of files (file, content): all their windows are within a file. Readings that break a bound are in quarantine."""
    lines = logs.parsed(logs.lines_of_files(batch))
    metrics = logs.last_readings(lines)
    errors = logs.error_context(lines)
    valid = logs.valid_readings(metrics)
    bad = metrics.where(~valid).select("file", F.lit("metrics").alias("stage"), F.lit("a reading is below zero").alias("error"), F.to_json(F.struct("device", "voltage_mv", "current_ma", "temp_c")).alias("row"))
    return {"log_entry": lines, "metrics": metrics.where(valid), "error_context": errors, "alert": logs.alerts(diagnosis.diagnosed(errors), at), "quarantine": bad}


def _states(rows: DataFrame, now: Column, settle: float) -> DataFrame:
    """Files with status and error: refused if they can't be parsed, pending while they were changed in the last `settle` seconds."""
    error = files.file_error(F.col("file"), F.col("size"), F.col("content"))
    young = F.coalesce(F.unix_micros(now) - F.unix_micros("modified") < int(settle * 1e6), F.lit(False))
    return rows.withColumn("error", error).withColumn("status", F.when(young, PENDING).when(F.col("error").isNotNull(), REFUSED).otherwise(DONE))


class LogJob:
    """Writes <out>/<table>/batch=<id> for each table, `quarantine` and `file` (the state of each file) among them; a batch that runs again overwrites its own.

    A file that was changed in the last `settle` seconds may still grow: it is pending, and is read again with a later batch, or by drain(). A file
    that can't be parsed goes to quarantine with its error, and the others of the batch arrive.
    """

    def __init__(self, spark: SparkSession, directory: str, out: str, settle: float = 0.0):
        self.spark, self.directory, self.out, self.settle = spark, directory, out.rstrip("/"), settle

    def _table(self, name: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.option("basePath", f"{self.out}/{name}").parquet(f"{self.out}/{name}") if there else None

    def pending(self, before: int) -> list[str]:
        """Paths whose last state before this batch is pending: the files that were young at the end of the batch before."""
        states = self._table("file")
        if states is None:
            return []
        last = states.where(F.col("batch") < before).groupBy("path").agg(F.max_by("status", "batch").alias("status"))
        return [r.path for r in last.where(F.col("status") == PENDING).select("path").collect()]

    def write(self, batch: DataFrame, batch_id: int, settle: float | None = None) -> None:
        again = self.pending(batch_id)
        if again:
            batch = batch.unionByName(self._read(again)).dropDuplicates(["path"])
        batch = _states(batch, F.current_timestamp(), self.settle if settle is None else settle).persist()
        try:
            done = batch.where(F.col("status") == DONE)
            tables = {} if done.isEmpty() else tables_of(done.select("file", "content"), F.current_timestamp())
            refused = batch.where(F.col("status") == REFUSED).select("file", F.lit("file").alias("stage"), "error", F.to_json(F.struct("path", "size")).alias("row"))
            tables["quarantine"] = tables["quarantine"].unionByName(refused) if tables else refused
            # The states come last: a batch that breaks off before is done again.
            tables["file"] = batch.select("path", "file", "size", "modified", "status", "error")
            for name, df in tables.items():
                df.write.mode("overwrite").parquet(f"{self.out}/{name}/batch={batch_id}")
        finally:
            batch.unpersist()

    def _read(self, paths: list[str]) -> DataFrame:
        """The files at paths, those that are gone as files of no bytes."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        there = [p for p in paths if fs.Path(p).getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs.Path(p))]
        gone = [(p.rsplit("/", 1)[-1], p, 0, None, "") for p in paths if p not in there]
        got = self.spark.createDataFrame(gone, "file string, path string, size long, modified timestamp, content string")
        return got.unionByName(files.log_files(self.spark, *there)) if there else got

    def start(self, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        writer = files.log_stream(self.spark, self.directory).writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()

    def drain(self, settle: float | None = None) -> int:
        """Takes up pending files where no new file starts a batch. Returns how many there were; run it while the stream rests."""
        states = self._table("file")
        if states is None:
            return 0
        last = states.agg(F.max("batch")).first()[0]
        again = self.pending(last + 1)
        if again:
            # Drained batches lie between those of the stream: ids of the stream go up by one, these by fractions of it.
            self.write(self._read(again), last + 1e-6, settle)
        return len(again)


def start(spark: SparkSession, directory: str, out: str, checkpoint: str, available_now: bool = True, settle: float = 0.0) -> StreamingQuery:
    """The stream of a directory of log files into the tables of LogJob."""
    return LogJob(spark, directory, out, settle).start(checkpoint, available_now)


class Newest(StatefulProcessor):
    """Keeps the newest rows of each key in a list state and puts out the store after each batch; with idle_ms, a key without rows for so long is dropped."""

    def __init__(self, key: str, seq: str, value: str, most: int, idle_ms: int | None = None):
        self.names, self.most, self.idle_ms = (key, seq, value), most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "seq long, value string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        name, seq, value = self.names
        kept = [(int(s), v) for s, v in self.rows.get()] if self.rows.exists() else []
        for part in rows:
            # Only the newest of each part can stay.
            part = part.nlargest(self.most, seq)
            kept += [(int(s), None if v is None else str(v)) for s, v in zip(part[seq], part[value], strict=True)]
            kept = sorted(kept, key=lambda r: r[0])[-self.most :]
        self.rows.put(kept)
        if self.idle_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer[0])
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame({name: [key[0]] * len(kept), seq: [s for s, _ in kept], value: [v for _, v in kept]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        yield from ()

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_newest(rows: DataFrame, key: str, seq: str, value: str, most: int, idle_ms: int | None = None) -> DataFrame:
    """(key, seq, value): after each micro-batch the newest `most` rows of a key that had new ones. A key's state is bounded by that.

    The session needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    own = rows.select(F.col(key).cast("string").alias(key), F.col(seq).cast("long").alias(seq), F.col(value).cast("string").alias(value))
    return own.groupBy(key).transformWithStateInPandas(Newest(key, seq, value, most, idle_ms), f"{key} string, {seq} long, {value} string", "update", "processingTime" if idle_ms is not None else "none")


def error_windows(lines: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """An extension: errors by device and time window of parsed lines with ts; rows later than `late` are left out."""
    hits = lines.withColumn("error_type", logs.error_class(F.col("raw"))).where("error_type is not null and ts is not null")
    return hits.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy("device", F.window("at", size)).agg(F.count("*").alias("n"))
