"""Streams: files that break, grow or carry bad readings, and stores that go on after a restart."""

import os
import time

import pytest
from pyspark.sql import functions as F

from boardlens.operators import stores
from boardlens.sources import files
from boardlens.streaming import jobs


def rows(spark, path, table):
    return spark.read.option("basePath", str(path / table)).parquet(str(path / table)).drop("batch")


def test_bad_files_land_in_quarantine_and_good_ones_arrive(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    old = time.time() - 1000
    for name, data in {"good_1.log": b"INFO voltage=3 mv\nkernel panic at 0x10\n", "neg_1.log": b"INFO voltage=-5 mv\nsegfault here\n", "broken_1.log": b"\x7f\x00\x01\x02" * 50, "bytes_1.txt": b"bad \xff\xfe bytes temp=4 c\n"}.items():
        (folder / name).write_bytes(data)
        os.utime(folder / name, (old, old))
    (folder / "grows_1.log").write_bytes(b"INFO current=1 ma\n")
    job = jobs.LogJob(spark, str(folder), str(out), settle=300)
    job.start(str(tmp_path / "cp")).awaitTermination()
    assert {r.file for r in rows(spark, out, "log_entry").collect()} == {"good_1.log", "neg_1.log", "bytes_1.txt"}
    assert {r.file for r in rows(spark, out, "metrics").collect()} == {"good_1.log", "bytes_1.txt"}
    assert {r.file for r in rows(spark, out, "error_context").collect()} == {"good_1.log", "neg_1.log"}
    assert {(r.file, r.stage, r.error) for r in rows(spark, out, "quarantine").collect()} == {("broken_1.log", "file", "not text"), ("neg_1.log", "metrics", "a reading is below zero")}
    assert "�" in rows(spark, out, "log_entry").where("file = 'bytes_1.txt'").first().raw
    # The file grows, comes to rest, and is taken whole: by drain, and no other time.
    (folder / "grows_1.log").write_bytes(b"INFO current=1 ma\nINFO current=2 ma\n")
    assert job.drain() == 1 and rows(spark, out, "log_entry").where("file = 'grows_1.log'").count() == 0
    os.utime(folder / "grows_1.log", (old, old))
    assert job.drain() == 1 and job.drain() == 0
    assert rows(spark, out, "log_entry").where("file = 'grows_1.log'").count() == 2
    assert rows(spark, out, "metrics").where("file = 'grows_1.log'").first().current_ma == 2.0


def test_pending_files_come_with_a_later_batch_and_lost_ones_are_refused(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    for name in ("a_1.log", "b_1.log"):
        (folder / name).write_text("INFO voltage=1 mv\n")
    job = jobs.LogJob(spark, str(folder), str(out), settle=300)
    job.start(str(tmp_path / "cp")).awaitTermination()
    assert not (out / "log_entry").exists()
    (folder / "b_1.log").unlink()
    (folder / "c_1.log").write_text("INFO voltage=3 mv\n")
    for name in ("a_1.log", "c_1.log"):
        os.utime(folder / name, (1, time.time() - 1000))
    job.start(str(tmp_path / "cp")).awaitTermination()
    assert {r.file for r in rows(spark, out, "log_entry").collect()} == {"a_1.log", "c_1.log"}
    assert rows(spark, out, "quarantine").where("file = 'b_1.log'").first().error == "too short: 0 bytes"


def test_code_trees_below_any_folder(spark, tmp_path):
    root = tmp_path / "tmp" / "build" / "my code+"
    for name, text in {"a.py": "x = 1\n", "lib/b.C": "int x;\n", "build/c.c": "no", "lib/.git/d.c": "no", "e_generated.py": "no", "f.min.js": "no", "readme": "no", "py": "no", "lib/a b.go": "package x\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    got = {(r.file_path, r.content) for r in files.code_files(spark, str(root)).collect()}
    assert got == {("a.py", "x = 1\n"), ("lib/b.C", "int x;\n"), ("lib/a b.go", "package x\n")}
    both = files.code_files(spark, str(root), str(root / "lib")).collect()
    assert len(both) == 3


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_a_store_goes_on_after_a_restart(spark, tmp_path, rocksdb):
    schema = "device string, seq long, message string"
    every, last = [], {}

    def keep(batch, _):
        for r in batch.groupBy("device").agg(F.array_sort(F.collect_list(F.struct("seq", "message"))).alias("rows")).collect():
            last[r.device] = [(x.seq, x.message) for x in r.rows]

    for run in range(3):
        new = [(f"d{k % 2}", run * 100 + (k * 7) % 50, f"m{run}.{k}") for k in range(50 if run < 2 else 3)]
        every += new
        spark.createDataFrame(new, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = jobs.keep_newest(stream, "device", "seq", "message", 10).writeStream.foreachBatch(keep).outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.awaitTermination()
    for device in ("d0", "d1"):
        batch = stores.recent_logs(spark.createDataFrame(every, schema).where(F.col("device") == device), ["seq"], 10).collect()
        assert last[device] == [(r.seq, r.message) for r in batch]


def test_idle_keys_are_dropped(spark, tmp_path, rocksdb):
    schema, got = "device string, seq long, message string", []

    def put(seq: int) -> None:
        spark.createDataFrame([("d0", seq, f"m{seq}")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def wait(n: int) -> None:
        for _ in range(300):
            if len(got) >= n:
                return
            time.sleep(0.1)

    put(0)
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    # Timers of processing time start batches of their own, so this query runs until it is stopped.
    kept = jobs.keep_newest(stream, "device", "seq", "message", 5, idle_ms=1000).writeStream.outputMode("update").trigger(processingTime="200 milliseconds")
    q = kept.foreachBatch(lambda b, _: got.extend(x for x in [[r.seq for r in b.collect()]] if x)).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        wait(1)
        time.sleep(5)
        put(1)
        wait(2)
    finally:
        q.stop()
    assert got == [[0], [1]]
