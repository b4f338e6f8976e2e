"""Python beside images sees batches of bounded rows, and gives rows back in bounded batches."""

import pyarrow as pa

from boardlens.operators import images as M
from boardlens.sources import batches as B
from boardlens.sources.elf import elf_image


def sizes(df):
    """The rows of each Arrow batch that a plan gives to what comes behind it."""

    def count(got):
        for batch in got:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return [r.n for r in df.mapInArrow(count, "n long").collect()]


def test_image_operators_bound_their_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    image = bytearray(elf_image(bytes(64), 4096, [("f", 4096, 16)]))
    files = spark.range(3 * B.BATCH_ROWS).coalesce(1).selectExpr("cast(id as string) as path").crossJoin(spark.createDataFrame([(image,)], "content binary"))
    images = M.parse_images(files)
    assert max(sizes(images)) <= B.BATCH_ROWS and M.symbols(images).count() == 3 * B.BATCH_ROWS


def test_rows_of_many_inputs_go_back_in_several_batches(spark):
    df = spark.range(0, 100, 1, 1)
    got = B.mapped_rows(df, lambda k: [(k,)] * 3, {"k": pa.int64()}, "k long", most=30)
    assert got.count() == 300 and got.selectExpr("sum(k)").first()[0] == 3 * 4950
