"""Images that are cut off within their header."""

import duckdb
import pytest

from boardlens.operators import images as M
from boardlens.plans import retrieval as R
from boardlens.sources.elf import elf_image


@pytest.mark.parametrize(("kept", "arch", "entry"), [(18, "unknown", None), (20, "arm", None), (28, "arm", 4096), (40, "arm", 4096), (51, "arm", 4096)])
def test_a_cut_header_keeps_the_fields_it_holds(kept, arch, entry):
    got = M.read_elf(elf_image(bytes(8), 4096, [])[:kept])
    assert (got["arch"], got["entry"], got["code"], got["symbols"]) == (arch, entry, b"", []) and got["error"]


def test_registered_metadata_equals_its_sql(spark, tmp_path):
    spark.range(256 * 6).selectExpr("id as p_partkey", "'p' as p_name", "cast(id % 50 as int) as p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = con.execute(R.ORACLE["image_metadata"]).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in R.image_metadata(spark, str(tmp_path)).collect())
