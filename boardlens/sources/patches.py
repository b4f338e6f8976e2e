"""A data source that writes patches, one file each: `df.write.format("patches").option("path", folder).mode("append").save()`.

Rows are (device, stamp, patch). A task writes into a folder of its own below `_parts`; only the driver's commit, which hears of successful
tasks alone, moves files to their names, so a task that is tried again, or runs twice, leaves each file once. A failed job leaves none.
Where two rows of a job have one name, later ones get _2, _3 ... before .patch; with append, files of earlier jobs stay and names go on
beside them. The folder is any that pyarrow's file systems reach (a shared mount, hdfs://, s3://).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from boardlens.operators import diagnosis

SCHEMA = "device string, stamp string, patch string"


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: (path, name) of each file."""

    files: list[tuple[str, str]] = field(default_factory=list)


class PatchWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex

    def _at(self):
        files, root = _files(self.folder)
        return files, root.rstrip("/")

    def write(self, rows: Iterator[Row]) -> Written:
        files, root = self._at()
        part, done = f"{root}/_parts/{self.job}/{uuid.uuid4().hex}", Written()
        files.create_dir(part)
        for k, row in enumerate(rows):
            path = f"{part}/{k}"
            with files.open_output_stream(path) as out:
                out.write((row["patch"] or "").encode())
            done.files.append((path, f"{row['name']}"))
        return done

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, root = self._at()
        own = [x for m in messages if m is not None for x in m.files]
        there = {i.base_name for i in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.type == fs.FileType.File}
        if self.overwrite:
            for name in there:
                files.delete_file(f"{root}/{name}")
            there = set()
        for path, name in sorted(own, key=lambda x: x[1]):
            stem, k, to = name.removesuffix(".patch"), 1, name
            while to in there:
                k += 1
                to = f"{stem}_{k}.patch"
            there.add(to)
            files.move(path, f"{root}/{to}")
        self._clear(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._at())

    def _clear(self, files, root: str) -> None:
        from pyarrow import fs

        for at in (f"{root}/_parts/{self.job}", f"{root}/_parts"):
            if files.get_file_info(at).type == fs.FileType.Directory and (at.endswith(self.job) or not files.get_file_info(fs.FileSelector(at))):
                files.delete_dir(at)


class PatchSource(DataSource):
    """The format `patches`."""

    @classmethod
    def name(cls) -> str:
        return "patches"

    def schema(self) -> str:
        return "name string, patch string"

    def writer(self, schema: StructType, overwrite: bool) -> PatchWriter:
        if "path" not in self.options:
            raise ValueError("patches need the option path")
        return PatchWriter(self.options["path"], overwrite)


def write_patches(spark: SparkSession, patches: DataFrame, folder: str, mode: str = "append") -> None:
    """Writes the patches of rows (device, stamp, patch) that have one, as <device>_<stamp>.patch with other characters as underscores."""
    spark.dataSource.register(PatchSource)
    own = patches.where(diagnosis.has_patch(F.col("patch"))).select(diagnosis.patch_name(F.col("device"), F.col("stamp")).alias("name"), "patch")
    own.write.format("patches").option("path", folder).mode(mode).save()
