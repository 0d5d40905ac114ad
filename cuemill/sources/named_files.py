"""A sink that gives each row a file of its own name: a Spark data source with a writer in Python.

    contents.write.format("named_files").mode("append").save(path)      # file_name string, content string

A task writes into a folder of its own attempt, beside the others and out of sight; when all tasks are done, the files go to their names, each by one rename.
If the job fails, or a task is tried again, what was half written is never seen under a name.
"""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.shipping import ship_package

#: Files that the driver renames at a time.
RENAMES = 16


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI that driver and executors share, and the path there."""
    store, root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))
    return store, root.rstrip("/")


@dataclass
class _Attempt(WriterCommitMessage):
    folder: str


class _NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.staging = path, f"_staging-{uuid.uuid4().hex}"

    def write(self, rows) -> _Attempt:
        store, root = _store(self.path)
        folder, seen = f"{root}/{self.staging}/{TaskContext.get().taskAttemptId()}", set()
        store.create_dir(folder)
        for row in rows:
            name = row["file_name"]
            if not name or "/" in name or name in (".", "..") or name in seen:
                raise ValueError(f"not the name of one file: {name!r}")
            seen.add(name)
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write((row["content"] or "").encode())
        return _Attempt(folder)

    def commit(self, messages) -> None:
        store, root = _store(self.path)
        with ThreadPoolExecutor(RENAMES) as pool:
            for done in filter(None, messages):
                list(pool.map(lambda f: store.move(f.path, f"{root}/{f.base_name}"), store.get_file_info(fs.FileSelector(done.folder))))
        store.delete_dir(f"{root}/{self.staging}")

    def abort(self, messages) -> None:
        store, root = _store(self.path)
        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "file_name string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("files are added or replaced one by one: mode append")
        return _NamedFilesWriter(self.options["path"])


def write_named_files(contents: DataFrame, path: str) -> None:
    """A file of its name in the folder ``path`` for each row of ``contents`` (file_name, content), replacing one that is there.

    Names are those of one file each: the job fails, and nothing is changed, if one comes twice, is empty or leads elsewhere.
    """
    spark = contents.sparkSession
    ship_package(spark)
    spark.dataSource.register(NamedFiles)
    store, root = _store(path)
    store.create_dir(root)
    contents.select("file_name", "content").repartition("file_name").write.format("named_files").mode("append").save(path)


def read_named_files(spark: SparkSession, path: str) -> DataFrame:
    """file_name, content of the files of a folder, whole; names that begin with a dot or an underscore are out of sight."""
    name = F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))  # Spark gives it as a part of a URI
    return spark.read.text(path, wholetext=True).select(name.alias("file_name"), F.col("value").alias("content"))
