"""What the corpus operators share: shared-folder tables, Arrow batches, hashing rules."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship_package

#: Rows of a table in one Arrow batch; texts are long, so batches are kept short.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """The package on the executors, and short Arrow batches, by rows and (where Spark can) by bytes: memory of a Python worker stays bounded."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns, under fixed names: other columns, whatever their names, can't clash. Null text: empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def id_hash(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a folder of our own only where it is unset and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cuemill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave, once nothing will be read from them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@cache
def lean_worker() -> None:
    """In a Python worker, once: what batches and large arrays free goes back to the system at once, instead of staying with the worker."""
    pa.set_memory_pool(pa.system_memory_pool())
    limit = getattr(ctypes.CDLL(None), "mallopt", None)
    if limit:
        limit(-3, 1 << 20)  # M_MMAP_THRESHOLD: arrays from 1 MB on are mapped, and unmapped when freed
        limit(-1, 1 << 20)  # M_TRIM_THRESHOLD: free memory at the end of the heap beyond 1 MB goes back


def map_texts(docs: DataFrame, schema: str, make: Callable[[], Callable[[list, list[bytes]], list]], names: list[str] | None = None) -> DataFrame:
    """Runs a function over Arrow batches of (doc_id, text).

    ``make()`` is called once a task and returns a function of (ids, texts as UTF-8 bytes)
    that returns the result's columns, in the order of ``schema``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(list(x), t) for x, t in zip(work(ids, texts), types)], names=fields)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    types, fields = [f.type for f in arrow], [f.name for f in arrow]
    return docs.mapInArrow(run, schema)
