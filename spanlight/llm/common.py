"""What the operators share: tables, the folder all machines see, and Arrow batches.

Every operator names its columns by parameter and selects only those before it renames them, so
extra columns, clashing names among them, never reach it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; at about 3 kB a text this is a few MB. Long texts raise a batch's size, not their number.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own in local mode, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it from there: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder's path inside the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


#: Rows of ids up to which a filter by ids sends them to all machines; beyond, both sides are shuffled.
BROADCAST_IDS = 500_000


def by_ids(df: DataFrame, ids: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """df filtered by a table of ids, which is counted first; df is not shuffled as long as there are few."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that scratch() named, by way of Hadoop's file systems."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Python workers hold one batch at a time: keeps it to some MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn over each Arrow batch. Arrow, not pandas: nullable integers stay integers."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def utf8(column: str | Column) -> Column:
    """A text's UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def id_crc32(column: str = "doc_id") -> Column:
    """crc32 of the id as text, the key of all train and held-out splits."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def local_path(uri: str) -> str:
    """A file: URI as a path of the mounted shared folder; other schemes stay."""
    return "/" + uri.split(":", 1)[1].lstrip("/") if uri.startswith("file:") else uri


def file_system(uri: str):
    """pyarrow's file system for a URI, and the path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(local_path(uri))}")


def schema_ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)
