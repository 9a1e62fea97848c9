"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="trackframe-checkpoint-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


#: Held while a table is written: small batches bound what the scan, a Python worker and the buffers between them hold, and
#: shuffle files go as soon as the write that needed them has ended.
SMALL_BATCHES = {
    "spark.sql.parquet.columnarReaderBatchSize": "512",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}
WHILE_WRITING = SMALL_BATCHES | {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside, and are put back after."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def configure(spark: SparkSession) -> None:
    """Small batches from now on, for results that are computed as the caller reads them."""
    for k, v in SMALL_BATCHES.items():
        spark.conf.set(k, v)


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, drop: Iterable[DataFrame] = ()) -> DataFrame:
    """Write df to the shared folder and read it back: a lineage cut that survives lost executors.

    drop: tables of earlier cuts that only df needed; they are deleted. What the result of an operator still reads stays.
    """
    spark = df.sparkSession
    path = fresh(spark, name)
    with settings(spark, WHILE_WRITING):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    discard(*drop)
    return out


def _hadoop(spark: SparkSession, path: str) -> tuple[object, object]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Deletes tables that cut() has written."""
    for t in tables:
        path, files = _hadoop(t.sparkSession, t.cut_path)
        files.delete(path, True)


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small file with a text, written by the driver wherever Spark can write."""
    where, files = _hadoop(spark, path)
    out = files.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()
