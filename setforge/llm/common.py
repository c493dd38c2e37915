"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space and the control characters tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = tempfile.mkdtemp(prefix="setforge-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{where}")
    return f"file://{where}"


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/setforge/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there, and it is computed once.

    tidy: have Spark's cleaner drop the shuffle files behind it, now that nothing needs them; worth it where they are large.
    """
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.setforge_path = path
    if tidy:
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``cut`` that no later plan reads."""
    spark, path = df.sparkSession, df.setforge_path
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def crc_bucket(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string")) % n


def plain_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra columns of the input, whatever their names, go no further."""
    return df.select(*[F.col(f"`{n}`") for n in names])
