"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: Where tables go if spark.checkpoint.dir is unset and the master is local.
LOCAL_SCRATCH = "/tmp/chartmill-scratch"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only a local master, whose executor is the driver, may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = LOCAL_SCRATCH
    return f"{found}/{spark.sparkContext.applicationId}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that written() made and release() has not removed, oldest first.
_made: list[str] = []


def made_so_far() -> list[str]:
    return list(_made)


def release(spark: SparkSession, paths: list[str], reader: DataFrame | None) -> None:
    """Removes those tables of written() that `reader` doesn't read, and lets Spark remove the shuffle files of finished
    steps, which it does as the driver collects its garbage. The caller vouches that nothing else reads the tables."""
    read = " ".join(reader.inputFiles()) if reader is not None and paths else ""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        if path in _made and path.rsplit("/", 1)[1] not in read:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
            _made.remove(path)
    for _ in range(2 if paths else 0):  # the first lets go of plans, the second of the shuffles that these held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Steps that run inside hand `rows` texts at once to Python instead of Spark's ten thousand, which can be hundreds of MB."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def delete_written(spark: SparkSession) -> None:
    """Removes every table that written() made in this application."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _made.clear()


def unit_hash(*cols: Column | str, seed: int = 0) -> Column:
    """A number in (0, 1) fixed by the columns' text: 52 bits of MD5, which other SQL engines compute alike."""
    text = F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("\x00")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(2**52))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def small_side(df: DataFrame, is_small: bool) -> DataFrame:
    """df with a broadcast hint where the caller has counted its rows; else the plain side of a join that AQE may split."""
    return F.broadcast(df) if is_small else df
