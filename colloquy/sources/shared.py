"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which goes when the application ends; under a local folder where that is unset on a single machine."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="colloquy-")
        atexit.register(shutil.rmtree, top, ignore_errors=True)
    own = spark._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    store = own.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(own)
    store.deleteOnExit(own)
    return f"{own.toString()}/{name}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: computed once however often it is used, and safe from lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
