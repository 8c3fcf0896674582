"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where none is named, in local mode, a folder of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    own = tempfile.mkdtemp(prefix="netframe-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    named = f"file://{own}"
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/netframe-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.nf_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that materialize has made, once nothing that is still to run reads them.

    Where the driver's JVM is out of reach they stay, as they do when a run is cut short.
    """
    for table in tables:
        path, jvm = vars(table).get("nf_path"), getattr(table.sparkSession, "_jvm", None)
        if path and jvm is not None:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
