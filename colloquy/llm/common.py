"""What the training-data operators share: the shared folder, staged tables, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach: ``spark.checkpoint.dir``.

    A session on one machine (``local[...]``, as in tests) that names none gets a temporary
    folder; on a cluster a missing setting is an error, for parts left on machines of their
    own would read back incomplete.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="colloquy-"))
    return _fallback[0]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it again.

    A lost executor then costs a re-read, not the work behind it.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._colloquy_path = path
    return out


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm, sc = spark._jvm, spark.sparkContext
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def drop_stage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    if path := getattr(df, "_colloquy_path", None):
        drop_folder(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
