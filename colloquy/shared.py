"""Tables that cut the lineage of iterative operators, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_local: list[str] = []


def _folder(df: DataFrame) -> str:
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:  # one machine, as in tests
        _local.append("file://" + tempfile.mkdtemp(prefix="colloquy-"))
    return _local[0]


class Stages:
    """The staged tables of one operator; all but those kept are deleted when they are done with."""

    def __init__(self):
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """Write the table and read it again: a lost executor then costs a read, not the work."""
        path = f"{_folder(df)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if found := self.paths.pop(id(t), None):
                spark = t.sparkSession
                p = spark._jvm.org.apache.hadoop.fs.Path(found[1])
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
