"""The folder that all executors share, and tables written to it."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    path = os.path.join(sc._temp_dir, f"{os.path.basename(_PACKAGE)}-{uuid.uuid4().hex[:8]}.zip")  # the driver serves it from here
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(_PACKAGE):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(whole := os.path.join(folder, f), os.path.relpath(whole, os.path.dirname(_PACKAGE)))
    sc.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset one is made, but only for a master whose executors are threads of the driver."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        at = sc._jsc.sc().getCheckpointDir()
        if at.isDefined():
            return at.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="parley-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/parley/{name}-{uuid.uuid4().hex}"


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read again, and its path there."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage is cut, and the loss of an executor costs nothing."""
    return stored_at(df, name)[0]


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
