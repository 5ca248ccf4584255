"""Session and scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "hemline", **conf: str) -> SparkSession:
    """The running session, or a new one with adaptive execution and UTC."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once, as ``--py-files`` would, unless their path has it already."""
    package = os.path.dirname(os.path.abspath(__file__))
    root, context = os.path.dirname(package), spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_hemline", False):
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="hemline-"))
    context.addPyFile(shutil.make_archive(f"{folder}/hemline", "zip", root, os.path.basename(package)))
    context._hemline = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in a folder that driver and executors share, removed when the session's process ends.

    The folder is ``spark.checkpoint.dir``; where that is unset, the warehouse. Without either this raises, since
    a machine's own folder is not seen by the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{base.rstrip('/')}/hemline-scratch/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)
    return path


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet, in the shared folder if not to ``path``, and read it back.

    Cuts lineage without relying on executor storage: a lost executor costs
    nothing, and every reader prunes to the columns it needs.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
