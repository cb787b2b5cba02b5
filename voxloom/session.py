"""Session helpers: local sessions for tests, cuts of lineage that survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("voxloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the one all executors share, spark.checkpoint.dir; it goes when the application ends.

    Where that is unset, a local session (tests) gets a folder of its own; a cluster has none that all machines see, so it raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        own = f"{folder.rstrip('/')}/voxloom-{spark.sparkContext.applicationId}"
        if getattr(spark, "_voxloom_folder", None) != own:
            spark._voxloom_folder = own
            where = spark._jvm.org.apache.hadoop.fs.Path(own)
            system = where.getFileSystem(spark._jsc.hadoopConfiguration())
            system.mkdirs(where)
            system.deleteOnExit(where)
        return own
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set; it must name a folder that all executors share")
    if not folder:
        folder = getattr(spark, "_voxloom_folder", None)
        if not folder:
            own = tempfile.mkdtemp(prefix="voxloom-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            folder = spark._voxloom_folder = "file://" + own
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: computed once, lineage cut, safe against lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._voxloom_path = path
    return read


def discarded(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_voxloom_path", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def shipped(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each context, so that they need no copy of their own."""
    context = spark.sparkContext
    if not getattr(context, "_voxloom_shipped", False):
        context._voxloom_shipped = True
        own = tempfile.mkdtemp(prefix="voxloom-package-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        package = Path(__file__).resolve().parent
        context.addPyFile(shutil.make_archive(f"{own}/voxloom", "zip", package.parent, package.name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
