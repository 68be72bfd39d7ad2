"""Session helpers shared by the library, the tests and the benchmark."""

from __future__ import annotations

import atexit
import functools
import gc
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "textloom", shuffle: int = 8) -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE on)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its scan has fewer splits than there are cores.

    A small file of one row group is one task otherwise, however dear what follows is. A table
    with splits enough, as any large one, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


@functools.cache
def _own_folder() -> str:
    """One folder of this process, gone when it ends."""
    at = tempfile.mkdtemp(prefix="textloom-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a session on one machine may go without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[[^,]*\]|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark knows."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the shared folder.

    Spark deletes a checkpoint that nothing refers to any more where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set. The size that Catalyst guessed
    for the old plan is not carried on: in a loop of joins it would grow without bound.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    held = df.checkpoint(eager=True)._jdf
    fresh = df.sparkSession._jsparkSession.internalCreateDataFrame(held.queryExecution().toRdd(), held.schema(), False)
    return DataFrame(fresh, df.sparkSession)


def sweep(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files and checkpoints that nothing refers to any more.

    Spark's cleaner only learns of them when the driver collects its garbage, which a driver
    with little to do puts off while the executors' disks fill up in a loop of shuffles.
    """
    gc.collect()
    spark._jvm.System.gc()
