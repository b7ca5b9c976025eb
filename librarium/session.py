"""Session helpers shared by the operators."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("librarium")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LIBRARIUM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A folder that all executors see, below the one the session names in spark.checkpoint.dir.

    Only a local session, whose executors are the driver itself, may do without: it gets a folder of its own. On a
    cluster a machine-local folder would lose what other machines wrote, so there the setting is asked for.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/{purpose}-{spark.sparkContext.applicationId}"
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"librarium-{purpose}-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the one the session names in spark.checkpoint.dir (shared by all executors). Where a checkpoint is no
    longer referred to, Spark removes its files if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: unless PYTHONPATH already leads to it, send it to them once per context."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if getattr(sc, "_librarium_shipped", False) or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = shared_folder(spark, "package").removeprefix("file://")
    if "://" in folder:  # the archive is written by the driver and served by it, as files of --py-files are
        folder = tempfile.mkdtemp(prefix="librarium-")
    os.makedirs(folder, exist_ok=True)
    archive = os.path.join(folder, "librarium.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(os.path.dirname(os.path.abspath(__file__))):
            for f in files:
                if f.endswith((".py", ".json")):
                    path = os.path.join(at, f)
                    z.write(path, os.path.relpath(path, root))
    sc.addPyFile(archive)
    sc._librarium_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Planner's size of a scan up to which it may be spread by a shuffle.
FAN_OUT = 256 << 20


def fan_out(df: DataFrame, *, least: int | None = None) -> DataFrame:
    """Spread a small scan that has fewer partitions than the cluster has cores; all others stay as they are.

    Small files arrive as one split each (a row group cannot be cut), so Python stages behind them would leave cores
    idle. Only a scan of at most FAN_OUT bytes travels, whatever the size of the cluster: larger ones are cut by
    spark.sql.files.maxPartitionBytes and are never shuffled for this.
    """
    spark = df.sparkSession
    want = least or spark.sparkContext.defaultParallelism
    if approx_bytes(df) > FAN_OUT or df._jdf.queryExecution().toRdd().getNumPartitions() >= want:
        return df
    return df.repartition(want)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, for a Python stage that costs far more than its rows are large.

    After a shuffle adaptive execution joins small partitions by their bytes; a heavy stage would then run in a few tasks.
    """
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def approx_bytes(df: DataFrame) -> int:
    """The optimizer's size of a frame in bytes; used only to decide whether a side may be broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def maybe_broadcast(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """Hint a broadcast only when the planner's size of the side is below the limit, else leave a shuffle join."""
    return F.broadcast(df) if approx_bytes(df) <= limit else df
