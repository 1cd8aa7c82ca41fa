"""Sessions, and this package on the executors."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", os.environ.get("HELIOGRAPH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once per application, wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    place = Path(tempfile.mkdtemp(prefix="heliograph-ship-"))
    shutil.copytree(root, place / "src" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(place / root.name), "zip", place / "src"))


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches to 8 MB, unless a size was chosen: rows are whole texts, and a batch is in memory several times."""
    if spark.conf.get(BATCH, None) == "67108864b":
        spark.conf.set(BATCH, "8m")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset on one machine, one of our own."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not place:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="heliograph-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(place)
    return place.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """A table of the size of the queries' results, computed once: plans that use it often would compute it as often."""
    if df.isStreaming:
        return df
    shared_folder(df.sparkSession)
    return df.checkpoint()


SPREAD_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table's rows over all cores (a small file is one row group, so one task); larger ones come in enough parts.

    The optimizer's estimate decides, so nothing is read for it; results don't depend on it.
    """
    if df.isStreaming:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SPREAD_BYTES else df


def shipped(query):
    """The same query, with the package shipped before it is planned."""

    @functools.wraps(query)
    def run(spark, *args):
        ship(spark)
        small_batches(spark)
        return query(spark, *args)

    return run
