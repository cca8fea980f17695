"""Sessions, and this package's way to the executors."""

from __future__ import annotations

import re
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    b = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once per application, so that functions that run
    in Python workers find it however the application was started."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        if root.is_dir():
            archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{root.name}", "zip", root.parent, root.name)
            spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the one that spark.checkpoint.dir names; in local
    mode without one, a temporary folder.  A cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="shared-")


def settled(df: DataFrame) -> DataFrame:
    """`df` computed once, by a checkpoint in the shared folder.  For what a plan reads several times."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries inside leave no shuffle files once they end; the caller's setting comes back.

    For results that are written whole and read from there."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def small_batches(df: DataFrame, size: int = 4 << 20) -> DataFrame:
    """`df`, in a session whose Arrow batches have about `size` bytes at most: at the default of 64
    MB the buffers on both sides of a Python worker hold a large part of an executor's memory.

    Spark reads this setting when a query runs, which is after this returns; so it stays, and the
    session's later queries have it too.  A smaller setting of the caller's is kept.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    held = re.fullmatch(r"(-?\d+)b?", conf.get(name))
    if not held or not 0 < int(held[1]) <= size:
        conf.set(name, str(size))
    return df
