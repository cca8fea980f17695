"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffles_freed, small_batches  # noqa: F401

#: What may be broadcast: rows of up to two long columns, about 64 MB in the JVM; and data, whatever its rows.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20

_temporary: dict[str, str] = {}

#: White space of the rule `[^\x20\x09-\x0D]+` for words.
SPACE = r"[\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder the cluster names."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    with shuffles_freed(df.sparkSession):
        return df.checkpoint()


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cut lineage with a table in the shared folder; the shuffles that made it go at once."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: the one that spark.checkpoint.dir names.

    On a single machine, in local mode, a temporary folder stands for it; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if not named and app not in _temporary:
        _temporary[app] = tempfile.mkdtemp(prefix="shared-")
    return named or _temporary[app]


def dropped(spark: SparkSession, folder: str) -> None:
    """Remove a folder of intermediate data, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows and BROADCAST_BYTES of data; else
    as it is, so that Spark shuffles both sides.  `df` is read twice: it should be cut or cheap."""
    wide = [F.octet_length(F.col(f"`{c}`").cast("string")) for c, kind in df.dtypes if kind in ("string", "binary") or kind.startswith(("array", "struct", "map"))]
    size = F.count("*") * 8 * len(df.columns)
    for w in wide:
        size = size + F.coalesce(F.sum(w), F.lit(0))
    n, held = df.limit(rows + 1).agg(F.count("*"), size).first()
    return F.broadcast(df) if n <= rows and held <= BROADCAST_BYTES else df


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(c, UPPER, LOWER)


def space_words(c: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a string column; null and blank texts have none."""
    parts = F.split(F.coalesce(c, F.lit("")), SPACE)
    return F.filter(parts, lambda w: w != "")


def give_back() -> None:
    """Return what a Python worker has freed to the system: a worker that waits for its next task,
    or stands beside the one of the next stage, else keeps it.  Nothing where the C library has no such call."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def frugal(run):
    """A function of batches for `mapInArrow` that gives back its memory when a task ends."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped
