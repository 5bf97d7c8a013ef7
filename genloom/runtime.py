"""Session helpers: shared storage for intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast, and bytes of its files; a larger side is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 24 << 20


_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


class _Made(threading.local):
    """Paths of the tables made inside each open scratch block of a thread."""

    def __init__(self):
        self.blocks: list[list[str]] = []


_made = _Made()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of a session whose environment wouldn't find it; once a session."""
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if str(_ROOT) in map(os.path.realpath, filter(None, known)) or spark.sparkContext.applicationId in _shipped:
        return
    _shipped.add(spark.sparkContext.applicationId)
    name = Path(tempfile.mkdtemp(prefix="genloom-package-")) / "genloom.zip"
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((_ROOT / "genloom").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset in local mode a local one."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: intermediate tables need a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="genloom-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/genloom/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    for block in _made.blocks[-1:]:
        block.append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._genloom_path = path
    return out


class scratch:
    """Deletes the tables that materialize() makes inside a with block when it ends, all but those given to keep()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, set()

    def keep(self, *frames: DataFrame) -> None:
        self.kept.update(f._genloom_path for f in frames)

    def __enter__(self):
        _made.blocks.append([])
        return self

    def __exit__(self, *_):
        made = _made.blocks.pop()
        for path in made:
            if path not in self.kept:
                _delete(self.spark, path)
        for outer in _made.blocks[-1:]:
            outer.extend(p for p in made if p in self.kept)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Deletes the table behind a frame that materialize() gave and nothing reads any more."""
    path = getattr(df, "_genloom_path", None)
    if path:
        _delete(df.sparkSession, path)


def cleanup(spark: SparkSession) -> None:
    """Deletes all intermediate tables of the shared folder; frames that read them are of no use afterwards."""
    _delete(spark, f"{shared_dir(spark)}/genloom")


#: Bytes of an Arrow batch, for a running task holds several, on both sides of the pipe and outside the heap.
BATCH, _BATCH_KEY = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH bytes where the session leaves Spark's default; it is read when a query runs."""
    if spark.conf.get(_BATCH_KEY) in ("67108864b", "64MB", "64m"):
        spark.conf.set(_BATCH_KEY, BATCH)


def released(function):
    """A function on batches that hands freed memory back to the system after each: Python workers live on."""

    @functools.wraps(function)
    def part(batches):
        for out in function(batches):
            yield out
            del out
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return part


def shuffled(df: DataFrame) -> DataFrame:
    """Marks a side of a join that is not to be broadcast: Spark would judge it by its files' bytes, and sorted or repeated
    keys of millions of rows fit below its bound when they are compressed."""
    return df.hint("merge")


#: Bytes of the input's files that a partition of dealt() stands for.
PIECE = 2 << 20


def pieces(*frames: DataFrame) -> int:
    """Into how many partitions rows of these frames are dealt so that a task's share doesn't grow with what they read: one
    for each PIECE of its files. 0 where that is less than two, or Spark doesn't know the size."""
    size = 0
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        size += sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(size // PIECE, frames[0].sparkSession.sparkContext.defaultParallelism) if 2 * PIECE <= size < 1 << 60 else 0


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df by keys in n partitions, which AQE doesn't merge into few large ones; as it is where n is 0."""
    return df.repartition(n, *keys) if n else df


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a materialized df for broadcast if it has at most so many rows, in files of at most so many bytes; otherwise
    leaves the join to a shuffle."""
    on_disk = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if on_disk <= size and df.count() <= rows else df
