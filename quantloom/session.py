"""Session helpers: the shared folder, staged tables, size-checked broadcasts and distributed ranks.

Lineage is cut by writing a table into the folder that all executors share, never by a
local checkpoint: a lost executor then costs a re-read, not the job.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side may be broadcast up to this many estimated bytes.
BROADCAST_BYTES = 16 << 20
_STAGED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on a local master a temporary one is set if it is unset."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="quantloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(path)
    return path


def staging_path(spark: SparkSession) -> str:
    """The folder of this application's staged tables; what lies in it at the program's end is deleted then, if the session still runs."""
    path = f"{shared_dir(spark)}/quantloom/{spark.sparkContext.applicationId}"
    if path not in _STAGED:
        _STAGED.add(path)
        atexit.register(_release_at_exit, spark)
    return path


def _release_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            release(spark)


def stage(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it (column pruning and pushdown still apply).

    With columns ``by``, its last ones, a filter on them reads its own files only.
    """
    spark = df.sparkSession
    path = f"{staging_path(spark)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables this application staged; call it when results that read them are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(staging_path(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint only where the counted rows prove the side small; otherwise the join shuffles."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def join_hot(left: DataFrame, right: DataFrame, key: str, spread: str, share: float = 1 / 1024, salts: int = 64) -> DataFrame:
    """``left`` joined to one row a key of ``right``, where a few keys may hold most rows of ``left``.

    Keys with ``share`` of the rows or more (so few that they are broadcast) are salted by a hash of the column ``spread``.
    """
    counts = stage(left.groupBy(key).agg(F.count("*").alias("_n")))
    least = (counts.agg(F.sum("_n")).first()[0] or 0) * share
    hot = F.broadcast(counts.filter((F.col("_n") >= least) & F.col(key).isNotNull()).select(key, F.lit(salts).alias("_salts")))  # 1 / share rows at most
    n = F.coalesce("_salts", F.lit(1))
    a = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), n).cast("int")).drop("_salts")
    b = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("_salts")
    return a.join(b, [key, "_salt"]).drop("_salt")


def distributed_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rank", partitions: int | None = None) -> DataFrame:
    """0-based position of each row within ``keys`` in the order of ``order``, without one task per key.

    Rows are range-partitioned by keys and order, numbered inside each range, and moved by the
    counts of the ranges before. A key that holds a third of the table is spread over many ranges.
    ``order`` has to be total for a deterministic result; rows that tie completely are interchangeable.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()))
    within = [*keys, "_range"]
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a key
    offsets = ranged.groupBy(*within).agg(F.count("*").alias("_n")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(within)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(within)]
    return local.join(offsets, same).select(*df.columns, (F.col("_local") + F.col("_offset")).cast("long").alias(out))
