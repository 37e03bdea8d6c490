"""Where intermediate results are kept, and joins whose small side is checked.

A lineage is cut by writing a table into the shared folder that the session
names in ``spark.checkpoint.dir``. Such a table survives the loss of executors.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: Most bytes a side may take to be sent to every executor.
BROADCAST_BYTES = 8 * 1024 * 1024


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The session's ``spark.checkpoint.dir`` if it has one. Where it is unset, a
    local session gets a temporary folder and a cluster a folder in its
    warehouse; either is set as the session's checkpoint folder. A warehouse on
    each machine's own disk is no shared folder: then this is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        path = tempfile.mkdtemp(prefix="gapline-")
    else:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        if path.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(path)
    return path


#: The tables that each application of this process has staged.
_staged: dict[str, list[str]] = {}


def clear_stages(spark: SparkSession) -> None:
    """Delete all tables that this application has staged here: once the results that rest on them are written."""
    jvm = spark.sparkContext._jvm
    for path in _staged.pop(spark.sparkContext.applicationId, []):
        there = jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def _clear_at_exit() -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None:
            clear_stages(spark)
    except Exception:  # noqa: BLE001 - the session may be gone: nothing is left to do
        pass


atexit.register(_clear_at_exit)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of what was written. Staged tables are deleted when the process ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/gapline/{name}-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], out: str) -> tuple[DataFrame, int]:
    """``df`` with ``out``, its rows' numbers from 0 in ``order``, and how many there are. Sorted in ranges, not in one task."""
    spark = df.sparkSession
    parts = materialize(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = {r["__p"]: r["n"] for r in parts.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()}
    at, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, at))
        at += sizes[p]
    first = spark.createDataFrame(offsets, "__p int, __first bigint")
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return parts.join(F.broadcast(first), "__p").withColumn(out, F.col("__first") + place - 1).drop("__p", "__first"), at  # one row a range


def measured_bytes(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df`` and about how many bytes they take in memory: texts and nested values as long as they are."""
    fixed, sizes = 16, []
    for c in df.columns:
        kind = df.schema[c].dataType
        if isinstance(kind, (StringType, BinaryType)):
            sizes.append(F.octet_length(c) + 16)
        elif isinstance(kind, (ArrayType, MapType, StructType)):
            sizes.append(F.octet_length(F.to_json(F.struct(c))) + 32)
        else:
            fixed += 8
    each = sum((F.coalesce(x, F.lit(16)).cast("bigint") for x in sizes), F.lit(fixed).cast("bigint"))
    n, total = df.agg(F.count(F.lit(1)), F.sum(each)).first()
    return n, total or 0


def join_bounded(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    salts: int = 16,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``big`` with ``small``, which has few rows a key.

    The rows of ``small`` and their bytes are counted. If they are within ``max_bytes``
    it is broadcast and ``big`` isn't shuffled. Otherwise ``small`` is repeated
    once a salt and ``big`` spread over the salts, so that no key of ``big``,
    however many rows it has, meets in one task. Rows with null keys match
    nothing, as in SQL. ``how`` is inner, left, left_semi or left_anti.
    """
    keys = list(keys)
    if measured_bytes(small)[1] <= max_bytes:
        return big.join(F.broadcast(small), keys, how)
    salt = "__salt"
    spread = big.withColumn(salt, F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*keys, salt], how).drop(salt)


def micros(column):
    """Microseconds since 1970 of a zone-free timestamp column."""
    return F.unix_micros(F.col(column).cast("timestamp"))
