"""Tables between jobs, joins whose broadcast is checked by size, and workers that can import this package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table is broadcast only if its rows take at most so many bytes.
BROADCAST_BYTES = 64 << 20
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A session on one machine that names none gets a fresh one; on a
    cluster that is an error, as executors don't see each other's folders."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
    return context.getCheckpointDir()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that no later job reads."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.staged_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def _width(column: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.StringType, T.BinaryType)):
            return F.coalesce(F.aggregate(column, F.lit(24), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0)) + 16), F.lit(24))
        return F.greatest(F.size(column), F.lit(0)) * (8 * max(1, len(inner) if isinstance(inner, T.StructType) else 1)) + 24
    if isinstance(kind, T.StructType):
        return sum((_width(column[f.name], f.dataType) for f in kind), F.lit(8))
    return F.lit(8)


def size_of(df: DataFrame) -> int:
    """About the bytes that the rows of df take in memory."""
    row = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16))
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcasts small if its rows take at most `most` bytes, and shuffles both sides otherwise. small: a staged or otherwise cheap table."""
    return df.join(F.broadcast(small) if size_of(small) <= most else small, on, how)


def join_hot(df: DataFrame, side: DataFrame, on: str, n: str, how: str = "inner", keys: int = 2000) -> DataFrame:
    """df joined with side, which has a row for each value of `on` and, in `n`, how many rows of df hold it. Both are staged. Values that
    hold more than 1 / keys of all rows are at most `keys`; they go by broadcast, so that no task gets all rows of one. The
    others are shuffled. how: inner or left."""
    total = side.agg(F.sum(n)).first()[0] or 0
    most = max(1000, total // keys)
    hot, rest = side.where(F.col(n) > most), side.where(F.coalesce(F.col(n), F.lit(0)) <= most)
    hot = F.broadcast(hot)
    return df.join(hot, on, "inner").unionByName(df.join(F.broadcast(hot.select(on)), on, "left_anti").join(rest, on, how))


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the session, which may run where nobody has installed it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package, folder = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="spark-package-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/{package.name}.zip", "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context.addPyFile(f"{folder}/{package.name}.zip")
    _shipped.add(context.applicationId)
