"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts name it: space, tab, line feed, vertical tab, form feed, carriage return.
WS_PATTERN = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_local_root: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only in local mode with none set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="ledgerkit-"))
    return f"file://{_local_root[0]}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there and lost executors don't matter."""
    path = f"{scratch_root(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._ledgerkit_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote for frames that no later plan reads."""
    for df in frames:
        path = getattr(df, "_ledgerkit_path", None)
        if path:
            remove(df.sparkSession, path)


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names near ``bases`` that ``df`` doesn't have (Spark compares names without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name = base
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def keyed(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` with a key that is unique and never null.

    The key is ``id_col`` itself when no id is null or repeated. Else every row gets a number, and the
    numbered rows are written out so that later scans agree on them.
    """
    (key,) = fresh(docs, "row_key")
    odd = docs.groupBy(id_col).count().filter((F.col("count") > 1) | F.col(id_col).isNull()).limit(1).count()
    if not odd:
        return docs.withColumn(key, F.col(id_col).cast("long")), key
    return materialise(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


#: Keys of eight bytes that may be broadcast: 16 MB.
BROADCAST_KEYS = 2_000_000
#: Narrow rows, of a hundred bytes at most, that may be broadcast.
BROADCAST_ROWS = 400_000


def sized_join(df: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join on one long key. The keys are written out and counted: few are broadcast, more are shuffled."""
    keys = materialise(keys.select(key), "keys")
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, key, how)


def limited(keys: DataFrame) -> DataFrame:
    """``keys``, narrow rows that are written out, to be broadcast when they are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


#: Rows of an Arrow batch that are Python objects at a time.
SLICE_ROWS = 500


def slices(batches):
    """The record batches in short slices, so that a task never holds a whole batch as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)
