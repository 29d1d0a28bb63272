"""Durable intermediates: Parquet tables in the folder that ``spark.checkpoint.dir`` names.

The folder is shared by the driver and all executors of a cluster, so a lost executor never loses a table.
Where the session names none (tests), a folder of the local temp directory is set once.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its measured size is below this; else the join is shuffled.
BROADCAST_BYTES = 32 << 20

_tables: list[tuple[SparkSession, str]] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for durable intermediates; sets a local one only where the session has none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"file://{os.path.join(tempfile.gettempdir(), f'quillspark-{os.getuid()}')}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _sweep() -> None:
    for spark, path in _tables:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone; the folder is temporary anyway
            pass


atexit.register(_sweep)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder; it goes when the program ends."""
    path = f"{checkpoint_root(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    _tables.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the checkpoint folder and return a scan of it (lineage is cut).

    zstd: smaller than the default codec, and without the direct buffers that its writers keep until a collection.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a durable table is within the broadcast bound: counted rows times a stated row size, or the sum of a
    size that is measured in each row."""
    if isinstance(row_bytes, int):
        return df.count() * row_bytes <= limit
    return (df.agg(F.sum(row_bytes).alias("n")).first()["n"] or 0) <= limit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
