"""Session settings, checkpoints, and the size check that every broadcast goes through."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DatetimeType, NumericType


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lociframe")
        .config("spark.driver.memory", os.environ.get("LOCIFRAME_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder of ``spark.checkpoint.dir``.

    A folder of our own is set only where the session names none and the master is local; elsewhere a
    session without a shared folder is an error, as executors could not read each other's files.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", "")
        if not shared:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a shared folder")
            shared = tempfile.mkdtemp(prefix="lociframe-ckpt-")
        context.setCheckpointDir(shared)
    return df.checkpoint()


def is_small(df: DataFrame, max_rows: int = 50_000, max_bytes: int = 32 << 20) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes: text by its length, numbers as 8, nested columns
    written as JSON.

    Reading ends after ``max_rows + 1`` rows. The upstream of ``df`` runs for it, so frames that are costly
    to make should be cut first.
    """
    size = F.lit(0)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        size = size + (F.lit(8) if isinstance(f.dataType, (NumericType, BooleanType, DatetimeType)) else F.coalesce(F.octet_length(c if kind in ("string", "binary") else F.to_json(F.struct(c))), F.lit(0)))
    rows, total = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(size)).first()
    return rows <= max_rows and (total or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = 50_000, max_bytes: int = 32 << 20) -> DataFrame:
    """``df`` with a broadcast hint if :func:`is_small` proves its size.

    Beyond the bound the frame comes back without a hint, so the join shuffles and AQE splits skewed
    partitions.
    """
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores: a frame that only scans, with fewer partitions than there are cores, is dealt out anew, as
    small files may not be split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
