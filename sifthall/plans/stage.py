"""Cutting lineage in a place that all executors share, and sizing data before it is broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset, a temporary folder of this session on one machine (tests); on a
    cluster it must be set, since no folder of one machine serves all executors."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="sifthall-")
    return _LOCAL[app]


def _own_root(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/sifthall/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{_own_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete what this application staged. Results that were not written elsewhere can't be read after it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back.

    The written files survive the loss of any executor, so that later stages never recompute what led to them.
    ``release``: the shuffle files are deleted once ``df`` is written, so that rounds need the disk of one round.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    if release:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if release:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is (a shuffle join follows).

    The check reads no more than ``max_rows + 1`` rows.
    """
    seen = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return F.broadcast(df) if seen <= max_rows else df
