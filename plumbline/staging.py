"""Tables between the rounds of iterative operators: written to the shared folder, so lineage is cut and survives losses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: str | None = None
#: exchanges of a written table are of no use once it is written; else they stay until the driver collects garbage
EXCHANGES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where it is unset and one machine does all."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _own = _own or tempfile.mkdtemp(prefix="plumbline-")
    return _own


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing lies at."""
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = fresh(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(EXCHANGES)
    conf.set(EXCHANGES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(EXCHANGES, before)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held._staged_at = path
    return held


def staged_with_sum(df: DataFrame, name: str, value: Column) -> tuple[DataFrame, float]:
    """The staged table, and the sum of ``value`` over its rows, which the same job gathers."""
    seen = Observation()
    held = staged(df.observe(seen, F.sum(value).alias("total")), name)
    return held, float(seen.get["total"] or 0.0)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*held: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; other tables are left alone."""
    for df in held:
        if path := df.__dict__.get("_staged_at"):
            remove(df.sparkSession, path)
