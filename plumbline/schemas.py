"""Schemas of the measurement store and of the tables around it."""

from pyspark.sql import SparkSession
from pyspark.sql import types as T

_f = T.StructField
MEASUREMENT = T.StructType(
    [
        _f("image_id", T.LongType()),
        _f("point2D_idx", T.IntegerType()),
        _f("modes", T.ArrayType(T.FloatType())),
        _f("weights", T.ArrayType(T.FloatType())),
        _f("estimated_depth", T.DoubleType()),
        _f("sigmas", T.ArrayType(T.FloatType())),
        _f("confidence", T.DoubleType()),
        _f("is_sky", T.BooleanType()),
        _f("sensor", T.StringType()),
    ]
)
SENSOR_META = T.StructType(
    [
        _f("num_modes", T.IntegerType()),
        _f("method", T.StringType()),
        _f("method_params", T.StringType()),
        _f("sigma_space", T.StringType()),
        _f("has_confidence", T.BooleanType()),
        _f("dump_dir", T.StringType()),
        _f("dump_hash", T.StringType()),
        _f("created_at", T.TimestampType()),
        _f("sensor", T.StringType()),
    ]
)
BUNDLE = T.StructType(
    [
        _f("stem", T.StringType()),
        _f("h", T.IntegerType()),
        _f("w", T.IntegerType()),
        _f("k", T.IntegerType()),
        _f("estimated_depth", T.ArrayType(T.FloatType())),
        _f("means", T.ArrayType(T.FloatType())),
        _f("weights", T.ArrayType(T.FloatType())),
        _f("sigmas", T.ArrayType(T.FloatType())),
        _f("confidence", T.ArrayType(T.FloatType())),
        _f("sky_mask", T.ArrayType(T.BooleanType())),
    ]
)
KEYPOINT = T.StructType([_f("image_id", T.LongType()), _f("point2D_idx", T.IntegerType()), *(_f(c, T.FloatType()) for c in ("x", "y", "a11", "a12", "a21", "a22"))])
TABLES = {"measurements": (MEASUREMENT, "sensor"), "sensor_meta": (SENSOR_META, None), "bundles": (BUNDLE, None), "keypoints": (KEYPOINT, None)}


def create_tables(spark: SparkSession, folder: str, database: str = "default") -> None:
    """The package's tables in the catalogue, with their files under ``folder``; those that exist stay as they are."""
    for name, (schema, by) in TABLES.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        parts = f" PARTITIONED BY (`{by}`)" if by else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet{parts} LOCATION '{folder.rstrip('/')}/{name}'")
