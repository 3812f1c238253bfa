"""The measurement store: Parquet by sensor and version, and a manifest that names the version in force.

Rows are written to a folder of their own, checked there, and published by one entry in the manifest, which holds the meta
row and the folder together: a reader sees a sensor's old rows and meta, or its new ones, and never a mixture.  An entry is
one file that appears whole; of several of a sensor the latest holds.  A failed check, or a failure before the entry is
written, leaves what is published as it was.  The version before the last stays on disk for readers that have begun.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import schemas
from plumbline.operators import checks, sampling
from plumbline.functions.naming import stem
from plumbline.staging import remove

SIGMA_SPACES = ("log", "linear", "inverse")
#: a line of the manifest: the meta row, where its rows lie (null: the sensor was deleted) and its number
ENTRY = T.StructType([*schemas.SENSOR_META.fields, T.StructField("folder", T.StringType()), T.StructField("version", T.LongType())])


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _entries(self) -> DataFrame:
        """All entries of the manifest; none where nothing was ever published."""
        path, files = self._path("manifest")
        if not files.exists(path):
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(f"{self.root}/manifest")

    def _live(self) -> DataFrame:
        """The entry in force of each sensor that is not deleted."""
        latest = self._entries().groupBy("sensor").agg(F.max_by(F.struct("*"), F.struct("version", "folder")).alias("_e"))
        return latest.select("_e.*").filter("folder IS NOT NULL")

    def rows(self, sensor: str | None = None) -> DataFrame:
        live = self._live() if sensor is None else self._live().filter(F.col("sensor") == sensor)
        folders = [f"{self.root}/measurements/{r.folder}" for r in live.select("folder").collect()]  # a row a sensor
        if not folders:
            return self.spark.createDataFrame([], schemas.MEASUREMENT)
        return self.spark.read.schema(schemas.MEASUREMENT).parquet(*folders)

    def meta(self) -> DataFrame:
        return self._live().select(schemas.SENSOR_META.fieldNames())

    def sensors(self) -> DataFrame:
        return self.meta().select("sensor").orderBy("sensor")

    def sensor_meta(self, sensor: str):
        """The sensor's meta row; a KeyError that names the sensors there are."""
        found = self.meta().filter(F.col("sensor") == sensor).first()
        if found is None:
            raise KeyError(f"no sensor {sensor!r}; there are {[r.sensor for r in self.sensors().collect()]}")
        return found

    def count_rows(self, sensor: str) -> int:
        return self.rows(sensor).count()

    def for_image(self, image_id: int, sensor: str) -> DataFrame:
        """Measurements of one image; a row whose number of modes is not the sensor's is an error."""
        k = self.sensor_meta(sensor).num_modes
        bad = F.raise_error(F.lit(f"a row of {sensor} has not {k} modes")).cast("boolean")
        return self.rows(sensor).filter(F.col("image_id") == image_id).filter(F.when(F.size("modes") == k, F.lit(True)).otherwise(bad))

    def factors(self, sensor: str, depth_space: str) -> DataFrame:
        """The rows of a sensor for an adjustment in ``depth_space``; sigmas kept in another space are refused, not converted."""
        space = self.sensor_meta(sensor).sigma_space
        if space is not None and space != depth_space:
            raise NotImplementedError(f"the sigmas of {sensor!r} are in {space!r} space, the adjustment is in {depth_space!r}")
        return self.rows(sensor)

    def write(self, rows: DataFrame, meta: dict, *, force: bool = False, keypoints: DataFrame | None = None) -> None:
        """Publish a sensor's rows; refused without ``force`` where the sensor exists, and whenever a check fails."""
        sensor = meta["sensor"]
        if meta.get("sigma_space") is not None and meta["sigma_space"] not in SIGMA_SPACES:
            raise ValueError(f"sigma_space {meta['sigma_space']!r} is none of {SIGMA_SPACES}")
        if self.meta().filter(F.col("sensor") == sensor).count() and not force:
            raise ValueError(f"sensor {sensor!r} is stored already; use force to replace it")
        folder = f"{sensor_folder(sensor)}/{uuid.uuid4().hex}"
        path = f"{self.root}/measurements/{folder}"
        try:
            rows.withColumn("sensor", F.lit(sensor)).select(schemas.MEASUREMENT.fieldNames()).write.parquet(path)
            self._check(self.spark.read.schema(schemas.MEASUREMENT).parquet(path), meta, keypoints)
            self._publish(meta, folder)
        except BaseException:
            remove(self.spark, path)
            raise
        self._tidy(sensor)

    def _check(self, held: DataFrame, meta: dict, keypoints: DataFrame | None) -> None:
        wrong = {
            "duplicate key": checks.duplicate_keys(held, ["image_id", "point2D_idx", "sensor"]),
            "NaN": held.filter(F.isnan("estimated_depth") | F.coalesce(F.isnan("confidence"), F.lit(False))),
            "values": checks.broken_measurements(held),
            "shape": checks.sensor_shape(held).filter("NOT consistent"),
            "num_modes": held.filter(F.size("modes") != meta["num_modes"]),
        }
        if keypoints is not None:
            wrong["row count"] = checks.incomplete_images(keypoints, held)
        shown = [rows.select(F.lit(name).alias("rule"), F.to_json(F.struct("*")).alias("row")).limit(3) for name, rows in wrong.items()]
        for name in shown[1:]:
            shown[0] = shown[0].unionByName(name)
        if found := shown[0].collect():  # one job for all rules
            raise ValueError("; ".join(f"{r.rule}: {r.row}" for r in found))
        if not checks.sigma_space_agrees(held, meta.get("sigma_space")):
            raise ValueError("sigma_space must be given if and only if there are sigmas")

    def _publish(self, meta: dict, folder: str | None) -> None:
        """The entry that puts a version in force, or with no folder ends the sensor."""
        now = dt.datetime.now(dt.UTC).replace(microsecond=0, tzinfo=None)
        row = dict.fromkeys(ENTRY.fieldNames()) | {"created_at": now, "dump_dir": "", "dump_hash": ""} | meta
        row["method_params"] = json.dumps(meta.get("method_params") or {}, sort_keys=True)
        last = self._entries().filter(F.col("sensor") == meta["sensor"]).agg(F.max("version")).first()[0]
        row |= {"folder": folder, "version": (last or 0) + 1}
        made = self.spark.createDataFrame([tuple(row[c] for c in ENTRY.fieldNames())], ENTRY)
        made.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def _tidy(self, sensor: str) -> None:
        """Delete versions older than the one before the last."""
        mine = self._entries().filter((F.col("sensor") == sensor) & F.col("folder").isNotNull())
        for r in mine.orderBy(F.desc("version"), F.desc("folder")).offset(2).select("folder").collect():
            remove(self.spark, f"{self.root}/measurements/{r.folder}")

    def delete(self, sensor: str) -> None:
        """End the sensor by an entry, then drop its folder; no other sensor's files are touched."""
        if self._live().filter(F.col("sensor") == sensor).isEmpty():
            return
        self._publish({"sensor": sensor}, None)
        remove(self.spark, f"{self.root}/measurements/{sensor_folder(sensor)}")


def sensor_folder(sensor: str) -> str:
    """A folder name of letters and digits, another for every sensor."""
    return "sensor_" + "".join(c if c.isalnum() and c.isascii() else f"_{c.encode().hex()}_" for c in sensor)


def attach(store: Store, images: DataFrame, keypoints: DataFrame, bundles: DataFrame, sensor: str, method: str, params: dict | None = None, *, force: bool = False, dump_dir: str = "", dump_hash: str = "") -> None:
    """Sample every image's bundle (joined by file stem) at its keypoints and publish the rows as ``sensor``."""
    if method not in sampling.EXTRACTORS:
        raise KeyError(f"no extractor {method!r}; there are {sorted(sampling.EXTRACTORS)}")
    named = images.select("image_id", stem(F.col("name")).alias("stem"))
    if (missing := checks.first_missing(named, bundles).collect()):
        raise ValueError(f"no bundle for {[r.stem for r in missing]}")
    held = bundles.drop("image_id").join(named, "stem").drop("stem")
    rows = sampling.EXTRACTORS[method](held, keypoints, params)
    kinds = rows.select(F.size("modes").alias("k"), F.col("confidence").isNotNull().alias("c"), F.col("sigmas").isNotNull().alias("s")).first()
    space = sampling.SIGMA_SPACE.get(method, (params or {}).get("sigma_space", "log")) if kinds and kinds.s else None
    meta = {"sensor": sensor, "num_modes": kinds.k if kinds else 0, "method": method, "method_params": params, "sigma_space": space, "has_confidence": bool(kinds and kinds.c), "dump_dir": dump_dir, "dump_hash": dump_hash}
    store.write(rows, meta, force=force, keypoints=keypoints)
