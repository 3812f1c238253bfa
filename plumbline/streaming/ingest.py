"""Incremental ingest: new bundle files, as they appear, become measurement rows exactly once.

For folders that still fill.  Each micro-batch joins the new files
with the (static) images and keypoints, samples, and publishes the images it brought by replacing their partitions, so
a batch that is repeated after a failure writes the same rows again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.functions.naming import stem
from plumbline.operators import checks, sampling
from plumbline.sources.files import _bundle_row


def bundle_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New ``.npz`` files of a folder as bundle rows."""
    kind = spark.read.format("binaryFile").load(folder).schema
    files = spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", "*.npz").load(folder)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([_bundle_row(s, c) for s, c in zip(pdf["stem"], pdf["content"], strict=True)], columns=schemas.BUNDLE.fieldNames())

    return files.select(stem(F.col("path")).alias("stem"), "content").mapInPandas(run, schemas.BUNDLE)


def start_ingest(bundles: DataFrame, images: DataFrame, keypoints: DataFrame, method: str, sink: str, checkpoint: str, params: dict | None = None):
    """Start the query; rows go to ``sink``, partitioned by image_id.  A batch with broken values fails."""
    named = images.select("image_id", stem(F.col("name")).alias("stem"))

    def publish(batch: DataFrame, _: int) -> None:
        rows = sampling.EXTRACTORS[method](batch.join(named, "stem").drop("stem"), keypoints, params)
        if broken := checks.broken_measurements(rows).limit(3).collect():
            raise ValueError(f"broken measurements: {broken}")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("image_id").parquet(sink)

    return bundles.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
