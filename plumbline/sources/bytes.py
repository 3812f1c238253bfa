"""Binary files of any size in parts, and lines with their numbers, through Spark's text source.

The text source cuts a file into splits in any store Spark reads.  With one byte as line separator it does so for bytes
that are no text: the separators come back when the chunks are joined again, and the bytes of the blocks before give a
chunk its place in the file.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: bytes of a part of a file
PART = 1 << 20
#: bytes of a stretch that a worker hands on at once
_STRETCH = 1 << 20
_MARK = b"\xef\xbb\xbf"  # a byte-order mark, which the line reader drops at the start of a file


def _of_file(name: str) -> Column:
    return F.col(f"_metadata.file_{name}")


def _before(counts: DataFrame, n: str, name: str) -> DataFrame:
    """Per block of a file the sum of ``n`` over its blocks before: one row a split of the file."""
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum(n).over(earlier), F.lit(0)))


def _stretches(batches):
    last, local = None, 0
    for pdf in batches:
        for at, rows in pdf.groupby(["path", "block"], sort=False):
            if at != last:
                last, local = at, 0
            content = b"\n".join(rows["chunk"]) + b"\n"
            starts = range(0, len(content), _STRETCH)
            yield pd.DataFrame([(*at, local + s, content[s : s + _STRETCH]) for s in starts], columns=["path", "block", "local", "bytes"], dtype=object)
            local += len(content)


def parts(spark: SparkSession, path: str, length: int = PART, halo: int = 0, origin: int = 0) -> DataFrame:
    """path, size, part, start, content: the bytes from ``origin`` on in parts of ``length``, each with ``halo`` bytes of the next.

    ``path`` may name many files.  An empty file has no part.  A part's bytes meet in one task, a file's never do.
    """
    if halo > length:
        raise ValueError("a halo must not be longer than a part")
    raw = spark.read.option("lineSep", "\n").text(path)
    chunks = raw.select(F.col("value").cast("binary").alias("chunk"), _of_file("path").alias("path"), _of_file("block_start").alias("block"), _of_file("size").alias("size"))
    blocks = chunks.groupBy("path", "block").agg(F.sum(F.octet_length("chunk") + 1).alias("n"), F.first("size").alias("size"))
    blocks = _before(blocks, "n", "before").withColumn("all", F.sum("n").over(Window.partitionBy("path")))
    blocks = blocks.withColumn("lost", F.when(F.col("all") < F.col("size"), len(_MARK)).otherwise(0))
    held = chunks.select("path", "block", "chunk").mapInPandas(_stretches, "path string, block long, local long, bytes binary").join(blocks, ["path", "block"])
    first = (F.col("lost") > 0) & (F.col("block") == 0) & (F.col("local") == 0)
    held = held.withColumn("bytes", F.when(first, F.concat(F.lit(_MARK), "bytes")).otherwise(F.col("bytes")))
    held = held.withColumn("at", F.when(first, 0).otherwise(F.col("before") + F.col("local") + F.col("lost"))).withColumn("end", F.least(F.col("at") + F.octet_length("bytes"), "size"))
    part = lambda x: F.floor((x - origin) / length)
    held = held.filter(f"end > at AND end > {origin}").withColumn("part", F.explode(F.sequence(F.greatest(part(F.col("at") - halo), F.lit(0)), part(F.col("end") - 1))))
    start = F.col("part") * length + origin
    low, high = F.greatest("at", start), F.least("end", start + length + halo)
    held = held.withColumn("low", low).withColumn("n", (high - low).cast("int")).filter("n > 0")
    piece = F.struct("low", F.substring("bytes", (F.col("low") - F.col("at") + 1).cast("int"), F.col("n")).alias("b"))
    gathered = held.groupBy("path", "size", "part").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    content = F.aggregate("pieces", F.lit(b""), lambda whole, p: F.concat(whole, p["b"]))
    # a last part that only the halo of another file end would fill has no bytes of its own
    return gathered.select("path", "size", "part", start.alias("start"), content.alias("content")).filter("start < size")


def numbered_lines(spark: SparkSession, path: str, comment: str | None = None) -> DataFrame:
    """path, no, line: the lines of text files with their numbers from 0 in the file; lines that begin with ``comment`` do not count.

    A line's number is its place in its split and the lines of the splits before it, so files are read in many splits.  The two
    reads of a file are cut the same way, and a task run again numbers its lines the same way.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), _of_file("path").alias("path"), _of_file("block_start").alias("block"))
    if comment:
        lines = lines.filter(~F.startswith("line", F.lit(comment)))
    lines = lines.withColumn("id", F.monotonically_increasing_id())
    blocks = _before(lines.groupBy("path", "block").agg(F.min("id").alias("first"), F.count("*").alias("n")), "n", "before")
    return lines.join(blocks, ["path", "block"]).select("path", (F.col("id") - F.col("first") + F.col("before")).alias("no"), "line")
