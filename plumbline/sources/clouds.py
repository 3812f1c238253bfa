"""Point clouds in polygon files (ASCII and binary), read in splits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.bytes import PART, numbered_lines, parts

#: lines a header may have
MOST_LINES = 256
# fixed values of the file format: number types, with numpy's and Spark's
TYPES = {"char": ("i1", "int"), "int8": ("i1", "int"), "uchar": ("u1", "int"), "uint8": ("u1", "int"), "short": ("i2", "int"), "int16": ("i2", "int"), "ushort": ("u2", "int"), "uint16": ("u2", "int"), "int": ("i4", "int"), "int32": ("i4", "int"), "uint": ("u4", "long"), "uint32": ("u4", "long"), "float": ("f4", "float"), "float32": ("f4", "float"), "double": ("f8", "double"), "float64": ("f8", "double")}
FORMATS = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}


@dataclass(frozen=True)
class Header:
    """Byte order ('' for ASCII), lines and bytes of the header, and elements before and with the vertices."""

    order: str
    lines: int
    bytes: int
    size: int
    before: list[tuple[int, list[tuple[str, str]] | None]]  # rows and properties; None where a list makes rows differ in length
    vertices: int
    properties: list[tuple[str, str]]  # type, name

    def width(self, properties: list[tuple[str, str]]) -> int:
        return sum(np.dtype(TYPES[kind][0]).itemsize for kind, _ in properties)


def read_header(spark: SparkSession, path: str) -> Header:
    """The header of one file; errors where it is none, has no vertices or lists in them."""
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("b"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"))
    rows = raw.filter("block = 0").limit(MOST_LINES).collect()
    lines = [bytes(r.b) for r in rows]
    n = next((i + 1 for i, b in enumerate(lines) if b.strip() == b"end_header"), None)
    if n is None or lines[0].strip() != b"ply":
        raise ValueError(f"{path}: no header within {MOST_LINES} lines")
    order, elements = None, []
    for b in lines[1 : n - 1]:
        words = b.decode("latin-1").split()
        if words[:1] == ["format"]:
            order = FORMATS.get(words[1])
        elif words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"]:
            elements[-1][2].append(tuple(words[1:]))
    at = next((i for i, e in enumerate(elements) if e[0] == "vertex"), None)
    if order is None or at is None:
        raise ValueError(f"{path}: an unknown format or no vertices")
    plain = lambda properties: None if any(p[0] == "list" for p in properties) else properties
    before = [(count, plain(properties)) for _, count, properties in elements[:at]]
    _, count, properties = elements[at]
    if plain(properties) is None or (order and any(p is None for _, p in before)):
        raise ValueError(f"{path}: lists in or before the vertices")
    return Header(order, n, sum(len(b) + 1 for b in lines[:n]), rows[0]["size"], before, count, properties)


def read_points(spark: SparkSession, path: str, part: int = PART) -> DataFrame:
    """The vertices of one file: index (long, from 0) and a column a property, the same from both forms.

    Files are read in many splits: lines by their numbers, binary records in parts of whole records.  A cloud without vertices
    gives no rows; a binary file that is too short for its vertices is an error, as is an ASCII number that is none.
    """
    header = read_header(spark, path)
    shape = "index long, " + ", ".join(f"`{name}` {TYPES[kind][1]}" for kind, name in header.properties)
    if not header.vertices:
        return spark.createDataFrame([], shape)
    if not header.order:
        first = header.lines + sum(count for count, _ in header.before)
        lines = numbered_lines(spark, path).filter(F.col("no").between(first, first + header.vertices - 1))
        words = F.split(F.trim("line"), r"\s+")
        return lines.select((F.col("no") - first).alias("index"), *(F.get(words, i).cast(TYPES[kind][1]).alias(name) for i, (kind, name) in enumerate(header.properties)))
    record = np.dtype([(name, header.order + TYPES[kind][0]) for kind, name in header.properties])
    origin = header.bytes + sum(count * header.width(properties) for count, properties in header.before)
    if header.size < origin + header.vertices * record.itemsize:
        raise ValueError(f"{path}: too short for {header.vertices} vertices")
    each = max(1, part // record.itemsize)

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        first = int(row["part"]) * each
        n = max(0, min(each, header.vertices - first))
        held = np.frombuffer(row["content"], record, n)
        return pd.DataFrame({"index": np.arange(first, first + n), **{name: held[name].astype(record[name].newbyteorder("=")) for _, name in header.properties}})

    held = parts(spark, path, each * record.itemsize, 0, origin).filter(F.col("part") * each < header.vertices)
    return held.groupBy("path", "size", "part").applyInPandas(decode, shape)
