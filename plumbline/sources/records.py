"""Records of variable length in binary files whose starts are known only by walking from the first one.

Every part of a file is looked at alone: each byte of it that could begin a record is followed to where its chain of records
leaves the part.  Chains that begin anywhere soon fall in with the true one, so few exits remain.  Exits are the only possible
entries of later parts; links from entry to exit are doubled until the walk from the file's first record has met all parts.
The work is in tasks, the number of jobs grows with the logarithm of a file's parts, and the result is exact: the number of
records is held against the one that the file states.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.bytes import PART, parts
from plumbline.staging import discard, staged

#: bytes a record may take before its list begins
HALO = 4096
#: bytes of the count of records, at the start of a file
COUNT = 8

# fixed values of the file format: camera models by number, with the number of their parameters
MODELS = [("SIMPLE_PINHOLE", 3), ("PINHOLE", 4), ("SIMPLE_RADIAL", 4), ("RADIAL", 5), ("OPENCV", 8), ("OPENCV_FISHEYE", 8), ("FULL_OPENCV", 12), ("FOV", 5), ("SIMPLE_RADIAL_FISHEYE", 4), ("RADIAL_FISHEYE", 5), ("THIN_PRISM_FISHEYE", 12)]


def _whole_numbers(b: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Little-endian unsigned numbers at each position."""
    found = np.zeros(len(at), np.uint64)
    for i in range(width):
        found |= b[at + i].astype(np.uint64) << np.uint64(8 * i)
    return found


def _camera_heads(b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([k for _, k in MODELS])
    model = _whole_numbers(b, np.arange(n) + 4, 4)
    known = model < len(MODELS)
    return np.where(known, 24, -1), np.where(known, counts[np.where(known, model, 0).astype(int)], 0).astype(np.uint64)


def _image_heads(b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(n)
    zeros = np.flatnonzero(b == 0)
    place = np.searchsorted(zeros, at + 64)
    end = np.append(zeros, -1)[place]  # the end of the name
    known = (end >= 0) & (end + 9 - at <= HALO)
    return np.where(known, end + 9 - at, -1), _whole_numbers(b, np.where(known, end + 1, 0), 8)


def _point_heads(b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full(n, 51), _whole_numbers(b, np.arange(n) + 43, 8)


def _camera(b: bytes, head: int, n: int) -> tuple:
    at, model = np.frombuffer(b, "<u4", 2)
    width, height = np.frombuffer(b, "<u8", 2, 8)
    return int(at), MODELS[model][0], int(width), int(height), np.frombuffer(b, "<f8", n, 24).tolist()


def _image(b: bytes, head: int, n: int) -> tuple:
    pose = np.frombuffer(b, "<f8", 7, 4).tolist()
    at, camera = int(np.frombuffer(b, "<u4", 1)[0]), int(np.frombuffer(b, "<u4", 1, 60)[0])
    return at, pose[:4], pose[4:], camera, b[64 : head - 9].decode()


def _point(b: bytes, head: int, n: int) -> tuple:
    return int(np.frombuffer(b, "<u8", 1)[0]), np.frombuffer(b, "<f8", 3, 8).tolist(), float(np.frombuffer(b, "<f8", 1, 35)[0])


@dataclass(frozen=True)
class Kind:
    """A file's records: head lengths and list counts at every byte, the list's elements, and the decoding of a head."""

    heads: object
    decode: object
    schema: str
    item: np.dtype

    def extents(self, content: bytes, start: int, size: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Head length, list count and record length at each byte of a part; a length of -1 where no record can begin."""
        n = min(length, len(content))
        b = np.frombuffer(content + b"\xff" * 128, np.uint8)  # no count can be read in what follows a file's end
        head, count = self.heads(b, n)
        room = size - start - np.arange(n) - head
        fits = (head >= 0) & (room >= 0)
        fits &= count <= (np.where(fits, room, 0) // self.item.itemsize).astype(np.uint64)
        count = np.where(fits, count, 0).astype(np.int64)
        return head, count, np.where(fits, head + count * self.item.itemsize, -1)

    def exits(self, content: bytes, start: int, size: int, length: int) -> np.ndarray:
        """Per byte of a part the place (in the file) where its chain of records leaves the part; -1 where it breaks off."""
        _, _, whole = self.extents(content, start, size, length)
        to = np.where(whole > 0, np.arange(len(whole)) + whole, -1)
        while (inside := np.flatnonzero((to >= 0) & (to < len(whole)))).size:
            to[inside] = to[to[inside]]
        return np.where(to >= 0, to + start, -1)


CAMERAS = Kind(_camera_heads, _camera, "camera_id long, model string, width int, height int, params array<double>", np.dtype("<f8"))
IMAGES = Kind(_image_heads, _image, "image_id long, q_wxyz array<double>, translation array<double>, camera_id long, name string", np.dtype([("x", "<f8"), ("y", "<f8"), ("point3D_id", "<i8")]))
POINTS = Kind(_point_heads, _point, "point3D_id long, xyz array<double>, error double", np.dtype([("image_id", "<u4"), ("point2D_idx", "<u4")]))


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def _blank(schema: str) -> pd.DataFrame:
    kinds = {"long": "int64", "int": "int64", "double": "float64"}
    return pd.DataFrame({c.split(" ")[0]: np.empty(0, kinds.get(c.split(" ")[1], object)) for c in schema.split(", ")})


def _same(path: str, n: int) -> np.ndarray:
    return np.full(n, path, object)


def _entries(held: DataFrame, kind: Kind, length: int) -> DataFrame:
    """path, at: the first record that begins in each part where one does, by the walk from the file's first record."""

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        to = np.unique(kind.exits(row["content"], row["start"], row["size"], length))
        to = to[(to >= 0) & (to < row["size"])]
        return pd.DataFrame({"path": _same(row["path"], len(to)), "at": to})

    def link(part: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if part.empty or entries.empty:
            return _blank("path string, at long, to long")
        row = part.iloc[0]
        to = kind.exits(row["content"], row["start"], row["size"], length)[(entries["at"] - row["start"]).to_numpy()]
        good = (to >= 0) & (to < row["size"])
        return pd.DataFrame({"path": _same(row["path"], int(good.sum())), "at": entries["at"].to_numpy()[good], "to": to[good]})

    first = held.filter(f"part = 0 AND size > {COUNT}").select("path", F.lit(COUNT).cast("long").alias("at"))
    exits = held.groupBy("path", "part").applyInPandas(leave, "path string, at long")
    asked = staged(exits.union(first).distinct().withColumn("part", F.floor(F.col("at") / length)), "exits")
    links = staged(held.groupBy("path", "part").cogroup(asked.groupBy("path", "part")).applyInPandas(link, "path string, at long, to long"), "links")
    discard(asked)
    reached, n = staged(first, "reached"), -1
    while (now := reached.count()) > n:
        n = now
        more = reached.join(links, ["path", "at"]).select("path", F.col("to").alias("at"))
        after = staged(reached.union(more).distinct(), "reached")
        further = staged(links.join(links.select("path", F.col("at").alias("to"), F.col("to").alias("next")), ["path", "to"]).select("path", "at", F.col("next").alias("to")), "links")
        discard(reached, links)
        reached, links = after, further
    discard(links)
    return reached


def read_records(spark: SparkSession, path: str, kind: Kind, length: int = PART) -> tuple[DataFrame, DataFrame]:
    """The records of a file (path, at and the columns of the kind), and the elements of their lists.

    The second table has path, at (of the record), place (in the list) and ``item``, the fields of an element.  An empty file
    has no records.  A file whose records do not follow one another up to the stated number is an error, as is a record whose
    head is over ``HALO`` bytes.  Lists may be of any length; they are decoded where their bytes lie.
    """
    held = staged(parts(spark, path, length, HALO), "parts")
    entries = _entries(held, kind, length)
    whole_schema = f"path string, at long, list_at long, n_items long, {kind.schema}"

    def walk(part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if part.empty or found.empty:
            return _blank(whole_schema)
        row = part.iloc[0]
        head, count, whole = kind.extents(row["content"], row["start"], row["size"], length)
        at, rows = int(found["at"].min() - row["start"]), []
        while at < len(whole) and whole[at] > 0:
            b = row["content"][at : at + HALO]
            rows.append((row["path"], row["start"] + at, row["start"] + at + head[at], count[at], *kind.decode(b, int(head[at]), int(count[at]))))
            at += int(whole[at])
        return pd.DataFrame(rows, columns=_names(whole_schema)) if rows else _blank(whole_schema)

    by_part = entries.withColumn("part", F.floor(F.col("at") / length))
    records = staged(held.groupBy("path", "part").cogroup(by_part.groupBy("path", "part")).applyInPandas(walk, whole_schema), "records")
    discard(entries)
    eight = F.reverse(F.substring("content", 1, COUNT))
    stated = held.filter("part = 0").select("path", F.conv(F.hex(eight), 16, 10).cast("decimal(20,0)").alias("stated"))
    counted = stated.join(records.groupBy("path").count(), "path", "left").filter("stated <> coalesce(count, 0) OR stated IS NULL").limit(3).collect()
    if counted:
        raise ValueError("; ".join(f"{r.path}: {r['count'] or 0} records where {r.stated} are stated" for r in counted))

    step = kind.item.itemsize
    within = F.sequence(F.floor(F.col("list_at") / length), F.floor((F.col("list_at") + (F.col("n_items") - 1) * step) / length))
    lists = records.filter("n_items > 0").select("path", "at", "list_at", "n_items", F.explode(within).alias("part"))
    fields = kind.item.names or ()
    kinds = {"<f8": "double", "<i8": "long", "<u4": "long"}
    shape = "path string, at long, place long, " + (", ".join(f"{f} {kinds[kind.item[f].str]}" for f in fields) or "value double")

    def decode(part: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found = []
        for r in wanted.itertuples():
            row = part.iloc[0]
            first = max(0, -((r.list_at - row["start"]) // step))  # the first element that begins in this part
            last = min(r.n_items, -((r.list_at - row["start"] - length) // step))
            if last > first:
                items = np.frombuffer(row["content"], kind.item, last - first, r.list_at + first * step - row["start"])
                columns = {f: items[f].astype(kind.item[f].newbyteorder("=")) for f in fields} or {"value": items}
                found.append(pd.DataFrame({"path": _same(r.path, last - first), "at": r.at, "place": np.arange(first, last), **columns}))
        return pd.concat(found, ignore_index=True) if found else _blank(shape)

    items = held.groupBy("path", "part").cogroup(lists.groupBy("path", "part")).applyInPandas(decode, shape)
    return records.drop("list_at", "n_items"), items
