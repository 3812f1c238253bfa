"""Column functions over file names, keys and small JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stem(name: Column) -> Column:
    """File name without folders and without its last suffix; a leading dot is part of the name."""
    return F.regexp_replace(F.regexp_extract(name, "([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")


def first_number(name: Column) -> Column:
    """The first run of digits as an integer, null where there is none."""
    digits = F.regexp_extract(name, r"(\d+)", 1)
    return F.when(digits != "", digits.cast("long"))


def scene_of(name: Column) -> Column:
    return F.substring_index(name, "_", 1)


def fill_template(template: Column, sequence: Column) -> Column:
    """``{sequence}`` in a template replaced; null where the template lacks it though a sequence is given, or has it without one."""
    has = F.contains(template, F.lit("{sequence}"))
    return F.when(has & sequence.isNotNull(), F.replace(template, F.lit("{sequence}"), sequence)).when(~has & sequence.isNull(), template)


def snapshot_name(ts: Column) -> Column:
    """Milliseconds since 1970, zero-padded to 13 digits."""
    return F.lpad(F.unix_millis(ts).cast("string"), 13, "0")


def utc_stamp(ts: Column) -> Column:
    """ISO time of a timestamp in UTC, to the second (the session's time zone must be UTC for literal text)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def is_jpeg(name: Column) -> Column:
    return F.endswith(F.lower(name), F.lit(".jpg"))


def is_submodel(name: Column) -> Column:
    return name.rlike("^[0-9]+$")


def sorted_json(params: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))


def file_digest(name: Column, size: Column) -> Column:
    """Aggregate: SHA-256 over ``name:size`` lines in the order of names, in one task; for the bounded dump of a folder."""
    line = F.concat(name, F.lit(":"), size.cast("string"), F.lit("\n"))
    lines = F.array_sort(F.collect_list(F.struct(name.alias("n"), line.alias("l"))))
    return F.sha2(F.array_join(F.transform(lines, lambda x: x.l), "").cast("binary"), 256)


def bucket_digest(files: DataFrame, keys: list[str], name: str, size: str) -> DataFrame:
    """digest of any number of files a key: SHA-256 over ``bucket:digest`` lines of at most 4096 buckets.

    A file's bucket is the first three hex digits of the SHA-256 of its name, and a bucket's digest its ``file_digest``.
    """
    known = files.filter(F.col(name).isNotNull() & F.col(size).isNotNull())
    bucket = F.substring(F.sha2(F.col(name).cast("binary"), 256), 1, 3)
    buckets = known.groupBy(*keys, bucket.alias("_bucket")).agg(file_digest(F.col(name), F.col(size)).alias("_digest"))
    return buckets.groupBy(*keys).agg(file_digest(F.col("_bucket"), F.col("_digest")).alias("digest"))
