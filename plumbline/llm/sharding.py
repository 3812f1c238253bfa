"""Operator 3 [native]: sharding by a permutation-filled lookup table.

Method.  Each shard has an order of preference over the slots of a table of prime size: offset + j * skip, both from
a hash of its name.  Shards take turns; at its turn a shard claims the first slot of its order that is still free,
until all are taken.  Every shard so gets its share to within one slot, and few slots move when a shard comes or goes.
A key's slot is its hash modulo the table size, so placement is one lookup in a broadcast table, whose size is a
parameter (``slots`` rows), not a matter of the data.

Documents are placed by doc_id, so a hot source spreads evenly.  The main path has only DataFrame functions; the
table itself is a literal that depends on parameters alone.

Defined results: a null doc_id is placed as the empty key; repeated rows are placed alike; an empty table gives an
empty one; text is not looked at, so nulls and lengths there do not matter; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shard_names(n: int) -> list[str]:
    return [f"shard-{i}" for i in range(n)]


def preference(name: str, slots: int) -> tuple[int, int]:
    """offset and skip of a shard's order of preference."""
    h = hashlib.md5(name.encode()).hexdigest()
    return int(h[:8], 16) % slots, int(h[8:16], 16) % (slots - 1) + 1


def fill(names: list[str], slots: int) -> list[int]:
    """Slot -> index of the shard that claimed it.  ``slots`` must be a prime of at least the number of shards."""
    if slots < max(3, len(names)) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} is no prime of at least {len(names)}")
    order = [preference(x, slots) for x in names]
    at, owner, free = [0] * len(names), [-1] * slots, slots
    while free:
        for i, (offset, skip) in enumerate(order):
            while owner[slot := (offset + at[i] * skip) % slots] >= 0:
                at[i] += 1
            owner[slot] = i
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % slots


def assign(docs: DataFrame, names: list[str], slots: int = 4093) -> DataFrame:
    """doc_id, slot and shard of every row."""
    owners = ",".join(map(str, fill(names, slots)))
    lookup = docs.sparkSession.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"))
    known = F.split(F.lit("\n".join(names)), "\n")
    lookup = lookup.select(F.col("slot").cast("long").alias("slot"), F.element_at(known, F.col("owner").cast("int") + 1).alias("shard"))
    placed = docs.select("doc_id", slot_of(F.col("doc_id"), slots).alias("slot"))
    return placed.join(F.broadcast(lookup), "slot").select("doc_id", "slot", "shard")


def oracle(shards: int, slots: int) -> str:
    """The same in DuckDB: the table is filled one claim a step by a recursive query."""
    return f"""
WITH RECURSIVE prefs AS (
  SELECT list(('0x' || substr(h, 1, 8))::BIGINT % {slots} ORDER BY i) AS offs, list(('0x' || substr(h, 9, 8))::BIGINT % {slots - 1} + 1 ORDER BY i) AS skips
  FROM (SELECT i, md5('shard-' || i) AS h FROM range({shards}) t(i))
), fill(turn, owner) AS (
  SELECT 0, list_transform(range({slots}), lambda x: -1::SMALLINT)
  UNION ALL
  SELECT turn + 1, owner[1:p] || [(turn % {shards})::SMALLINT] || owner[p + 2:]
  FROM (
    SELECT turn, owner, list_filter(list_transform(range({slots}), lambda j: (offs[turn % {shards} + 1] + j * skips[turn % {shards} + 1]) % {slots}), lambda s: owner[s + 1] = -1)[1] AS p
    FROM fill, prefs WHERE turn < {slots}
  )
), slots AS (
  SELECT unnest(range({slots})) AS slot, unnest(owner) AS owner FROM fill WHERE turn = {slots}
), keyed AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {slots} AS slot FROM documents
)
SELECT doc_id, keyed.slot AS slot, 'shard-' || owner AS shard FROM keyed JOIN slots USING (slot)"""
