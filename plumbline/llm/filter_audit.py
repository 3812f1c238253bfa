"""Operator 11: what each filter of a chain removes in every order, by the multilinear extension of the removal count.

Method.  Each document becomes a mask of the filters it fails, and a part (a source) the counts of its masks.  For a set
of filters the documents removed are those whose mask meets it; its multilinear extension, the removal polynomial
f(x) = sum over masks m of count(m) * (1 - product over i in m of (1 - x_i)), has one integer coefficient a set of
filters.  Corners of f give what any prefix of an order has removed, and so the survivors of every step.  The partial
derivative of f by a filter, along the diagonal, is a polynomial in one variable; its integral from 0 to 1 (in exact
rationals) is the filter's Shapley value, and that times the number of orders is what it removes summed over all orders.

A text is looked at once: words, letters and marks give four bits, a 128-bit hash of the text stands for it after that.
Whether the text stands at a smaller doc_id needs no group of copies in one place: the least doc_id of each hash is an
aggregate, and joined back on (hash, doc_id) it names the rows that are first, however many copies there are.

Defined results: a null text is empty (it fails A only, and E where a smaller doc_id has an empty text); a null source is
the empty string; a null doc_id is neither smaller nor greater than another, so such rows pass E and make nobody fail it;
repeated rows of one doc_id are counted each and do not make one another fail E; of several labels of one doc_id any 1
counts; an empty table has no parts and gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from plumbline.llm.common import by_rows, discard, stage, texts_of

FILTERS = "ABCDE"
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
CAPITALS = bytes(range(65, 91))
MARKS = b"#$%&*|"
FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that do not begin a code point
WHAT = ("n", "good", "toxic")


def mask_of(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, FOLLOWING))
    fails = (
        len(words) < FEWEST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT * len(words),
        100 * capitals > MOST_CAPITALS * points,
        len(text.translate(None, MARKS)) < len(text),
    )
    return sum(1 << i for i, f in enumerate(fails) if f)


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, h1 and h2 (hash of the text) and mask (filters A to D) of every row."""

    def run(cols):
        texts = texts_of(cols["text"])
        hashed = [xxh3_128_intdigest(t) for t in texts]
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        low = (1 << 64) - 1
        return {
            "doc_id": cols["doc_id"],
            "part": cols["source"].fill_null(""),
            "h1": pa.array([signed(h >> 64) for h in hashed], pa.int64()),
            "h2": pa.array([signed(h & low) for h in hashed], pa.int64()),
            "mask": pa.array([mask_of(t) for t in texts], pa.int32()),
        }

    return by_rows(docs, ["doc_id", "source", "text"], run, "doc_id long, part string, h1 long, h2 long, mask int")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (all five filters), n, good and toxic: documents, and those labelled so."""
    rows = stage(masks(docs), "masks")
    is_one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    first = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL").withColumn("is_first", F.lit(True))
    # on the hash and the id, so that a text with very many copies is spread over all tasks
    told = rows.join(first, ["h1", "h2", "doc_id"], "left").join(known, "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    mask = F.col("mask").bitwiseOR(F.when(copy, 1 << FILTERS.index("E")).otherwise(0))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    counts = told.select("part", mask.alias("mask"), "good", "toxic").groupBy("part", "mask").agg(F.count("*").alias("n"), zero("good"), zero("toxic"))
    held = stage(counts, "mask-counts")  # at most 32 rows a part
    discard(rows)
    return held


def removal_polynomial(counts: dict[int, int], filters: int) -> list[int]:
    """Coefficient of each product of variables, by the mask of the variables in it."""
    coefficient = [0] * (1 << filters)
    for mask, n in counts.items():
        some = mask
        while some:
            coefficient[some] += n if some.bit_count() & 1 else -n
            some = (some - 1) & mask
    return coefficient


def corner(polynomial: list[int], filters: int) -> int:
    """The polynomial where the variables in ``filters`` (a mask) are 1 and the others 0."""
    total, some = polynomial[0], filters
    while some:
        total += polynomial[some]
        some = (some - 1) & filters
    return total


def shapley(polynomial: list[int], i: int) -> Fraction:
    """Integral over the diagonal of the partial derivative by variable ``i``."""
    along: dict[int, int] = {}  # power of t -> coefficient
    for some, c in enumerate(polynomial):
        if some >> i & 1:
            along[some.bit_count() - 1] = along.get(some.bit_count() - 1, 0) + c
    return sum((Fraction(c, power + 1) for power, c in along.items()), Fraction(0))


def audit_rows(counts: dict[int, tuple[int, int, int]], filters: str = FILTERS):
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order of a part."""
    size = len(filters)
    total = sum(c[0] for c in counts.values())
    removed_by = []
    for k in range(len(WHAT)):
        polynomial = removal_polynomial({m: c[k] for m, c in counts.items()}, size)
        removed_by.append([corner(polynomial, s) for s in range(1 << size)])
        if not k:
            scaled = [shapley(polynomial, i) * factorial(size) for i in range(size)]
    if any(x.denominator != 1 for x in scaled):
        raise ArithmeticError("a sum over all orders is a whole number")
    every = (1 << size) - 1
    docs = removed_by[0]
    for order in permutations(range(size)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed, good, toxic = (r[after] - r[before] for r in removed_by)
            alone = docs[every] - docs[every ^ 1 << i]
            yield "".join(filters[j] for j in order), step, total - docs[after], removed, docs[1 << i] - removed, alone, good, toxic, int(scaled[i])
            before = after


FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from mask counts (part, mask, n, good, toxic)."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *WHAT)).alias("masks"))  # at most 2^filters a part

    def run(batches):
        for batch in batches:
            for part, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(audit_rows({m["mask"]: tuple(m[w] for w in WHAT) for m in held}, filters))
                order, step, *figures = zip(*rows, strict=True)
                out = {"part": pa.array([part] * len(rows)), "filter_order": pa.array(order), "step": pa.array(step, pa.int32())}
                yield pa.RecordBatch.from_pydict(out | {f: pa.array(v, pa.int64()) for f, v in zip(FIGURES, figures, strict=True)})

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in FIGURES))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over every part of ``docs``."""
    return audit(mask_counts(docs, labels))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
      + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
      + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (min(doc_id) OVER (PARTITION BY text) < doc_id)::INT AS mask,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l USING (doc_id)
), c AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), p AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, step, filter_order[step] AS letter, 1 << (ascii(filter_order[step]) - 65) AS bit,
    coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::INT AS before
  FROM p, (SELECT unnest(range(1, 6))::INT AS step)
), r AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM r"""
