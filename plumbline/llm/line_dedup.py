"""Operator 12: lines that many documents share, as keep bitmaps of documents.  DataFrame functions only.

Method.  Each line becomes a 128-bit hash of its key (stripped, A-Z lowered), its document and its position.  Hashes are
dealt by ranges and sorted by hash, document and position; one pass over each range streams first occurrences (a
document counts for a key where the key is met in it first) and so counts the documents of each key.  Lines to drop come
back as bits, 64 lines a word, gathered by document; words in which every line is kept are left out.  Only hashes and
bits are shuffled between the two readings of the texts.

A key may make up a third of all lines.  Keys of at least one line in ``SHARE`` are known beforehand (counts of 65,536 ranges
of hashes, then counts of the keys of the heavy ranges), so there are at most ``SHARE`` of them: they are broadcast, counted
over distinct (key, document) rows and marked where they lie.  What is dealt by ranges has no key above that share.

Defined results: a null or empty text is one empty line; keys under ``min_chars`` code points are never dropped; a document
is a doc_id with its text, so a repeated row counts once and each of its rows loses the same lines; rows with a null
doc_id and one text are one document; a text of which all lines go leaves the empty text; an empty table gives an empty
one; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import discard, stage
from plumbline.staging import staged_with_sum

#: what is stripped off both ends of a line
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: a key of one line in so many is handled apart from the ranges
SHARE = 4096
WORD = 64


def line_key(line: Column) -> Column:
    """The line stripped, with A-Z lowered and no other letter."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _named(docs: DataFrame) -> DataFrame:
    """did and th, which together name a document, its doc_id and its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(0)).cast("long").alias("did"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("th")
    )


def line_hashes(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """did, th, pos, h1 and h2 of every line whose key has at least ``min_chars`` code points."""
    lines = _named(docs).select("did", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("did", "th", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    return keyed.select("did", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def _heavy(lines: DataFrame, total: int) -> DataFrame:
    """h1 and h2 of the keys that make up at least one line in ``SHARE``."""
    part = F.shiftrightunsigned("h1", 48)
    large = F.col("n") * SHARE >= total
    ranges = lines.groupBy(part.alias("part")).agg(F.count("*").alias("n")).filter(large).select("part")
    some = lines.select("h1", "h2", part.alias("part")).join(F.broadcast(ranges), "part", "left_semi")
    return some.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(large).select("h1", "h2")


def dropped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """did, th and pos of every line whose key is found in at least ``min_docs`` documents.

    With ``keep_first`` the key's first line, by doc_id, text hash and position, stays.
    """
    lines, total = staged_with_sum(line_hashes(docs, min_chars), "line-hashes", F.lit(1))
    key, place = ["h1", "h2"], ["did", "th", "pos"]
    heavy = stage(_heavy(lines, int(total)), "heavy-keys")

    apart = lines.join(F.broadcast(heavy), key)
    counted = apart.groupBy(*key, "did", "th").agg(F.min("pos").alias("pos")).groupBy(*key).agg(F.count("*").alias("docs"), F.min(F.struct(*place)).alias("first"))
    counted = stage(counted.filter(F.col("docs") >= min_docs), "heavy-counts")
    marked = lines.join(F.broadcast(counted), key)
    if keep_first:
        marked = marked.filter(F.struct(*place) != F.col("first"))

    rest = lines.join(F.broadcast(heavy), key, "left_anti").repartitionByRange(*key).sortWithinPartitions(*key, *place)
    of_key = Window.partitionBy(*key)
    in_order = of_key.orderBy(*place)
    same = (F.lag("did").over(in_order) == F.col("did")) & (F.lag("th").over(in_order) == F.col("th"))
    streamed = rest.select(*key, *place, F.when(same, 0).otherwise(1).alias("is_new"), F.row_number().over(in_order).alias("at"))
    streamed = streamed.withColumn("docs", F.sum("is_new").over(of_key)).filter(F.col("docs") >= min_docs)
    if keep_first:
        streamed = streamed.filter("at > 1")
    return marked.select(*place).unionByName(streamed.select(*place))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """did, th, n_dropped and words: of 64 lines each a word (number, bits), a bit set where the line stays.

    Words without a dropped line are left out, and so are documents without one.
    """
    dropped = dropped_lines(docs, min_docs, min_chars, keep_first).repartition("did", "th")
    word, bit = F.floor(F.col("pos") / WORD).cast("int"), F.expr(f"shiftleft(1L, pos % {WORD})")
    words = dropped.groupBy("did", "th", word.alias("word")).agg(F.bit_or(bit).alias("gone"))
    gathered = F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits"))))
    return words.groupBy("did", "th").agg(F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"), gathered.alias("words"))


def with_kept_text(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (the text of the lines that stay) of every row."""
    gap = "x.word - coalesce(get(words, i - 1).word, -1) - 1"
    whole = F.expr(f"flatten(transform(words, (x, i) -> concat(array_repeat(-1L, {gap}), array(x.bits))))")
    found = _named(docs).join(bitmaps.select("did", "th", "n_dropped", whole.alias("whole")), ["did", "th"], "left")
    found = found.select("doc_id", "text", "n_dropped", "whole", F.split("text", "\n", -1).alias("lines"))
    stays = F.expr(f"array_join(filter(lines, (x, i) -> getbit(coalesce(get(whole, i div {WORD}), -1L), i % {WORD}) = 1), '\n')")
    kept = F.when(F.col("whole").isNull(), F.col("text")).otherwise(stays)
    return found.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def line_digest(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row."""
    found = with_kept_text(docs, keep_bitmaps(docs, min_docs, min_chars))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l
), f AS (
  SELECT key, 1 AS gone FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (gone IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id"""
