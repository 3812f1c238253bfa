"""Operator 13: importance resampling towards a target, by hashed n-grams over an integer word dictionary.

Method.  A worker keeps a dictionary from distinct words to ids.  The n-grams of a batch of texts are tuples of ids; each
distinct tuple is met once: its bytes are put together again from the dictionary and hashed to a bucket, and the counts
(or places) of the tuple are joined back by its number.  Counts of buckets of the corpus and of the target, both bounded by
the number of buckets, give each bucket's gain in whole thousandths of a nat; a document's weight is the sum over its
features, and with Gumbel noise drawn from a hash of its doc_id the highest scores are a sample without replacement.

Nothing but bucket counts and one narrow row a document is shuffled.  Ranks come from ranges of scores (``numbered``),
not from one sorted task.

Defined results: a null or empty text has no features, weight 0 and is not drawn where ``min_words`` is above 0; a row
with a null doc_id has a null score, is not drawn and not among the N; its features count for the corpus, as those of
repeated rows do each time; repeated rows of one doc_id are drawn apart, ties between them in any order; an empty target
or corpus has counts of 0; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import by_rows, texts_of
from plumbline.operators.ranks import numbered
from plumbline.staging import staged_with_sum

BUCKETS, LONGEST, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: A-Z become a-z; digits, a-z and the bytes of other scripts stay; all else ends a word
LETTERS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


class Dictionary(dict):
    """word -> id; ids count from 0 and ``words`` turns them back."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number


class Grams:
    """The features of batches of texts.  Holds one dictionary, started anew when it has over ``limit`` words."""

    def __init__(self, longest: int, buckets: int, limit: int = 1_000_000):
        self.longest, self.buckets, self.limit = longest, buckets, limit
        self.ids = Dictionary()
        self.hashed: dict[tuple[int, ...], int] = {}

    def bucket(self, run: tuple[int, ...]) -> int:
        """The bucket of a tuple of ids: its words' bytes are put together and hashed when it is met first."""
        found = self.hashed.get(run)
        if found is None:
            found = self.hashed[run] = zlib.crc32(b" ".join([self.ids.words[i] for i in run])) % self.buckets
        return found

    def of(self, texts: list[bytes]):
        """Words of each text, and for each length of run: its texts (positions), distinct buckets, and number of its tuple."""
        if len(self.ids.words) > self.limit or len(self.hashed) > self.limit:
            self.ids, self.hashed = Dictionary(), {}
        number = self.ids.__getitem__
        each = [np.fromiter(map(number, w), np.int64, len(w)) for w in (t.translate(LETTERS).split() for t in texts)]
        count = np.array([len(x) for x in each], np.int64)
        ids = np.concatenate([*each, np.empty(0, np.int64)])
        text = np.repeat(np.arange(len(texts)), count)
        left = np.repeat(np.cumsum(count), count) - np.arange(len(ids))  # words from here to the text's end
        runs = []
        for n in range(1, self.longest + 1):
            at = np.flatnonzero(left >= n)
            if n == 1:
                distinct, inverse = np.unique(ids[at], return_inverse=True)
                distinct = distinct[:, None]
            else:
                distinct, inverse = np.unique(ids[at[:, None] + np.arange(n)], axis=0, return_inverse=True)
            bucket = np.fromiter(map(self.bucket, map(tuple, distinct.tolist())), np.int64, len(distinct))
            runs.append((text[at], bucket, inverse.reshape(-1)))
        return count, runs


def bucket_counts(df: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts of ``df`` in each bucket.  The driver receives one row a bucket."""
    holder: list[Grams] = []

    def run(cols):
        grams = holder[0] if holder else holder.append(Grams(longest, buckets)) or holder[0]
        total = np.zeros(buckets, np.int64)
        for _, bucket, inverse in grams.of(texts_of(cols["text"]))[1]:
            np.add.at(total, bucket, np.bincount(inverse, minlength=len(bucket)))
        used = np.flatnonzero(total)
        return {"bucket": pa.array(used, pa.int32()), "n": pa.array(total[used], pa.int64())}

    counts = np.zeros(buckets, np.int64)
    for bucket, n in by_rows(df, ["text"], run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, target to corpus, rounded down."""
    s_all, t_all, buckets = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = lambda s, t: (float(t + 1) * float(s_all + buckets)) / (float(s + 1) * float(t_all + buckets))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int, seed: int = SEED) -> int:
    """Gumbel noise in whole thousandths, drawn from a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    holder: list[Grams] = []

    def run(cols):
        gain = shared.value
        grams = holder[0] if holder else holder.append(Grams(longest, len(gain))) or holder[0]
        count, runs = grams.of(texts_of(cols["text"]))
        features, weight = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64)
        for text, bucket, inverse in runs:
            features += np.bincount(text, minlength=len(count))
            total = np.concatenate([[0], np.cumsum(gain[bucket][inverse])])  # whole numbers, exact
            ends = np.searchsorted(text, np.arange(len(count) + 1))
            weight += total[ends[1:]] - total[ends[:-1]]
        score = [None if d is None else w + noise(d, seed) for d, w in zip(cols["doc_id"].to_pylist(), weight.tolist(), strict=True)]
        out = {"doc_id": cols["doc_id"], "n_words": count, "n_features": features, "weight": weight, "score": score}
        return {k: v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for k, v in out.items()}

    return by_rows(docs, ["doc_id", "text"], run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every row."""
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    may = (F.col("n_words") >= min_words) & F.col("doc_id").isNotNull()
    held, n = staged_with_sum(scored(docs, gain, longest, seed).withColumn("may", may), "scored", may.cast("long"))
    drawn = percent * int(n) // 100
    ranked = numbered(held.filter("may"), [F.col("score").desc(), F.col("doc_id").asc()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = held.filter("NOT may").withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of UTF-8 bytes is spelled out: a table of 256 entries by eight shifts each, then one look-up a byte
ORACLE = rf"""
WITH crc AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i)
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), dw AS (
  SELECT doc_id, unnest(words) AS w FROM d
), bw AS (
  SELECT unnest(words) AS w FROM b
), known AS (
  SELECT w, xor(list_reduce([4294967295::BIGINT] || list_transform(range(len(h) // 2), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::BIGINT),
      lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT w, hex(w) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)), crc
), s AS (
  SELECT bucket, count(*) AS s FROM dw JOIN known USING (w) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM bw JOIN known USING (w) GROUP BY bucket
), totals AS (
  SELECT (SELECT count(*) FROM dw) AS s_all, (SELECT count(*) FROM bw) AS t_all
), gain AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (s_all + {BUCKETS})::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + {BUCKETS})::DOUBLE)))::BIGINT AS g
  FROM (SELECT unnest(range({BUCKETS})) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), totals
), weight AS (
  SELECT doc_id, sum(g) AS weight FROM dw JOIN known USING (w) JOIN gain USING (bucket) GROUP BY doc_id
), score AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM d LEFT JOIN weight USING (doc_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_features >= {MIN_WORDS}) OVER () AS n FROM score
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {MIN_WORDS} AND r <= {PERCENT} * n // 100 THEN r END AS rank FROM ranked"""
