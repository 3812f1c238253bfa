"""Image retrieval by visual words, for pairs that close a loop: a hierarchical vocabulary and an inverted file.

The vocabulary is a tree of centres, ``branching`` under each node down to ``depth`` levels, fitted by k-means level by level on
a bounded sample of descriptors (``sample_rows``, in the order of a hash).  A descriptor's word is the leaf that it reaches by
the nearest centre of each level; all descriptors are indexed, in batches, without a shuffle.

The inverted file has a row for each word of an image with its weight: occurrences times the log of images over images
with the word, over the length of the image's vector.  The score of two images is the sum over common words of products
of weights.  Images are compared block by block, so a word of very many images is no task of its own; no pair is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import blocks, pairing, ranks
from plumbline.staging import discard, staged


@dataclass
class Vocabulary:
    """centres[level]: (nodes of the level, branching, dimension); centres that were never needed are infinitely far."""

    centres: list[np.ndarray]

    @property
    def branching(self) -> int:
        return self.centres[0].shape[1]

    @property
    def words(self) -> int:
        return self.branching ** len(self.centres)

    def word(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        """The leaf of each descriptor."""
        out = np.zeros(len(x), np.int64)
        for at in range(0, len(x), rows):
            node, some = np.zeros(len(x[at : at + rows]), np.int64), x[at : at + rows]
            for centres in self.centres:
                apart = ((centres[node] - some[:, None, :]) ** 2).sum(axis=2)
                node = node * self.branching + np.where(np.isnan(apart), np.inf, apart).argmin(axis=1)
            out[at : at + rows] = node
        return out


def _k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Up to ``k`` centres, each start as far as can be from those before it; the others are not a number."""
    centres = np.full((k, x.shape[1]), np.nan)
    if not len(x):
        return centres
    apart = np.full(len(x), np.inf)
    found = 0
    at = int(rng.integers(len(x)))
    while found < k and apart[at] > 0:
        centres[found] = x[at]
        apart = np.minimum(apart, ((x - x[at]) ** 2).sum(axis=1))
        at = int(apart.argmax())
        found += 1
    for _ in range(rounds):
        near = ((x[:, None, :] - centres[None, :found]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.stack([x[near == i].mean(axis=0) if (near == i).any() else centres[i] for i in range(found)])
        if np.allclose(moved, centres[:found]):
            break
        centres[:found] = moved
    return centres


def fit_vocabulary(descriptors: DataFrame, branching: int = 8, depth: int = 3, sample_rows: int = 20_000, rounds: int = 10, seed: int = 3) -> Vocabulary:
    """A vocabulary from at most ``sample_rows`` descriptors (image_id, descriptor: array of numbers of one length)."""
    usable = descriptors.filter(F.col("descriptor").isNotNull() & ~F.exists("descriptor", lambda v: v.isNull() | F.isnan(v.cast("double"))))
    drawn = usable.select(F.col("descriptor").cast("array<double>").alias("d")).orderBy(F.xxhash64("d", F.lit(seed)), "d").limit(sample_rows).collect()
    x = np.array([r.d for r in drawn], np.float64).reshape(len(drawn), -1)
    rng = np.random.default_rng(seed)
    node, centres = np.zeros(len(x), np.int64), []
    for level in range(depth):
        made = np.stack([_k_means(x[node == n], branching, rounds, rng) for n in range(branching**level)])
        centres.append(made)
        apart = ((made[node] - x[:, None, :]) ** 2).sum(axis=2)
        node = node * branching + np.where(np.isnan(apart), np.inf, apart).argmin(axis=1)
    return Vocabulary(centres)


def words_of(descriptors: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """image_id and word of every descriptor; those that are null or hold a null or NaN have none."""
    shared = descriptors.sparkSession.sparkContext.broadcast(vocabulary)  # branching ^ depth centres, a parameter
    usable = descriptors.filter(F.col("descriptor").isNotNull() & ~F.exists("descriptor", lambda v: v.isNull() | F.isnan(v.cast("double"))))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                word = shared.value.word(values.reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_pydict({"image_id": batch.column(0), "word": pa.array(word, pa.int64())})

    return usable.select(F.col("image_id").cast("long").alias("image_id"), F.col("descriptor").cast("array<double>").alias("descriptor")).mapInArrow(run, "image_id long, word long")


def inverted_file(words: DataFrame) -> DataFrame:
    """word, image_id and weight of every word of an image (image_id, word), staged; weights of an image have length one.

    A word that all images have weighs nothing and is left out, and so is an image of such words alone.
    """
    counted = words.filter("word IS NOT NULL AND image_id IS NOT NULL").groupBy("image_id", "word").agg(F.count("*").alias("_tf"))
    counted = staged(counted, "word-counts")
    total = counted.select("image_id").distinct().count()
    rare = counted.groupBy("word").agg(F.log(F.lit(float(max(total, 1))) / F.count("*")).alias("_idf")).filter("_idf > 0")
    raw = counted.join(rare, "word").select("word", "image_id", (F.col("_tf") * F.col("_idf")).alias("_w"))
    raw = staged(raw, "word-weights")
    length = raw.groupBy("image_id").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_l"))
    held = staged(raw.join(length, "image_id").select("word", "image_id", (F.col("_w") / F.col("_l")).alias("weight")), "inverted-file")
    discard(counted, raw)
    return held


def scored_pairs(index: DataFrame, block: int = 1024) -> DataFrame:
    """id_a < id_b and score (nine digits) of all images with a word in common."""
    pairs = pairing._pairs_within(index, ["word"], block, "weight")
    return pairs.groupBy("id_a", "id_b").agg(F.round(F.sum(F.col("c_1") * F.col("c_2")), 9).alias("score"))


def retrieved(index: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """image_id, rank (from 1), found_id and score of the ``k`` images nearest to each; ties to the smaller id.

    Images are dealt to blocks (of about ``block`` images, if given), and each two blocks are compared by a task, which keeps
    ``k`` of a block for each image: pairs are scored, not written.
    """
    n = blocks.number_of(index.count()) if block is None else -(-index.select("image_id").distinct().count() // block)
    dealt = index.select("image_id", "word", "weight", F.pmod(F.xxhash64("image_id"), F.lit(max(n, 1))).cast("int").alias("_b"), F.sequence(F.lit(0), F.lit(max(n, 1) - 1)).alias("_with"))

    def kept(a: dict[str, np.ndarray], b: dict[str, np.ndarray]):
        a, b = ({c: v[by] for c, v in x.items()} for x, by in ((a, np.lexsort((a["word"], a["image_id"]))), (b, np.lexsort((b["image_id"], b["word"])))))
        ids_a, at_a = np.unique(a["image_id"], return_inverse=True)
        ids_b, at_b = np.unique(b["image_id"], return_inverse=True)
        for m in blocks.meetings(at_a, a["word"], at_b, b["word"], len(ids_b)):
            low = m.key[0] // m.across * m.across
            sums = np.bincount(m.key - low, a["weight"][m.a] * b["weight"][m.b])
            key = np.flatnonzero(sums)
            score = np.rint(sums[key] * 1e9).astype(np.int64)
            key += low
            other = ids_a[key // m.across] != ids_b[key % m.across]
            key, score = key[other], score[other]
            if len(key):
                best = blocks.largest(score * m.across - key % m.across, blocks.groups_of(key, m.across), k)
                yield ids_a[key[best] // m.across], ids_b[key[best] % m.across], sums[key[best] - low]

    near = blocks.by_blocks(dealt, "_with", kept, "image_id long, found_id long, score double").withColumn("score", F.round("score", 9))
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "found_id"))
    return near.withColumn("rank", place).filter(F.col("rank") <= k).select("image_id", "rank", "found_id", "score")


def loop_pairs(images: DataFrame, index: DataFrame, keys: list[str], overlap: int, k: int, every: int = 1, least_score: float = 0.0) -> DataFrame:
    """keys, id_a, id_b: each image with the next ``overlap`` of its sequence, and each ``every``-th with the ``k`` most like it.

    ``images`` has keys, image_id and name; retrieval looks at images of all sequences and keeps those of the same one.  A pair
    of both kinds stands once.
    """
    placed = ranks.ranked_within(images.select(*keys, "image_id", "name"), keys, [F.col("name").asc(), F.col("image_id").asc()], "_r")
    placed = staged(placed.select(*keys, "image_id", (F.col("_r") - 1).alias("seq")), "sequences")
    near = pairing.sequential_pairs(placed, keys, overlap).select(*keys, F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    asked = placed.filter(F.col("seq") % every == 0)
    found = retrieved(index, k).filter(F.col("score") > least_score).join(asked, "image_id")
    found = found.join(placed.select(*keys, F.col("image_id").alias("found_id")), [*keys, "found_id"])
    far = found.select(*keys, F.least("image_id", "found_id").alias("id_a"), F.greatest("image_id", "found_id").alias("id_b"))
    return near.unionByName(far).distinct()
