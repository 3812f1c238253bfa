"""Operator 4: quality classifier, a factorisation machine.

Method.  A document's features are its hashed words (weight: their share of the words), quantile bins of statistics
of its structure, and a bin of the ``n_chars`` metadata.  The score is the logistic of a bias, a linear part and all
pairwise interactions of features through low-rank factors, computed in time linear in the features by the
sum-of-squares identity: sum over pairs <v_i, v_j> x_i x_j = 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].

It is fitted in numpy on a bounded sample of labelled rows (``train_rows``, taken in the order of a hash of doc_id);
feature extraction for the sample runs on Spark, over whole texts.  Every document is scored from its whole text.
labels, lang, source and doc_id are no inputs of a score.

Defined results: a null text scores as an empty one and a null n_chars as the length of the text; repeated rows get
equal scores; an empty table gives an empty one; where no labelled row exists the score is 0.5 and nothing is
predicted good; of several
rows of one labelled doc_id one text is learnt from; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import by_rows, held_out, rows_kept, texts_of

WORD_SPACE = 1 << 14
FACTORS = 8
BINS = 12
STATS = 18
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
DIGITS = b"0123456789"
CAPITALS = bytes(range(65, 91))
STOPS = b".,;:!?"
OTHER = bytes(sorted(set(range(33, 127)) - set(LETTERS) - set(DIGITS) - set(STOPS)))


def share(text: bytes, kind: bytes) -> float:
    return (len(text) - len(text.translate(None, kind))) / max(1, len(text))


def statistics(text: bytes, words: list[bytes], n_chars: float | None) -> list[float]:
    """Structure of a text: shares of kinds of characters, lengths, repetition of words and lines, and metadata."""
    n = max(1, len(words))
    lines = text.split(b"\n")
    distinct = len(set(words))
    same = sum(map(bytes.__eq__, words, words[1:]))
    word_bytes = len(text) - text.count(b" ") - len(lines) + 1
    return [
        share(text, LETTERS),
        share(text, DIGITS),
        share(text, CAPITALS),
        share(text, STOPS),
        share(text, OTHER),
        text.count(b"|") / n,
        text.count(b"#") / n,
        (text.count(b"*") + text.count(b"&")) / n,
        word_bytes / n,
        distinct / n,
        np.log1p(n),
        same / n,
        len(lines) / n,
        len(set(lines)) / len(lines),
        text.count(b"http") / n + text.count(b"@") / n,
        text.count(b". ") / n + text.count(b".\n") / n,
        max(map(len, words), default=0),
        np.log1p(n_chars if n_chars is not None else len(text.decode("utf-8", "replace"))),
    ]


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words and their shares."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    hashed = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) & (WORD_SPACE - 1)
    index, count = np.unique(hashed, return_counts=True)
    return index.astype(np.int64), (count / len(words)).astype(np.float32)


@dataclass
class Machine:
    """Bias, weights and factors over words first, then the bins of each statistic, and the edges of those bins."""

    edges: np.ndarray = field(default_factory=lambda: np.zeros((STATS, BINS - 1), np.float32))
    bias: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(WORD_SPACE + STATS * BINS, np.float32))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((WORD_SPACE + STATS * BINS, FACTORS), np.float32))

    def binned(self, stats: np.ndarray) -> np.ndarray:
        """Feature number of each statistic's bin, for rows of statistics."""
        bins = np.stack([np.searchsorted(self.edges[s], stats[:, s], side="right") for s in range(STATS)], axis=1)
        return WORD_SPACE + np.arange(STATS) * BINS + bins

    def score(self, starts: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Scores of documents whose features lie in ``index`` from ``starts`` on; none is without features."""
        vx = self.factors[index] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        z = self.bias + np.add.reduceat(self.weights[index] * value, starts) + 0.5 * (sums * sums - squares).sum(1)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def assemble(machine: Machine, stats: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, index and value of all documents: the bins of each, at a weight of 1/sqrt(STATS), then its words."""
    bins = machine.binned(stats)
    even = np.full(STATS, 1 / np.sqrt(STATS), np.float32)
    index = np.concatenate([part for b, (i, _) in zip(bins, words, strict=True) for part in (b, i)])
    value = np.concatenate([part for _, v in words for part in (even, v)])
    sizes = np.array([STATS + len(i) for i, _ in words])
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]), index, value


def fit(stats: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.15, decay: float = 2e-5, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss, both classes weighted alike."""
    machine = Machine()
    if not len(y):
        return machine
    machine.edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.astype(np.float32).copy()
    rng = np.random.default_rng(seed)
    machine.factors = rng.normal(0, 0.02, machine.factors.shape).astype(np.float32)
    rates = np.clip(np.array([np.mean(y == 0), np.mean(y == 1)]), 0.02, 1)
    weight = np.where(y == 1, 0.5 / rates[1], 0.5 / rates[0]).astype(np.float32)
    g_w, g_v, g_b = np.full(machine.weights.shape, 1e-3, np.float32), np.full(machine.factors.shape, 1e-3, np.float32), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            starts, index, value = assemble(machine, stats[rows], [words[r] for r in rows])
            error = (machine.score(starts, index, value) - y[rows]) * weight[rows] / len(rows)
            owner = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(index))))
            v = machine.factors[index]
            sums = np.add.reduceat(v * value[:, None], starts, axis=0)
            e = (error[owner] * value).astype(np.float32)
            grad_v = e[:, None] * (sums[owner] - v * value[:, None])
            touched, where = np.unique(index, return_inverse=True)
            by_feature = np.argsort(where, kind="stable")
            cut = np.concatenate([[0], np.cumsum(np.bincount(where))[:-1]])
            gw = np.add.reduceat(e[by_feature], cut) + decay * machine.weights[touched]
            gv = np.add.reduceat(grad_v[by_feature], cut, axis=0) + decay * machine.factors[touched]
            gb = float(error.sum())
            g_w[touched] += gw * gw
            g_v[touched] += gv * gv
            g_b += gb * gb
            machine.weights[touched] -= rate * gw / np.sqrt(g_w[touched])
            machine.factors[touched] -= 0.3 * rate * gv / np.sqrt(g_v[touched])
            machine.bias -= rate * gb / np.sqrt(g_b)
    return machine


def calibrate(machine: Machine, stats: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, threshold: float = 0.7) -> Machine:
    """Move the bias so that ``threshold`` divides the classes with the fewest errors on rows that were not fitted."""
    if len(set(y.tolist())) == 2:
        p = np.clip(machine.score(*assemble(machine, stats, words)), 1e-9, 1 - 1e-9)
        z = np.log(p / (1 - p))
        order = np.argsort(z, kind="stable")
        z, ones = z[order], y[order]
        # errors of a cut before each place: good ones below it, bad ones above it
        errors = np.concatenate([[0], np.cumsum(ones)]) + np.concatenate([np.cumsum((1 - ones)[::-1])[::-1], [0]])
        best = np.flatnonzero(errors == errors.min())
        mid = best[len(best) // 2]
        cut = (z[max(mid - 1, 0)] + z[min(mid, len(z) - 1)]) / 2
        machine.bias += float(np.log(threshold / (1 - threshold)) - cut)
    return machine


def _rows(cols) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    texts = texts_of(cols["text"])
    split = [t.split() for t in texts]
    stats = [statistics(t, w, n) for t, w, n in zip(texts, split, cols["n_chars"].to_pylist(), strict=True)]
    return np.array(stats, np.float32).reshape(len(texts), STATS), [word_features(w) for w in split]


def with_n_chars(docs: DataFrame) -> DataFrame:
    """doc_id, text and n_chars (null where the table has no such column)."""
    n = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select("doc_id", "text", n.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 12_000, modulus: int = 4, remainder: int = 2) -> Machine:
    """Fit on at most ``train_rows`` labelled rows that are not held out."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    sample = usable.select("doc_id", F.col("quality").cast("int").alias("y")).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id")).limit(train_rows)

    def features(cols):
        stats, words = _rows(cols)
        return {
            "y": cols["y"],
            "stats": pa.array(stats.tolist(), pa.list_(pa.float32())),
            "index": pa.array([i for i, _ in words], pa.list_(pa.int32())),
            "value": pa.array([v for _, v in words], pa.list_(pa.float32())),
        }

    rows = with_n_chars(docs).join(F.broadcast(sample), "doc_id")
    # one text an id, however many rows share it
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("y", "text", "n_chars"), F.xxhash64("text", "n_chars")).alias("r")).select("r.*")
    got = by_rows(rows, ["y", "text", "n_chars"], features, "y int, stats array<float>, index array<int>, value array<float>").toArrow()
    if not got.num_rows:
        return Machine()
    lists = lambda name, kind: [np.asarray(x, kind) for x in got.column(name).to_numpy()]
    words = list(zip(lists("index", np.int64), lists("value", np.float32), strict=True))
    stats, y = np.stack(lists("stats", np.float32)), got.column("y").to_numpy().astype(np.float32)
    apart = np.arange(len(y)) % 6 == 5
    machine = fit(stats[~apart], [w for w, a in zip(words, apart, strict=True) if not a], y[~apart])
    return calibrate(machine, stats[apart], [w for w, a in zip(words, apart, strict=True) if a], y[apart]) if apart.any() else machine


def score(docs: DataFrame, machine: Machine, modulus: int = 4, remainder: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(cols):
        stats, words = _rows(cols)
        return {"doc_id": cols["doc_id"], "score": pa.array(shared.value.score(*assemble(shared.value, stats, words)), pa.float64())}

    scored = by_rows(with_n_chars(docs), ["doc_id", "text", "n_chars"], run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, train_rows: int = 12_000, threshold: float = 0.7) -> DataFrame:
    """The documents predicted to be good, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_rows))
    named = "n_chars" in docs.columns

    def keep(cols):
        n = cols["n_chars"] if named else pa.nulls(len(cols["text"]))
        stats, words = _rows({"text": cols["text"], "n_chars": n})
        return shared.value.score(*assemble(shared.value, stats, words)) >= threshold

    return rows_kept(docs, keep)


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = 12_000) -> DataFrame:
    return score(docs, train(docs, labels, train_rows))
