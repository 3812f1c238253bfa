"""Operator 9: toxicity by a bidirectional gated recurrent network with attention pooling.

Method.  A text is read in all overlapping windows of ``WINDOW`` words, ``STRIDE`` apart.  A word enters as a learnt
vector of its hash (word input) and as the mean and the maximum of learnt vectors of its hashed character 3- to
5-grams and beginnings of up to 12 bytes (character input).  Two gated recurrent networks read the window forwards and backwards, attention pools
their states, and a logistic unit scores the window; a document's score is that of its worst window.

The network is trained in numpy, on the driver, on a bounded sample: at most ``train_rows`` toxic and as many other
labelled rows that are not held out, in the order of a hash of doc_id.  Spark reads their whole texts: first for the
log-odds of hashed words and character n-grams between the classes, from which the vectors start, then for the window
of each text with the most suspicious words and one other window of each clean text; only those windows reach the
driver.  A sixth of the sample is kept from fitting and sets where 0.7 lies between the classes.

Every document is scored from its whole text.  labels, lang, source and doc_id are no inputs of a score.  Defined
results: a null, empty or blank text has one empty window; repeated rows get equal scores; an empty table gives an
empty one; where no labelled rows of both classes exist the score is 0.5 and nothing is predicted toxic; of several
rows of one labelled doc_id one text is learnt from; extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import by_rows, held_out, rows_kept, stage, texts_of

WINDOW, STRIDE = 24, 12
WORD_SPACE, GRAM_SPACE = 1 << 14, 1 << 16
#: n-grams of bytes: all of ``SHORT`` to ``FULL``, and at the beginning of a word (blank included) to ``PREFIX``
SHORT, FULL, PREFIX = 3, 5, 12
DIM, HIDDEN, ATTEND = 4, 8, 8
INPUT = 3 * DIM
SIGNS = b".,;:!?\"'()[]{}|*#&$%"
VOCABULARY = 250_000
SCORE_WINDOWS = 4096


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of words, and where each word's begin; a blank marks either end of a word."""
    data = np.frombuffer(b" " + b" ".join(words) + b" " * PREFIX, np.uint8).astype(np.uint64) + np.uint64(1)
    sizes = np.array([len(w) for w in words])
    begin = np.cumsum(sizes + 1) - sizes - 1  # the blank before the word
    owner = np.repeat(np.arange(len(words)), sizes + 1)
    n = len(owner)
    inner = np.arange(n) - begin[owner]
    length = sizes[owner] + 2  # blanks included
    ids, owners = [], []
    hashed = np.zeros(n, np.uint64)
    at = np.arange(n)
    for k in range(PREFIX):
        if k == FULL:  # from here on beginnings only
            at = np.flatnonzero(inner == 0)
            hashed = hashed[at]
        hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + data[at + k]
        if k >= SHORT - 1:
            ok = (inner + k + 1 <= length)[at]
            x = hashed[ok] * np.uint64(0xBF58476D1CE4E5B9)
            ids.append(((x >> np.uint64(40)) & np.uint64(GRAM_SPACE - 1)).astype(np.int64))
            owners.append(owner[at[ok]])
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return ids[order], np.searchsorted(owners[order], np.arange(len(words)))


def bare_words(words) -> list[bytes]:
    """Words without signs at their ends; one of signs alone is a dash."""
    return [w.strip(SIGNS) or b"-" for w in words]


def word_ids(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words)).astype(np.int64) & (WORD_SPACE - 1)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def window_starts(n: int) -> range:
    """Starts of all windows of a text of n words; the last one reaches its end."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def parts_of(text: bytes) -> Iterator[bytes]:
    """Parts of up to ``VOCABULARY`` bytes, or of one window, that have the windows of the whole text between them."""
    words = words_of(text)
    starts = np.array(window_starts(len(words)))
    ends = np.minimum(starts + WINDOW, len(words))
    total = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words], dtype=np.int64)])
    i = 0
    while i < len(starts):
        to = max(i + 1, int(np.searchsorted(total[ends], total[starts[i]] + VOCABULARY, "right")))
        yield b" ".join(words[starts[i] : ends[to - 1]])
        i = to


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Parameters by name: word, gram: tables; wx, u, b per direction (f, r); wa, va, wo, bo."""

    p: dict[str, np.ndarray]

    @classmethod
    def start(cls, word_odds: np.ndarray, gram_odds: np.ndarray, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        small = lambda *s: rng.normal(0, 0.3 / np.sqrt(s[0]), s).astype(np.float32)
        p = {"word": rng.normal(0, 0.05, (WORD_SPACE, DIM)).astype(np.float32), "gram": rng.normal(0, 0.05, (GRAM_SPACE, DIM)).astype(np.float32)}
        p["word"][:, 0], p["gram"][:, 0] = 0.4 * word_odds, 0.4 * gram_odds
        for d in "fr":
            p |= {f"wx{d}": small(INPUT, 3 * HIDDEN) * 2, f"u{d}": small(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        p |= {"wa": small(2 * HIDDEN, ATTEND), "va": small(ATTEND), "wo": small(2 * HIDDEN), "bo": np.zeros(1, np.float32)}
        return cls(p)

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """Input vectors of distinct words, and what the gradient needs."""
        bare = bare_words(words)
        w = word_ids(bare)
        g, at = grams(bare)
        vectors = self.p["gram"][g]
        counts = np.diff(np.append(at, len(g)))[:, None].astype(np.float32)
        most = np.maximum.reduceat(vectors, at, axis=0)
        x = np.concatenate([self.p["word"][w], np.add.reduceat(vectors, at, axis=0) / counts, most], axis=1)
        return x.astype(np.float32), (w, g, at, vectors, counts, most)

    def gates(self, x: np.ndarray, d: str) -> np.ndarray:
        """Input part of the gates of each word; row 0 is for padding, whose update gate keeps the state."""
        out = np.zeros((len(x) + 1, 3 * HIDDEN), x.dtype)
        out[0, :HIDDEN] = 30
        out[1:] = x @ self.p[f"wx{d}"] + self.p[f"b{d}"]
        return out

    def run(self, xw: np.ndarray, index: np.ndarray, d: str, keep: bool = False):
        """States (window length x windows x HIDDEN) for gates of words and word numbers of windows."""
        h = np.zeros((index.shape[1], HIDDEN), np.float32)
        states, saved = np.empty((*index.shape, HIDDEN), np.float32), []
        u = self.p[f"u{d}"]
        for t in range(WINDOW) if d == "f" else reversed(range(WINDOW)):
            x = xw[index[t]]
            hu = h @ u
            zr = sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            if keep:
                saved.append((t, h, z, r, n, hu[:, 2 * HIDDEN :]))
            h = n + z * (h - n)
            states[t] = h
        return states, saved

    def pool(self, states: np.ndarray, live: np.ndarray):
        a = np.tanh(states @ self.p["wa"])
        e = np.where(live, a @ self.p["va"], -1e9)
        e = np.exp(e - e.max(axis=0, keepdims=True))
        share = e / e.sum(axis=0, keepdims=True)
        context = (share[:, :, None] * states).sum(axis=0)
        return context @ self.p["wo"] + self.p["bo"][0], (a, share, context)

    def logits(self, xf: np.ndarray, xr: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Logit of each window; index: window length x windows, word numbers from 1, 0 where a window is padded."""
        states = np.concatenate([self.run(xf, index, "f")[0], self.run(xr, index, "r")[0]], axis=2)
        return self.pool(states, index > 0)[0]

    def gradients(self, words: list[bytes], index: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, (w, g, at, vectors, counts, most) = self.inputs(words)
        states, saved, xw = {}, {}, {}
        for d in "fr":
            xw[d] = self.gates(x, d)
            states[d], saved[d] = self.run(xw[d], index, d, keep=True)
        both = np.concatenate([states["f"], states["r"]], axis=2)
        live = index > 0
        z, (a, share, context) = self.pool(both, live)
        dz = ((sigmoid(z) - y) * weight).astype(np.float32)
        out = {"wo": context.T @ dz, "bo": np.array([dz.sum()], np.float32)}
        dcontext = dz[:, None] * p["wo"]
        dshare = (both * dcontext).sum(axis=2)
        de = share * (dshare - (share * dshare).sum(axis=0))
        out["va"] = (a * de[:, :, None]).sum(axis=(0, 1))
        dpre = de[:, :, None] * p["va"] * (1 - a * a)
        out["wa"] = both.reshape(-1, 2 * HIDDEN).T @ dpre.reshape(-1, ATTEND)
        dboth = share[:, :, None] * dcontext + dpre @ p["wa"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fr"):
            dstates = dboth[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            u = p[f"u{d}"]
            dh, du, dgates = np.zeros((index.shape[1], HIDDEN), np.float32), np.zeros_like(u), np.zeros_like(xw[d])
            for t, h, zt, r, n, hun in reversed(saved[d]):
                dh = dh + dstates[t]
                dn = dh * (1 - zt) * (1 - n * n)
                dzt = dh * (h - n) * zt * (1 - zt)
                dr = dn * hun * r * (1 - r)
                dgate = np.concatenate([dzt, dr, dn], axis=1)
                dhu = np.concatenate([dzt, dr, dn * r], axis=1)
                np.add.at(dgates, index[t], dgate)
                du += h.T @ dhu
                dh = dh * zt + dhu @ u.T
            dgates = dgates[1:]
            out |= {f"u{d}": du, f"b{d}": dgates.sum(axis=0), f"wx{d}": x.T @ dgates}
            dx += dgates @ p[f"wx{d}"].T
        out["word"] = np.zeros_like(p["word"])
        np.add.at(out["word"], w, dx[:, :DIM])
        owner = np.repeat(np.arange(len(words)), counts[:, 0].astype(np.int64))
        dv = (dx[:, DIM : 2 * DIM] / counts)[owner] + dx[owner, 2 * DIM :] * (vectors == most[owner])
        out["gram"] = np.zeros_like(p["gram"])
        np.add.at(out["gram"], g, dv)
        return out


def fit(windows: list[list[bytes]], y: np.ndarray, network: Network, epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 9) -> Network:
    """Adam on the logistic loss, both classes weighted alike."""
    rng = np.random.default_rng(seed)
    share = np.clip(np.array([np.mean(y == 0), np.mean(y == 1)]), 0.02, 1)
    weight = np.where(y == 1, 0.5 / share[1], 0.5 / share[0]).astype(np.float32)
    m = {k: np.zeros_like(v) for k, v in network.p.items()}
    v = {k: np.zeros_like(x) for k, x in network.p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            words, index = number([windows[r] for r in rows])
            step += 1
            for k, g in network.gradients(words, index, y[rows], weight[rows] / len(rows)).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                network.p[k] = (network.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return network


def number(windows: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """Distinct words, and windows as columns of their numbers from 1; 0 is padding."""
    known: dict[bytes, int] = {}
    rows = [[known.setdefault(w, len(known) + 1) for w in window] for window in windows]
    words = list(known) or [b"-"]
    index = np.zeros((WINDOW, len(windows)), np.int64)
    for i, row in enumerate(rows):
        index[: len(row), i] = row
    return words, index


class Scorer:
    """Scores texts with a fitted network; the gate inputs of words already seen are kept, up to ``VOCABULARY``."""

    def __init__(self, network: Network):
        self.network = network
        self.forget()

    def forget(self):
        self.known: dict[bytes, int] = {}
        self.gates = {d: self.network.gates(np.zeros((0, INPUT), np.float32), d) for d in "fr"}
        self.used = 1  # row 0 is padding

    def learn(self, new: list[bytes]) -> None:
        x, _ = self.network.inputs(new)
        for d in "fr":
            if self.used + len(new) > len(self.gates[d]):
                room = np.empty((max(4096, 2 * (self.used + len(new))), 3 * HIDDEN), np.float32)
                room[: self.used] = self.gates[d][: self.used]
                self.gates[d] = room
            self.gates[d][self.used : self.used + len(new)] = self.network.gates(x, d)[1:]
        self.known.update(zip(new, range(self.used, self.used + len(new)), strict=True))
        self.used += len(new)

    def numbers(self, texts: list[bytes]) -> list[np.ndarray]:
        """Word numbers of each text."""
        split = [words_of(t) for t in texts]
        parts = [list(map(self.known.get, words)) for words in split]
        new = {w for words, part in zip(split, parts, strict=True) if None in part for w, i in zip(words, part, strict=True) if i is None}
        if len(self.known) + len(new) > VOCABULARY and self.known:
            self.forget()
            return self.numbers(texts)
        if new:
            self.learn(sorted(new))
        out = []
        for words, part in zip(split, parts, strict=True):
            out.append(np.array(list(map(self.known.__getitem__, words)) if None in part else part, np.int32))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The worst window's score of each text."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to]) <= VOCABULARY):
                size += len(texts[to])
                to += 1
            group = texts[at:to]
            if size > VOCABULARY:  # one huge text
                out.append(np.max([self._scores([part]) for part in parts_of(group[0])], axis=0))
            else:
                out.append(self._scores(group))
            at = to
        return np.concatenate(out) if out else np.empty(0)

    def _scores(self, texts: list[bytes]) -> np.ndarray:
        numbers = self.numbers(texts)
        first, count, flat = [], [], np.concatenate([*numbers, np.zeros(WINDOW, np.int32)])
        base = 0
        ends = []
        for n in numbers:
            starts = window_starts(len(n))
            first.append(np.arange(base, base + len(starts) * STRIDE, STRIDE))
            ends.append(np.full(len(starts), base + len(n)))
            count.append(len(starts))
            base += len(n)
        first, ends = np.concatenate(first), np.concatenate(ends)
        place = first[None, :] + np.arange(WINDOW)[:, None]
        index = np.where(place < ends[None, :], flat[np.minimum(place, len(flat) - 1)], 0)
        xf, xr = self.gates["f"], self.gates["r"]
        z = np.concatenate([self.network.logits(xf, xr, index[:, i : i + SCORE_WINDOWS]) for i in range(0, index.shape[1], SCORE_WINDOWS)])
        return sigmoid(np.maximum.reduceat(z, np.cumsum(count) - count).astype(np.float64))


def log_odds(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    return np.clip(odds * (pos + neg) / (pos + neg + 8), -4, 4).astype(np.float32)


def training_sample(docs: DataFrame, labels: DataFrame, train_rows: int, modulus: int, remainder: int) -> DataFrame:
    """text and y of at most ``train_rows`` rows of each class, with a number that splits off the calibration part."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    usable = usable.select("doc_id", F.col("toxic").cast("int").alias("y")).dropDuplicates(["doc_id"])
    one = lambda y: usable.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id")).limit(train_rows)
    sample = one(1).unionByName(one(0)).withColumn("apart", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(6)) == 0)
    held = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # one text an id, however many rows share it
    return held.groupBy("doc_id").agg(F.min_by(F.struct("text", "y", "apart"), F.xxhash64("text")).alias("r")).select("r.text", "r.y", "r.apart")


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 3000, modulus: int = 3, remainder: int = 1, threshold: float = 0.7) -> Network | None:
    sample = stage(training_sample(docs, labels, train_rows, modulus, remainder), "toxicity-sample")

    def frequencies(cols):
        counts = np.zeros((2, WORD_SPACE + GRAM_SPACE + 1), np.int32)
        for text, y in zip(texts_of(cols["text"]), cols["y"].to_pylist(), strict=True):
            words = bare_words(set(words_of(text))) or [b"-"]
            seen = np.unique(np.concatenate([word_ids(words), WORD_SPACE + grams(words)[0], [WORD_SPACE + GRAM_SPACE]]))
            counts[y, seen] += 1
        return {"counts": pa.array(counts.tolist(), pa.list_(pa.int32())), "y": pa.array([0, 1], pa.int32())}

    got = by_rows(sample.filter("NOT apart"), ["text", "y"], frequencies, "counts array<int>, y int").toArrow()
    counts = np.zeros((2, WORD_SPACE + GRAM_SPACE + 1), np.int64)
    for c, y in zip(got.column("counts").to_numpy(), got.column("y").to_pylist(), strict=True):
        counts[y] += c
    n_neg, n_pos = counts[:, -1].tolist()
    if not n_neg or not n_pos:
        return None
    odds = log_odds(counts[1, :-1], counts[0, :-1], n_pos, n_neg)
    network = Network.start(odds[:WORD_SPACE], odds[WORD_SPACE:])

    def suspicious(cols):
        out = {"y": [], "words": []}
        for text, y in zip(texts_of(cols["text"]), cols["y"].to_pylist(), strict=True):
            words = words_of(text)
            if not words:
                continue
            bare = bare_words(words)
            g, at = grams(bare)
            odd = np.maximum(np.maximum.reduceat(odds[WORD_SPACE:][g], at), odds[word_ids(bare)])
            total = np.concatenate([[0], np.cumsum(np.maximum(odd - 1, 0) ** 2)])
            starts = np.array(window_starts(len(words)))
            sums = total[np.minimum(starts + WINDOW, len(words))] - total[starts]
            picked = {int(starts[np.argmax(sums)])} | (set() if y else {int(starts[zlib.crc32(text) % len(starts)])})
            for s in sorted(picked):
                out["y"].append(y)
                out["words"].append(words[s : s + WINDOW])
        return {"y": pa.array(out["y"], pa.int32()), "words": pa.array(out["words"], pa.list_(pa.binary()))}

    rows = by_rows(sample.filter("NOT apart"), ["text", "y"], suspicious, "y int, words array<binary>").toArrow()
    y = np.array(rows.column("y").to_pylist(), np.float32)
    windows = rows.column("words").to_pylist()
    network = fit(windows, y, network)

    shared = sample.sparkSession.sparkContext.broadcast(network)

    def logits(cols):
        p = np.clip(Scorer(shared.value).scores(texts_of(cols["text"])), 1e-9, 1 - 1e-9)
        return {"y": cols["y"], "z": pa.array(np.log(p / (1 - p)), pa.float64())}

    apart = by_rows(sample.filter("apart"), ["text", "y"], logits, "y int, z double").toPandas()
    ones = apart.sort_values("z")
    if ones["y"].nunique() == 2:
        z, ones = ones["z"].to_numpy(), ones["y"].to_numpy()
        errors = np.concatenate([[0], np.cumsum(ones)]) + np.concatenate([np.cumsum((1 - ones)[::-1])[::-1], [0]])
        best = np.flatnonzero(errors == errors.min())
        mid = best[len(best) // 2]
        cut = (z[max(mid - 1, 0)] + z[min(mid, len(z) - 1)]) / 2
        network.p["bo"] = (network.p["bo"] + np.log(threshold / (1 - threshold)) - cut).astype(np.float32)
    return network


def score(docs: DataFrame, network: Network | None, modulus: int = 3, remainder: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    if network is None:
        scored = docs.select("doc_id", F.lit(0.5).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(network)
        holder: list[Scorer] = []

        def run(cols):
            if not holder:
                holder.append(Scorer(shared.value))
            return {"doc_id": cols["doc_id"], "score": pa.array(holder[0].scores(texts_of(cols["text"])), pa.float64())}

        scored = by_rows(docs, ["doc_id", "text"], run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, train_rows: int = 3000, threshold: float = 0.7) -> DataFrame:
    """The documents not predicted to be toxic, with all their columns."""
    network = train(docs, labels, train_rows)
    if network is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(network)
    holder: list[Scorer] = []

    def keep(cols):
        if not holder:
            holder.append(Scorer(shared.value))
        return holder[0].scores(texts_of(cols["text"])) < threshold

    return rows_kept(docs, keep)


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = 3000) -> DataFrame:
    return score(docs, train(docs, labels, train_rows))
