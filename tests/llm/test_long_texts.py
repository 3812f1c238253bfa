"""Texts over the byte bound of a batch of op9_toxicity get the scores of the texts unsplit."""

import random

import numpy as np
import pytest

from plumbline.llm import toxicity as T


@pytest.fixture(scope="module")
def network():
    rng = np.random.default_rng(3)
    return T.Network.start(rng.normal(0, 1, T.WORD_SPACE).astype(np.float32), rng.normal(0, 1, T.GRAM_SPACE).astype(np.float32))


def _words(n, size, seed=1):
    rng = random.Random(seed)
    known = [bytes(rng.choices(b"abcdefghij", k=size)) for _ in range(500)]
    return rng.choices(known, k=n)


TEXTS = {
    "300 KB": b" ".join(_words(50_000, 5)),
    "over 125,016 words": b" ".join(_words(130_003, 2)),
    "giant word": b"x" * 300_000,
    "giant word between others": b" ".join([*_words(3_000, 5), b"ab" * 150_000, *_words(3_000, 5, 2)]),
    "blank": b" " * 300_000,
}


@pytest.mark.parametrize("name", TEXTS)
def test_a_long_text_scores_as_unsplit(network, monkeypatch, name):
    text = TEXTS[name]
    assert len(text) > T.VOCABULARY
    got = T.Scorer(network).scores([b"few words", text, b"other words"])
    monkeypatch.setattr(T, "VOCABULARY", 10**9)
    expected = np.concatenate([T.Scorer(network).scores([t]) for t in (b"few words", text, b"other words")])
    assert np.allclose(got, expected, atol=1e-6)


@pytest.mark.parametrize("at", [0, 12, 24, 31_237, 62_507, 129_979, 130_002])
def test_the_worst_window_is_found_wherever_it_is(network, monkeypatch, at):
    words = [b"ab"] * 130_003
    words[at] = b"rare" * 3
    text = b" ".join(words)
    got = T.Scorer(network).scores([text])
    monkeypatch.setattr(T, "VOCABULARY", 10**9)
    assert np.allclose(got, T.Scorer(network).scores([text]), atol=1e-6)


@pytest.mark.parametrize("size", [249_999, 250_001, 1_000_000, 5_000_000])
def test_sizes_around_the_bound_score_as_their_windows(network, size):
    """Every window cut out of the list of words, without the scorer's splitting."""
    rng = random.Random(size)
    known = [bytes(rng.choices(b"abcdefghij", k=rng.randint(1, 9))) for _ in range(3000)]
    words, total = [], 0
    while total < size:
        words.append(rng.choice(known))
        total += len(words[-1]) + 1
    text = b" ".join(words)[:size]
    words = text.split()
    numbers, index = T.number([words[s : s + T.WINDOW] for s in range(0, len(words), T.STRIDE) if s == 0 or s + T.WINDOW - T.STRIDE < len(words)])
    x, _ = network.inputs(numbers)
    gates = [network.gates(x, d) for d in "fr"]
    worst = max(float(network.logits(*gates, index[:, i : i + 4096]).max()) for i in range(0, index.shape[1], 4096))
    assert len(text) == size and np.allclose(T.Scorer(network).scores([text]), T.sigmoid(np.float64(worst)), atol=1e-6)


def test_the_stage_keeps_and_drops_huge_texts(spark, network, monkeypatch):
    """A window that is toxic is found in a text of a megabyte, by the operator and by the stage of the pipeline."""
    made = T.Network({k: v.copy() for k, v in network.p.items()})
    made.p["word"][:], made.p["gram"][:] = 0, 0
    made.p["word"][T.word_ids([b"vile"])[0]] = 5
    z = lambda text: float(np.log(1 / (1 / T.Scorer(made).scores([text])[0] - 1)))
    quiet, loud = z(b"calm words " * 12), z(b"vile " * 24)
    made.p["wo"] = made.p["wo"] * np.float32(10 / (loud - quiet))  # whichever way the random network marks it
    made.p["bo"] = (made.p["bo"] - (z(b"calm words " * 12) + z(b"vile " * 24)) / 2 + np.log(0.7 / 0.3)).astype(np.float32)
    monkeypatch.setattr(T, "train", lambda *_: made)
    rows = [(1, "calm words " * 60_000), (2, "calm words " * 55_000 + "vile " * 48 + "calm words " * 5_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in T.score(docs, made).collect()} == {1: 0, 2: 1}
    assert [r.doc_id for r in T.clean_documents(docs, docs).collect()] == [1]
