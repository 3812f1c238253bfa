"""Vocabulary, inverted file and loop pairs against plain loops."""

import math
from collections import Counter

import numpy as np
import pytest

from plumbline.operators import retrieval

DESCRIPTOR = "image_id long, descriptor array<double>"


@pytest.fixture(scope="module")
def places():
    """Forty images of ten places: images of a place have descriptors near the same twenty spots."""
    rng = np.random.default_rng(5)
    spots = rng.normal(size=(10, 20, 6)) * 4
    return [(i, (spots[i % 10][j] + 0.05 * rng.normal(size=6)).tolist()) for i in range(40) for j in range(20)]


def plain_scores(words):
    images = {}
    for i, w in words:
        images.setdefault(i, Counter())[w] += 1
    having = Counter(w for c in images.values() for w in c)
    weight = {i: {w: n * math.log(len(images) / having[w]) for w, n in c.items() if having[w] < len(images)} for i, c in images.items()}
    length = {i: math.sqrt(sum(v * v for v in c.values())) or 1.0 for i, c in weight.items()}
    return {(a, b): round(sum(weight[a][w] * weight[b][w] for w in weight[a].keys() & weight[b].keys()) / length[a] / length[b], 9) for a in weight for b in weight if a < b and weight[a].keys() & weight[b].keys()}


def test_words_are_nearest_centres_level_by_level(spark, places):
    df = spark.createDataFrame([*places, (99, None), (98, [float("nan")] * 6)], DESCRIPTOR)
    v = retrieval.fit_vocabulary(df, branching=4, depth=3, sample_rows=500)
    assert v.words == 64 and [c.shape for c in v.centres] == [(1, 4, 6), (4, 4, 6), (16, 4, 6)]
    got = sorted(map(tuple, retrieval.words_of(df, v).collect()))
    want = []
    for i, d in places:
        node = 0
        for c in v.centres:
            apart = [math.inf if np.isnan(x).any() else float(((x - np.array(d)) ** 2).sum()) for x in c[node]]
            node = node * 4 + int(np.argmin(apart))
        want.append((i, node))
    assert got == sorted(want)
    again = retrieval.fit_vocabulary(df.repartition(7), branching=4, depth=3, sample_rows=500)
    assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(v.centres, again.centres, strict=True))


@pytest.mark.parametrize("block", [3, 1024])
def test_scores_are_those_of_plain_loops(spark, block):
    rng = np.random.default_rng(9)
    words = [(int(i), int(w)) for i in range(30) for w in rng.zipf(1.6, 12) if w < 60] + [(i, 0) for i in range(30)] + [(77, 0)]
    index = retrieval.inverted_file(spark.createDataFrame([*words, (None, 3), (4, None)], "image_id long, word long"))
    assert index.filter("word = 0").count() == 0 and index.filter("image_id = 77").count() == 0  # all images have word 0
    got = {(r.id_a, r.id_b): r.score for r in retrieval.scored_pairs(index, block).collect()}
    assert got == pytest.approx(plain_scores(words), abs=2e-9)
    top = {}
    for r in retrieval.retrieved(index, 3, block).collect():
        top.setdefault(r.image_id, []).append((r["rank"], r.found_id))
    for i, found in top.items():
        every = sorted((-s, b if a == i else a) for (a, b), s in got.items() if i in (a, b))
        assert [x for _, x in sorted(found)] == [x for _, x in every[:3]]


def test_images_of_one_place_are_found(spark, places):
    df = spark.createDataFrame(places, DESCRIPTOR)
    index = retrieval.inverted_file(retrieval.words_of(df, retrieval.fit_vocabulary(df, branching=6, depth=3)))
    found = retrieval.retrieved(index, 3).collect()
    assert sum(r.found_id % 10 == r.image_id % 10 for r in found) / (40 * 3) > 0.95  # each place has three more images
    names = spark.createDataFrame([(i % 2, i, f"n{i:03d}") for i in range(40)], "scene int, image_id long, name string")
    pairs = {tuple(r) for r in retrieval.loop_pairs(names, index, ["scene"], 2, 3).collect()}
    near = {(s, i, j) for s in (0, 1) for i in range(s, 40, 2) for j in (i + 2, i + 4) if j < 40}
    loops = {(a % 2, a, b) for a in range(40) for b in range(a + 1, 40) if a % 10 == b % 10}
    assert near <= pairs and len(loops & pairs) >= 0.95 * len(loops) and all((a - b) % 2 == 0 for _, a, b in pairs)
