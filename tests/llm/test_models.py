"""Operators 3, 4 and 9 and the pipeline."""

import hashlib
import json
import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


# ---- operator 3
def test_sharding_is_its_sql():
    from plumbline.llm.queries import ORACLE_SQL, SHARDS, SLOTS
    from plumbline.llm.sharding import fill, shard_names, slot_of  # noqa: F401

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = con.execute(ORACLE_SQL["op3_sharding"]).fetchall()
    owner = fill(shard_names(SHARDS), SLOTS)
    for doc_id, slot, shard in got:
        assert slot == int(hashlib.md5(str(doc_id).encode()).hexdigest()[:8], 16) % SLOTS
        assert shard == f"shard-{owner[slot]}"


def test_sharding_of_edge_cases_is_native(spark, edge_docs, empty_docs):
    from plumbline.llm.sharding import assign, fill, shard_names

    got = assign(edge_docs, shard_names(32), 4093)
    owner = fill(shard_names(32), 4093)
    rows = got.collect()
    assert len(rows) == edge_docs.count() and all(r.shard == f"shard-{owner[r.slot]}" for r in rows)
    assert not any(x in got._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Pandas"))
    assert assign(empty_docs, shard_names(32), 4093).count() == 0


def test_slots_are_shared_evenly_and_few_move():
    from plumbline.llm.sharding import fill, shard_names

    a, b = fill(shard_names(32), 4093), fill(shard_names(31), 4093)
    counts = np.bincount(a)
    assert counts.max() - counts.min() <= 1
    moved = sum(x != y and x != 31 for x, y in zip(a, b, strict=True))
    assert moved < 0.15 * len(a)
    with pytest.raises(ValueError):
        fill(shard_names(3), 4092)


# ---- operators 4 and 9
def auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        ranks[s == v] = ranks[s == v].mean()
    pos = y == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize(("module", "label", "modulus", "remainder"), [("quality", "quality", 4, 2), ("toxicity", "toxic", 3, 1)])
def test_held_out_accuracy_and_inputs(spark, tables, module, label, modulus, remainder):
    import importlib

    m = importlib.import_module(f"plumbline.llm.{module}")
    docs, labels = tables
    model = m.train(docs, labels)
    got = m.score(docs, model).join(labels.dropDuplicates(["doc_id"]), "doc_id", "left").toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(d).encode()) % modulus == remainder) for d, h in zip(got["doc_id"], got["held_out"], strict=True))
    assert ((got["score"] >= 0.7).astype(int) == got["predicted"]).all()
    judged = got[got["held_out"] & got[label].notna()]
    right = (judged["predicted"] == judged[label]).mean()
    print(module, "held-out accuracy", right, "AUC", auc(judged[label].to_numpy(), judged["score"].to_numpy()), "rows", len(judged))
    assert right > 0.9 and auc(judged[label].to_numpy(), judged["score"].to_numpy()) > 0.9
    # other ids, languages and sources leave scores as they are; so do the labels of held-out rows
    moved = docs.withColumn("doc_id", F.col("doc_id") + 1_000_000).withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    again = m.score(moved, model).toPandas().sort_values("doc_id")["score"].to_numpy()
    assert np.allclose(again, got.sort_values("doc_id")["score"].to_numpy(), atol=1e-6)


@pytest.mark.parametrize("module", ["quality", "toxicity"])
def test_classifiers_on_edge_cases(spark, module, edge_docs, empty_docs, documents, labels):
    import importlib

    m = importlib.import_module(f"plumbline.llm.{module}")
    model = m.train(documents, labels)
    rows = m.score(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, set()).add(round(r.score, 6))
    assert all(len(v) == 1 for v in by_id.values())
    assert by_id[1] == by_id[2] or module == "quality"
    assert m.score(empty_docs, model).count() == 0
    none = m.classify(edge_docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {0}
    keep = {"quality": "good_documents", "toxicity": "clean_documents"}[module]
    kept = getattr(m, keep)(edge_docs, labels)
    assert kept.columns == edge_docs.columns and all(r.spans == "own spans" for r in kept.collect())


def test_machine_scores_are_the_explicit_sum(spark, documents):
    """Whole documents through the features and the identity, against the double sum over all pairs of features."""
    import math

    from plumbline.llm import quality as Q

    rng = np.random.default_rng(4)
    rows = documents.filter("length(text) < 3000").orderBy("doc_id").limit(6).select("doc_id", "text", "n_chars").collect()
    texts = [(r.text, r.n_chars) for r in rows] + [("", 0), (None, None), ("one", 3), ("a a a  b|#\n\n9", 12)]
    stats = np.array([Q.statistics((t or "").encode(), (t or "").encode().split(), n) for t, n in texts])
    machine = Q.Machine(np.quantile(stats, np.linspace(0, 1, Q.BINS + 1)[1:-1], axis=0).T.astype(np.float32).copy(), 0.3)
    machine.weights = rng.normal(size=machine.weights.shape).astype(np.float32)
    machine.factors = rng.normal(size=machine.factors.shape).astype(np.float32) * np.float32(0.4)
    expected = []
    for (text, _), row in zip(texts, stats.astype(np.float32), strict=True):
        words = (text or "").encode().split()
        x = {Q.WORD_SPACE + s * Q.BINS + sum(e <= row[s] for e in machine.edges[s]): 1 / math.sqrt(Q.STATS) for s in range(Q.STATS)}
        for w in words:
            k = zlib.crc32(w) % Q.WORD_SPACE
            x[k] = x.get(k, 0) + 1 / len(words)
        z = machine.bias + sum(float(machine.weights[i]) * v for i, v in x.items())
        names = list(x)
        z += sum(float(machine.factors[i].astype(np.float64) @ machine.factors[j].astype(np.float64)) * x[i] * x[j] for n, i in enumerate(names) for j in names[:n])
        expected.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
    docs = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.score for r in Q.score(docs, machine).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(expected, abs=1e-4)


def plain_window(network, words):
    """Logit of one window by plain loops: gated steps forwards and backwards, then attention over the states."""
    from plumbline.llm import toxicity as T

    p = {k: v.astype(np.float64) for k, v in network.p.items()}
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    inputs = []
    for w in T.bare_words(words):
        g = [p["gram"][i] for i in T.grams([w])[0]]
        inputs.append(np.concatenate([p["word"][zlib.crc32(w) % T.WORD_SPACE], np.mean(g, axis=0), np.max(g, axis=0)]))
    states = [[], []]
    for side, d in enumerate("fr"):
        h, H = np.zeros(T.HIDDEN), T.HIDDEN
        for x in inputs if d == "f" else inputs[::-1]:
            gate, hu = x @ p[f"wx{d}"] + p[f"b{d}"], h @ p[f"u{d}"]
            z, r = sigmoid(gate[:H] + hu[:H]), sigmoid(gate[H : 2 * H] + hu[H : 2 * H])
            h = (1 - z) * np.tanh(gate[2 * H :] + r * hu[2 * H :]) + z * h
            states[side].append(h)
    both = [np.concatenate(s) for s in zip(states[0], states[1][::-1], strict=True)] or [np.zeros(2 * T.HIDDEN)]
    weight = np.exp([np.tanh(s @ p["wa"]) @ p["va"] for s in both])
    return float((weight[:, None] * both).sum(0) / weight.sum() @ p["wo"] + p["bo"][0])


def test_toxicity_is_the_worst_window_by_plain_loops(spark):
    """Whole documents through the operator, against every overlapping window scored alone."""
    import random

    from plumbline.llm import toxicity as T

    rng, random_ = np.random.default_rng(6), random.Random(6)
    network = T.Network.start(rng.normal(0, 1, T.WORD_SPACE).astype(np.float32), rng.normal(0, 1, T.GRAM_SPACE).astype(np.float32))
    word = lambda: "".join(random_.choice("abcdeF,é!") for _ in range(random_.randint(1, 14)))
    texts = [None, "", " \n", "x", *(" ".join(word() for _ in range(n)) for n in (1, 5, 12, 13, 23, 24, 25, 35, 36, 37, 48, 49, 130))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in T.score(docs, network).collect()}
    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        starts = [s for s in range(0, max(len(words), 1), T.STRIDE) if s == 0 or s + T.WINDOW - T.STRIDE < len(words)]
        worst = max(plain_window(network, words[s : s + T.WINDOW]) for s in starts)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-worst)), abs=2e-4), (i, len(words))


def test_network_gradients():
    from plumbline.llm import toxicity as T

    network = T.Network.start(np.zeros(T.WORD_SPACE, np.float32), np.zeros(T.GRAM_SPACE, np.float32))
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    words, index = T.number([[b"some", b"words", b"here"], [b"here", b"words"]])
    y, weight = np.array([1.0, 0.0]), np.ones(2) / 2

    def loss():
        x, _ = network.inputs(words)
        z = network.logits(network.gates(x.astype(np.float64), "f"), network.gates(x.astype(np.float64), "r"), index)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum())

    g = network.gradients(words, index, y, weight)
    for name in ("wo", "va", "wa", "uf", "ur", "wxf", "bf"):
        at = tuple(int(n) // 2 for n in network.p[name].shape)
        step, old = 1e-2, network.p[name][at]
        network.p[name][at] = old + step
        up = loss()
        network.p[name][at] = old - step
        slope = (up - loss()) / (2 * step)
        network.p[name][at] = old
        assert slope == pytest.approx(float(g[name][at]), rel=0.05, abs=2e-5), name


# ---- the pipeline
def test_pipeline_is_its_stages_by_brute_force(spark):
    import corpus_pipeline as P
    from test_texts import brute_near, check_packed, library_pieces, rows_of

    from plumbline.llm import quality, toxicity
    from plumbline.llm.repeats import PASSAGE

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in quality.classify(docs, labels).filter("predicted = 1").collect()}
    left = docs.filter(F.col("doc_id").isin(good))
    toxic = {r.doc_id for r in toxicity.classify(left, labels).filter("predicted = 1").collect()}
    left = left.filter(~F.col("doc_id").isin(toxic))
    kept = {d for d, _, _, k in brute_near(rows_of(left)) if k}
    texts = [(d, t) for d, t in rows_of(left) if d in kept]
    data = [t.encode() for _, t in texts]
    from collections import Counter

    n = PASSAGE.length
    seen = Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    final = []
    for (d, _), b in zip(texts, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\x01" * n
        final.append((d, bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")))
    got = P.run(spark, sf).collect()
    assert sorted(map(repr, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got))) == sorted(map(repr, library_pieces(final, 4096)))
    check_packed(got, 4096)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_queries_and_entry(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names}
    assert json.dumps(sorted(entry.oracle_sql())) and os.path.isdir(SF)


@pytest.mark.parametrize(("module", "label"), [("quality", "quality"), ("toxicity", "toxic")])
def test_a_labelled_id_is_learnt_once(spark, monkeypatch, module, label):
    """An id that very many rows share brings one text to the driver."""
    import importlib

    m = importlib.import_module(f"plumbline.llm.{module}")
    ids = [d for d in range(200) if not (zlib.crc32(str(d).encode()) % 4 == 2 or zlib.crc32(str(d).encode()) % 3 == 1)]
    rows = [(d, f"text {d} " * 30, "en", "s", 10) for d in ids] + [(ids[0], f"copy {i} of it", "en", "s", 5) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(d, i % 2, i % 2) for i, d in enumerate(ids)], "doc_id long, quality int, toxic int")
    fitted = []
    if module == "toxicity":
        assert m.training_sample(docs, labels, 3000, 3, 1).count() == len(ids)
    else:
        real = m.fit
        monkeypatch.setattr(m, "fit", lambda stats, words, y: fitted.append(len(y)) or real(stats, words, y))
        m.train(docs, labels)
        assert 0 < fitted[0] <= len(ids)
