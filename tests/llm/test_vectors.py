"""Operators 1 and 7 against brute force."""

import numpy as np
import pytest

VECTOR = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(700):
        v = rng.normal(size=16)
        if i % 3 == 0 and rows:  # close to an earlier one
            v = np.array(rows[int(rng.integers(len(rows)))][1]) + rng.normal(size=16) * 0.12
        rows.append((i, v.astype(np.float32).tolist(), int(i % 4)))
    rows += [(700 + i, rows[5][1], rows[5][2]) for i in range(120)]  # a group of copies
    zero = [0.0] * 16
    odd = [None, [], zero, [None] * 16, [NAN] * 16, [INF] + zero[1:], rows[7][1]]
    rows += [(900 + i, v, 3 if i < 6 else None) for i, v in enumerate(odd)]
    rows += [(None, rows[9][1], rows[9][2]), (950, rows[9][1][:8], 1), (11, rows[11][1], rows[11][2])]
    return rows


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v)


def brute_links(rows):
    n = len(rows)
    links = [set() for _ in range(n)]
    ok = [usable(r[1]) and any(r[1]) and r[2] is not None for r in rows]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.float64) for k in (i, j))
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.93:
                    links[i].add(j)
                    links[j].add(i)
    root = list(range(n))
    changed = True
    key = lambda k: (rows[k][0] is None, rows[k][0] if rows[k][0] is not None else 0)
    while changed:
        changed = False
        for i in range(n):
            best = min([root[i], *(root[j] for j in links[i])], key=key)
            if best != root[i]:
                root[i], changed = best, True
    out = []
    for i, r in enumerate(rows):
        component = None if r[0] is None else rows[root[i]][0]
        out.append((r[0], len(links[i]), component, r[0] == component))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "fan"), [(64, 256), (20, 3), (4096, 256)])
def test_near_duplicates_are_those_of_brute_force(spark, vectors, block, fan):
    from plumbline.llm.embedding_dedup import near_duplicates

    from pyspark.sql import functions as F

    df = spark.createDataFrame(vectors, VECTOR).withColumns({c: F.lit("x") for c in ("cls", "n", "cell", "side", "component_id")})
    got = near_duplicates(df, block=block, fan=fan).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute_links(vectors)


def test_estimates_are_unbiased_and_bounds_hold():
    from plumbline.llm.embedding_dedup import codes, least_estimate

    rng = np.random.default_rng(1)
    a = rng.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * side
    _, signs, factor = codes(a)
    estimate = (signs * codes(b)[0]).sum(axis=1) / factor
    assert abs(estimate.mean() - 0.93) < 0.01
    assert (estimate >= least_estimate(factor, 64, 0.93)).all()


def test_no_vectors(spark):
    from plumbline.llm.embedding_dedup import near_duplicates
    from plumbline.llm.top_k import top_k

    none = spark.createDataFrame([], VECTOR)
    assert near_duplicates(none).count() == 0
    assert top_k(none).count() == 0


@pytest.mark.parametrize(("block", "fan"), [(50, 256), (20, 3), (8192, 256)])
def test_top_k_is_that_of_brute_force(spark, vectors, block, fan):
    from plumbline.llm.top_k import top_k

    got = top_k(spark.createDataFrame(vectors, VECTOR), every=50, block=block, fan=fan).collect()
    whole = [(r[0], np.floor(np.array(r[1], np.float64) * 256)) for r in vectors if r[0] is not None and usable(r[1])]
    expected = []
    for q, v in whole:
        if q % 50 == 0:
            scored = sorted((-int(v @ x), i) for i, x in whole if i != q and len(x) == len(v))[:5]
            expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    assert sorted(map(tuple, got)) == sorted(expected)


@pytest.fixture(scope="module")
def clustered():
    """Vectors around 40 centres, with clusters of one vector and of many equal ones."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24)) * 3
    x = centres[rng.integers(40, size=3000)] + rng.normal(size=(3000, 24)) * 0.1
    x[2000:2300] = x[7]
    return [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]


def test_clusters_are_pruned_and_nothing_is_lost(spark, clustered):
    from plumbline.llm.top_k import scored_share, top_k

    df = spark.createDataFrame(clustered, VECTOR)
    got = sorted(map(tuple, top_k(df, block=300).collect()))
    whole = np.floor(np.array([r[1] for r in clustered], np.float32).astype(np.float64) * 256)
    expected = []
    for q in range(0, 3000, 50):
        score = (whole @ whole[q]).astype(np.int64)
        score[q] = -(1 << 62)
        best = np.lexsort((np.arange(3000), -score))[:5]
        expected += [(q, r, int(i), int(score[i])) for r, i in enumerate(best, 1)]
    assert got == sorted(expected)
    assert scored_share(df, block=300) < 0.3


def test_cover_tree_invariants_and_search():
    from plumbline.llm.top_k import CoverTree, search

    rng = np.random.default_rng(8)
    for x in (rng.normal(size=(700, 8)), np.repeat(rng.normal(size=(9, 8)), 50, axis=0), np.zeros((40, 8)), np.exp(rng.normal(size=(300, 1)) * 3) * np.ones((1, 8))):
        x = np.floor(x * 256)
        tree = CoverTree(x, 8)
        assert sorted(tree.order) == list(range(len(x)))
        for n in range(len(tree.centre)):
            inside = x[tree.order[tree.low[n] : tree.high[n]]]
            assert (np.linalg.norm(inside - x[tree.centre[n]], axis=1) <= tree.radius[n] + 1e-9).all()
            below = range(tree.first[n], tree.first[n] + tree.many[n])
            if below:
                assert [tree.low[c] for c in below][0] == tree.low[n] and [tree.high[c] for c in below][-1] == tree.high[n]
                c = x[tree.centre[list(below)]]
                apart = np.linalg.norm(c[:, None] - c[None], axis=2)[~np.eye(len(c), dtype=bool)]
                assert (tree.radius[list(below)] <= tree.cover[n] * (1 + 1e-9) + 1e-9).all() and (apart >= tree.cover[n] - 1e-9).all()
                assert tree.cover[n] <= tree.radius[n] / 1.3 + 1e-9
        q, ids = x[::7] + 1, np.arange(0, len(x), 7)
        best, scored = search(q, ids, np.full(len(q), -np.inf), x, np.arange(len(x)), 5)
        for row, i in enumerate(ids):
            score = x @ q[row]
            score[i] = -np.inf
            want = np.lexsort((np.arange(len(x)), -score))[: min(5, len(x) - 1)]
            assert best.id[row].tolist()[: len(want)] == want.tolist() and (scored[row] <= len(x))


def test_codes_are_stored_once(spark):
    """Packed codes and factors of the table are those of the vectors, whatever their lengths."""
    from plumbline.llm.embedding_dedup import coded, codes

    rng = np.random.default_rng(9)
    rows = [(i, d, 1, d, rng.normal(size=d).tolist()) for i, d in enumerate([5, 16, 64, 16, 1, 64])]
    for r in coded(spark.createDataFrame(rows, "id long, grp long, n long, dim int, v array<double>")).collect():
        v = np.array(r.v)
        turned, _, factor = codes(v[None] / np.linalg.norm(v))
        assert np.unpackbits(np.frombuffer(r.code, np.uint8), count=r.dim).tolist() == (turned[0] > 0).astype(int).tolist()
        assert r.factor == pytest.approx(factor[0])


def test_the_table_of_the_driver(spark):
    from plumbline.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = QUERIES["op1_embedding_near_dedup"](spark, sf).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute_links(rows)


def test_of_repeated_askers_the_smallest_vector_asks(spark):
    from plumbline.llm.top_k import top_k

    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [0.5, 9.0]), (3, [4.0, -1.0])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2, scale=256.0, every=50).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(50, 1, 2, 256 * 256 * 9), (50, 2, 1, 256 * 256 * 3)]
