"""Operators 11, 12 and 13 against their SQL on the driver's documents and against plain loops on edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in ("documents", "labels", "benchmark"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op11_filter_interaction_audit", "op12_line_dedup", "op13_importance_resampling"])
def test_query_is_its_sql(spark, con, name):
    from plumbline.llm.queries import ORACLE_SQL, QUERIES

    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


# ---- operator 11
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fails_of(rows):
    """Filters failed by each (doc_id, text) by plain statements."""
    out = []
    for doc_id, text in rows:
        text = text or ""
        words = WORDS.findall(text)
        f = set()
        if len(words) < 50:
            f.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
            f.add("C")
        if re.search(r"[#$%&*|]", text):
            f.add("D")
        if doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t in rows):
            f.add("E")
        out.append(f)
    return out


def brute_audit(rows, labels):
    """Every order applied filter by filter to lists of documents."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails = fails_of([(d, t) for d, _, t in rows])
    parts = defaultdict(list)
    for (d, source, _), f in zip(rows, fails, strict=True):
        parts[source or ""].append((d, f))
    out = []
    for part, docs in parts.items():
        total = Counter()
        mine = []
        for order in permutations("ABCDE"):
            left = list(docs)
            for step, x in enumerate(order, 1):
                gone = [(d, f) for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                total[x] += len(gone)
                redundant = sum(x in f for _, f in docs) - len(gone)
                unique = sum(f == {x} for _, f in docs)
                mine.append((part, "".join(order), step, len(left), len(gone), redundant, unique, sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)))
        out += [(*m, total[m[1][m[2] - 1]]) for m in mine]
    return sorted(out)


def audit_case():
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, None), (2, "", ""), (3, "a", long), (4, "a", long), (4, "a", long), (None, "a", long), (2, "b", long), (5, "b", "A B C"), (6, "b", "x " * 80), (7, "b", "x " * 80 + "#"), (8, "a", "ÀÉ " * 60)]
    rows += [(9, None, long + " X"), (10, "a", "|" + long), (11, "b", "S" + long), (None, None, None)]
    labels = [(3, 1, 0), (4, 1, 1), (4, 0, None), (5, None, 1), (7, 1, 1), (None, 1, 1), (2, 1, 0)]
    return rows, labels


def test_audit_is_filtering_in_every_order(spark):
    from plumbline.llm.filter_audit import filter_audit

    rows, labels = audit_case()
    docs = spark.createDataFrame([(d, t, s) for d, s, t in rows], "doc_id long, text string, source string")
    docs = docs.select("*", *(F.lit("own").alias(c) for c in ("part", "mask", "h1", "n", "good", "toxic", "is_first", "step")))
    got = filter_audit(docs, spark.createDataFrame(labels, LABELS))
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, labels)


def test_audit_of_empty_tables(spark, empty_docs):
    from plumbline.llm.filter_audit import filter_audit

    assert filter_audit(empty_docs, spark.createDataFrame([], LABELS)).collect() == []


def test_polynomial_corners_and_shapley():
    from plumbline.llm.filter_audit import corner, removal_polynomial, shapley

    counts = {m: (m * 7919) % 101 for m in range(32)}
    polynomial = removal_polynomial(counts, 5)
    for s in range(32):
        assert corner(polynomial, s) == sum(n for m, n in counts.items() if m & s)
    for i in range(5):
        summed = sum(corner(polynomial, sum(1 << j for j in o[: o.index(i) + 1])) - corner(polynomial, sum(1 << j for j in o[: o.index(i)])) for o in permutations(range(5)))
        assert shapley(polynomial, i) * 120 == summed
    assert sum(shapley(polynomial, i) for i in range(5)) == corner(polynomial, 31)


# ---- operator 12
def brute_lines(rows, min_docs, min_chars, keep_first=False):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\f\r"))
    holders, places = defaultdict(set), defaultdict(list)
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            holders[key(line)].add((d, t or ""))
            places[key(line)].append((d, i))
    gone = {k for k, v in holders.items() if len(v) >= min_docs and len(k) >= min_chars}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        drop = [key(x) in gone and not (keep_first and min(places[key(x)]) == (d, i)) for i, x in enumerate(lines)]
        kept = "\n".join(x for x, g in zip(lines, drop, strict=True) if not g)
        out.append((d, len(lines), sum(drop), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def lines_case():
    boiler = "  Shared LINE  "
    rows = [(i, f"own {i}\n{boiler}\n\n{'x' * (i % 3)}\nÉcole\r") for i in range(40)]
    rows += [(100 + i, "\n".join([boiler.strip().lower()] * 150 + [f"only {i}"] * 3 + ["other"] * (i < 3))) for i in range(6)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (0, "own 0\nagain"), (203, "\n".join(f"long {i % 977}" for i in range(5000)))]
    rows += [(204, "\n".join(f"long {i % 977}" for i in range(3000))), (205, "école\r\nshared line")]
    return rows


@pytest.mark.parametrize(("min_docs", "min_chars"), [(10, 1), (2, 1), (2, 0), (3, 8), (1, 1)])
@pytest.mark.parametrize("share", [4096, 8])
def test_lines_against_plain_loops(spark, monkeypatch, min_docs, min_chars, share):
    from plumbline.llm import line_dedup

    monkeypatch.setattr(line_dedup, "SHARE", share)
    rows = lines_case()
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(1).alias(c) for c in ("did", "th", "pos", "h1", "words", "line", "key", "n_dropped")))
    assert sorted(map(tuple, line_dedup.line_digest(docs, min_docs, min_chars).collect()), key=repr) == brute_lines(rows, min_docs, min_chars)


@pytest.mark.parametrize("share", [4096, 8])
def test_first_lines_may_stay(spark, monkeypatch, share):
    from plumbline.llm import line_dedup

    monkeypatch.setattr(line_dedup, "SHARE", share)
    rows = [r for r in lines_case() if r[0] != 0]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.with_kept_text(docs, line_dedup.keep_bitmaps(docs, 2, 1, keep_first=True)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))
    assert sorted(map(tuple, found.collect()), key=repr) == brute_lines(rows, 2, 1, keep_first=True)


def test_lines_of_edge_cases_are_native(spark, edge_docs, empty_docs, edge_rows):
    from plumbline.llm.line_dedup import dropped_lines, keep_bitmaps, line_digest

    got = line_digest(edge_docs, 2)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_lines([(r[0], r[1]) for r in edge_rows], 2, 1)
    for df in (got, dropped_lines(edge_docs), keep_bitmaps(edge_docs)):
        assert not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Pandas"))
    assert line_digest(empty_docs).collect() == []


def test_ranges_are_dealt_once(spark):
    """The pass that streams first occurrences runs on the ranges as they were dealt: no second exchange by hash."""
    from plumbline.llm.line_dedup import dropped_lines

    plan = dropped_lines(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning" not in plan


# ---- operator 13
def brute_resample(docs, target, longest, buckets, min_words, percent, seed):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    features = lambda w: [b" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    words = [split(t) for _, t in docs]
    s, t = (Counter(zlib.crc32(f) % buckets for w in some for f in features(w)) for some in (words, [split(x) for x in target]))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for (d, _), w in zip(docs, words, strict=True):
        f = features(w)
        weight = sum(gain[zlib.crc32(x) % buckets] for x in f)
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([d, len(f), weight, score, None, len(w)])
    may = sorted((r for r in rows if r[5] >= min_words and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for i, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize(("longest", "buckets", "min_words", "percent"), [(1, 10_000, 20, 10), (3, 97, 2, 50), (2, 10_000, 0, 100)])
def test_resampling_against_plain_loops(spark, edge_docs, edge_rows, longest, buckets, min_words, percent):
    from plumbline.llm.resampling import resample

    target = [("one two words",), (None,), ("minus words here",), ("",)]
    got = resample(edge_docs, spark.createDataFrame(target, "text string"), longest, buckets, min_words, percent).collect()
    want = brute_resample([(r[0], r[1]) for r in edge_rows], [t for (t,) in target], longest, buckets, min_words, percent, 2024)
    assert sorted(map(tuple, got), key=repr) == want


def test_dictionary_starts_anew(monkeypatch):
    from plumbline.llm.resampling import Grams

    texts = [b"a b c a b", b"", b"b c d"]
    small, large = Grams(2, 50, limit=1), Grams(2, 50)
    for _ in range(3):
        for (ta, ba, ia), (tb, bb, ib) in zip(small.of(texts)[1], large.of(texts)[1], strict=True):
            assert ta.tolist() == tb.tolist() and ba[ia].tolist() == bb[ib].tolist()


def test_resampling_of_empty_tables(spark, empty_docs):
    from plumbline.llm.resampling import resample

    nothing = spark.createDataFrame([], "text string")
    assert resample(empty_docs, nothing).collect() == []
    docs = spark.createDataFrame([(i, f"w{i} " * 30) for i in range(20)], "doc_id long, text string")
    got = resample(docs, nothing).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2]
