"""Operators 2, 5, 6, 8 and 10 against brute force or the libraries, on the driver's documents and on edge cases."""

import hashlib
import re
import zlib
from array import array
from collections import Counter

import pytest

from plumbline.llm.queries import tokenizer_path


@pytest.fixture(scope="module", params=["driver", "edge"])
def docs(request, documents, edge_docs):
    return documents if request.param == "driver" else edge_docs


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def as_sorted(rows):
    return sorted(map(tuple, rows), key=repr)


# ---- operator 2
def shingle_set(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_near(rows):
    sets = [shingle_set(t) for _, t in rows]
    n = len(rows)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_gram = {}
    for i, s in enumerate(sets):
        for g in s:
            by_gram.setdefault(g, []).append(i)
    pairs = {(a, b) for members in by_gram.values() for a in members for b in members if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * len(sets[a] | sets[b]) and None not in (rows[a][0], rows[b][0]):
            root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return as_sorted((d, len(s), None if d is None else least[find(i)], d is not None and least[find(i)] == d or d is None) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("block_rows", [2, 256])
def test_near_duplicate_documents(docs, block_rows):
    from plumbline.llm.minhash import near_duplicates

    got = near_duplicates(docs, block_rows).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert as_sorted(got) == brute_near(rows_of(docs))


def test_links_near_the_threshold_and_in_chains(spark):
    """Texts that drift away step by step: neighbours link, and similarities lie on either side of 0.75."""
    from plumbline.llm.minhash import near_duplicates

    rows = []
    for family in range(12):
        words = [f"w{family}x{i}" for i in range(120)]
        for step in range(12):
            rows.append((family * 100 + step, " ".join(words)))
            for j in range(1 + family % 4):
                words[(step * 17 + j * 5) % 120] = f"n{family}s{step}j{j}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block_rows, shingles in ((2, 60), (256, 1 << 22)):
        got = near_duplicates(df, block_rows, shingles).select("doc_id", "n_shingles", "component_id", "kept").collect()
        assert as_sorted(got) == brute_near(rows)


def test_blocks_and_parts_meet_once_and_stay_bounded(spark):
    """One component fills a bucket: its blocks never meet one another, and no part holds more shingles than asked."""
    from pyspark.sql import functions as F

    from plumbline.llm.minhash import Members, block_pairs, by_bytes

    rows = [(1, i, 0 if i < 400 else i) for i in range(420)] + [(2, i, i) for i in range(30)] + [(3, i, 7) for i in range(50)]
    member = spark.createDataFrame(rows, "key long, cls long, comp long")
    paired = block_pairs(member, 40)
    held = paired.collect()
    assert {r.key for r in held} == {1, 2}  # all of bucket 3 is one component
    met = {}
    for r in held:
        met.setdefault((r.key, r.one, r.two), []).append(r)
    found = {}
    for (key, one, two), group in met.items():
        for a in group:
            for b in group:
                if a.block == one and b.block == two and a.comp != b.comp and (one != two or a.cls < b.cls):
                    pair = (key, *sorted((a.cls, b.cls)))
                    found[pair] = found.get(pair, 0) + 1
    comp = {(k, c): m for k, c, m in rows}
    expected = {(k, a, b) for k, n in ((1, 420), (2, 30)) for a in range(n) for b in range(a + 1, n) if comp[k, a] != comp[k, b]}
    assert set(found) == expected and set(found.values()) == {1}
    assert sum(r.key == 1 for r in held) < 3 * 420 + 20 * 12  # the large component's members: one row each and a block of others

    sized = paired.withColumn("n_shingles", 10 + F.col("cls") % 7 * 30).withColumn("sig", F.array(F.col("cls"))).withColumn("bands", F.array("key"))
    parts = by_bytes(sized.select(*Members.NAMES), 500).collect()
    held, again = {}, {}
    for r in parts:
        held.setdefault((r.key, r.one, r.two, r.block), []).append(r)
    assert max(sum(r.n_shingles for r in g) for g in held.values()) <= 500 + 190
    for (key, one, two, block), g in held.items():
        for a in g if block == one else []:
            for b in held.get((key, one, two, two), []):
                if a.comp != b.comp and (one != two or a.cls < b.cls):
                    pair = (key, *sorted((a.cls, b.cls)))
                    again[pair] = again.get(pair, 0) + 1
    assert set(again) == expected and set(again.values()) == {1}


def test_bit_signatures_estimate_the_similarity():
    import numpy as np

    from plumbline.llm import minhash

    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[500:2500]  # 1500 of 2500
    x, y = (minhash.signature(minhash.minima(s))[0].view(np.uint64) for s in (a, b))
    differ = x ^ y
    equal = minhash.HASHES - int(np.bitwise_count((differ | (differ >> np.uint64(1))) & np.uint64((1 << 64) // 3)).sum())
    assert abs((equal / minhash.HASHES - 0.25) / 0.75 - 0.6) < 0.2


def test_one_of_each_keeps_whole_rows(edge_docs):
    from plumbline.llm.minhash import one_of_each

    got = one_of_each(edge_docs)
    assert got.columns == edge_docs.columns
    rows = got.collect()
    assert as_sorted((r.doc_id,) for r in rows) == as_sorted({(d,) for d, _, _, kept in brute_near(rows_of(edge_docs)) if kept})
    assert {r._text for r in rows} == {"own _text"}


# ---- operator 5
def test_encoding_is_that_of_the_library(docs):
    import sentencepiece

    from plumbline.llm.piece_encoding import encode_documents, encoding_digest

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    expected = []
    for d, t in rows_of(docs):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        expected.append((d, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert as_sorted(encoding_digest(docs, path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == as_sorted(expected)
    whole = {(r.doc_id, r.decoded) for r in encode_documents(docs, path).collect()}
    assert whole == {(d, sp.decode(sp.encode(t or "", add_bos=True, add_eos=True))) for d, t in rows_of(docs)}


def test_encoding_of_odd_strings():
    import random

    import sentencepiece

    from plumbline.llm.piece_encoding import model

    path = tokenizer_path("piece_bpe_32k.model")
    sp, mine, rng = sentencepiece.SentencePieceProcessor(model_file=path), model(path), random.Random(8)
    kinds = ["ab AB\n\t 019_-", " ", "aeiou ", "éß你好あаб ̀", "\U0001f600​ ▁﻿\u0000 a", "<s></s><unk><0x41>", "=====-----  "]
    for _ in range(3000):
        text = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 40)))
        ids = sp.encode(text, add_bos=True, add_eos=True)
        assert mine.encode(text) == ids, text
        assert mine.decode(ids) == sp.decode(ids), text


# ---- operator 6
def library_pieces(rows, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    out = []
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((d, k, at, len(part), zlib.crc32(array("I", part).tobytes())))
    return as_sorted(out)


def check_packed(rows, capacity):
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def best_fit_count(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= x), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((capacity if fit is None else fit) - x)
    return len(rooms)


@pytest.mark.parametrize("capacity", [128, 4096])
def test_packing(docs, capacity):
    from plumbline.llm.packing import pack_documents

    got = pack_documents(docs, tokenizer_path("word_bpe_49k.json"), capacity).collect()
    assert as_sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == library_pieces(rows_of(docs), capacity)
    n = check_packed(got, capacity)
    lengths = [r.length for r in got]
    assert -(-sum(lengths) // capacity) <= n <= best_fit_count(lengths, capacity)


def test_word_ids_of_odd_strings():
    import random

    from tokenizers import Tokenizer

    from plumbline.llm.packing import coder

    path, rng = tokenizer_path("word_bpe_49k.json"), random.Random(9)
    library, mine = Tokenizer.from_file(path), coder(path)
    kinds = ["abcXYZ ", "0123 a", "don't we're I'LL 'S ", ".,!?-_'\" ", "éÉéİßǅ 你", "\U0001f600​ 　\x00\x1f\x85 \r\n", "<|endoftext|> <|startoftext|>"]
    for _ in range(150):
        texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 30))) for _ in range(20)]
        texts += [rng.choice("ab") + "<|endoftext|>" + rng.choice(" cd"), "<|StartOfText|>x"]
        for text, ids in zip(texts, mine.encode_all([t.encode() for t in texts]), strict=True):
            assert list(array("I", ids)) == library.encode(text, add_special_tokens=False).ids, text


def test_dominance_never_costs_a_sequence():
    import itertools
    import random

    from plumbline.llm.packing import plan

    def optimum(lengths, capacity):
        for n in range(1, len(lengths) + 1):
            if fits(sorted(lengths, reverse=True), [capacity] * n):
                return n
        return 0

    def fits(lengths, rooms):
        if not lengths:
            return True
        for room in set(rooms):
            if room >= lengths[0]:
                rest = list(rooms)
                rest.remove(room)
                if fits(lengths[1:], [*rest, room - lengths[0]]):
                    return True
        return False

    rng = random.Random(5)
    from plumbline.llm.packing import best_fit, dominance_reduce

    for _ in range(300):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        counts = Counter(lengths)
        fixed, rest = dominance_reduce(dict(counts), 20)
        left = list(itertools.chain.from_iterable([x] * n for x, n in rest.items()))
        placed = Counter()
        for pattern, times in plan(dict(counts), 20):
            assert sum(pattern) <= 20 and times > 0
            placed.update({x: 0 for x in pattern})
            for x in pattern:
                placed[x] += times
        assert placed == counts
        assert sum(t for _, t in fixed) + optimum(left, 20) == optimum(lengths, 20)  # the fixed sets are provably no loss
        assert sum(t for _, t in best_fit(rest, 20)) >= optimum(left, 20)


# ---- operator 8
@pytest.mark.parametrize("chunk", [200, 1 << 15])
def test_token_counts(docs, chunk):
    from tokenizers import Tokenizer

    from plumbline.llm.token_counts import token_counts

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = token_counts(docs, path, 1024, chunk, 64).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    expected = []
    for d, x in rows_of(docs):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        expected.append((d, len((x or "").encode()), n, n > 1024))
    assert as_sorted(got) == as_sorted(expected)


def test_counts_of_odd_strings():
    import random

    from tokenizers import Tokenizer

    from plumbline.llm.token_counts import counter

    path, rng = tokenizer_path("byte_bpe_50k.json"), random.Random(7)
    library, mine = Tokenizer.from_file(path), counter(path)
    kinds = ["ab AB\n\t 019", "  \n\r\t", "don't we'll 'S ", ".,!?-_ ", "éß你а ", "\U0001f600​  \x0b\x0c\x85\x1c ", "<|endoftext|> "]
    for _ in range(3000):
        text = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 40))) + rng.choice(["", "<|endoftext|>", " <|endoftext|> x"])
        whole = len(library.encode(text, add_special_tokens=False).ids)
        assert mine.count(text) == whole, text
        n, found = mine.boundaries(text)
        assert n == whole
        for p, before in found:
            assert before + len(library.encode(text[p:], add_special_tokens=False).ids) == whole, (text, p)


# ---- operator 10
def brute_repeats(rows, length=400):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(hash(b[i : i + length]) for b in data for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[hash(b[i : i + length])] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return as_sorted(out)


def test_removed_repeats(docs):
    from plumbline.llm.repeats import removal_digest

    got = removal_digest(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert as_sorted(got) == brute_repeats(rows_of(docs))


def test_common_anchors_are_counted_over_all_tasks(edge_docs, monkeypatch):
    """With the bound on runs of one anchor at 1, every differing run goes the way of the hot ones."""
    from plumbline.llm import repeats

    monkeypatch.setattr(repeats, "GROUP_RUNS", 1)
    got = repeats.removal_digest(edge_docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert as_sorted(got) == brute_repeats(rows_of(edge_docs))


@pytest.mark.parametrize("length", [200, 400])
def test_overlapping_and_periodic_repeats(spark, length):
    """Passages that share parts, texts that repeat themselves with many periods, passages of one byte less than a window."""
    import random

    from plumbline.llm.repeats import Windows, removal_digest

    rng = random.Random(length)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base = noise(2000)
    rows = [noise(30) + base[a : a + n] + noise(40) for a, n in ((0, 900), (300, 900), (500, length), (700, length - 1), (701, length), (1200, 500), (1300, 700))]
    rows += ["ab" * 700, "abc" * 500, noise(150) * 9, noise(173) * 3 + noise(30), noise(length - 1) + "!" + noise(20), "z" * (length + 1), base[100:400] + "," + base[401:900]]
    near = noise(length + 90)
    rows += [near[:k] + "#" + near[k + 1 :] for k in range(0, len(near), 37)]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = removal_digest(docs, Windows(length)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert as_sorted(got) == brute_repeats(rows, length)


def test_merged_transforms_are_that_of_all_suffixes():
    """Order and common prefixes of merged shards against a plain sort of all suffixes by their symbols."""
    import random

    import numpy as np

    from plumbline.llm.repeats import Windows, merge_transforms, shard_transform

    rng = random.Random(12)
    shape = Windows(40, 8, 10)
    for shards in (1, 2, 5):
        pieces = [rng.choice([b"aaaaabbbbb", b"cdcdcdcdcd", b"aaaaaccccc"]) for _ in range(shards * 40)]
        runs = [b"".join(pieces[i : i + 8]) for i in range(0, len(pieces), 8)]
        data, starts = b"".join(runs), np.arange(0, 80 * len(runs), 80)
        blocks = [data[i : i + 10] for i in range(len(data) - 9)]
        number = {b: i for i, b in enumerate(sorted(set(blocks)))}
        used = np.array([s + i for s in starts for i in range(71)])
        run = np.repeat(np.arange(len(runs)), 71)
        symbol = np.array([number[b] for b in blocks]) + len(used)
        made, ends = [], 0
        for k in range(shards):
            mine = run // 5 == k
            shard, n = shard_transform(symbol, used[mine], run[mine], ends, shape)
            made.append(shard)
            ends += n
        suffixes, common = merge_transforms(made, shape.depth)
        sequence = lambda p: tuple(number[blocks[q]] for q in range(p, (p // 80 + 1) * 80 - 9, 10))[: shape.depth]  # noqa: B023, E731
        got = [sequence(p) for p in suffixes if p >= 0]
        assert sorted(p for p in suffixes if p >= 0) == used.tolist() and got == sorted(got)
        for before, here, shared in zip(suffixes[:-1], suffixes[1:], common[1:], strict=True):
            if before >= 0 and here >= 0:
                a, b = sequence(before), sequence(here)
                assert shared == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_passages_of_just_over_fifty_words_go(spark):
    """The pipeline's stage takes every passage of 51 to 60 words that two documents share, and nothing else."""
    import random

    from plumbline.llm.repeats import without_repeats

    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(n))
    passages = {n: words(n) for n in range(51, 61)}
    rows, kept = [], {}
    for i, (n, passage) in enumerate(passages.items()):
        for j in range(3):
            before, after = words(60) + " <", "> " + words(20)
            rows.append((3 * i + j, before + passage + after))
            kept[3 * i + j] = before + after
    rows += [(100 + i, words(150)) for i in range(20)]
    kept |= dict(rows[30:])
    got = {r.doc_id: r.text for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # the bytes beside a passage may be alike by chance in two of its places
    assert all(len(kept[i]) - 6 <= len(t) <= len(kept[i]) for i, t in got.items()) and {i: t for i, t in got.items() if i >= 100} == dict(rows[30:])


def test_stage_form_keeps_columns(edge_docs):
    from plumbline.llm.repeats import without_repeats

    got = without_repeats(edge_docs)
    assert got.columns == edge_docs.columns and got.count() == edge_docs.count()
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].text is None and rows[7].text == "" and rows[11].text.endswith("tail one") and rows[11].n_chars == len(rows[11].text)
    assert {r._did for r in rows.values()} == {"own _did"} and {r.spans for r in rows.values()} == {"own spans"}


def test_no_documents(empty_docs):
    from plumbline.llm.minhash import near_duplicates, one_of_each
    from plumbline.llm.packing import pack_documents
    from plumbline.llm.piece_encoding import encoding_digest
    from plumbline.llm.repeats import removal_digest, without_repeats
    from plumbline.llm.token_counts import token_counts

    for f in (near_duplicates, one_of_each, removal_digest, without_repeats):
        assert f(empty_docs).count() == 0
    assert pack_documents(empty_docs, tokenizer_path("word_bpe_49k.json")).count() == 0
    assert encoding_digest(empty_docs, tokenizer_path("piece_bpe_32k.model")).count() == 0
    assert token_counts(empty_docs, tokenizer_path("byte_bpe_50k.json")).count() == 0
