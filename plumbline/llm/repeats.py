"""Operator 10: removal of repeated passages by merging Burrows-Wheeler transforms of shards.

A byte goes where a string of ``length`` bytes that covers it starts anywhere else in the corpus, in another document
or in the same one.

1. Filter.  The anchor of a window of ``length`` bytes is the leftmost least-hashed ``gram``-byte string in it; windows
   that follow each other and share an anchor form a run.  Equal windows have equal anchors at equal places, so a run
   whose anchor occurs once in the corpus holds no repeat, and runs of equal content repeat each other whole.
2. Merge.  What is left are runs that differ and share their anchor.  Their bytes are read as strings over ``block``-byte
   symbols, one string for each of the ``block`` phases of a run, so every byte place is a suffix and a window is
   ``length / block`` symbols.  Each shard of runs gets its transform: the preceding symbol of each suffix, in the order
   of the shard's suffixes.  The transforms are merged by refining their interleave: before the first round all
   suffixes are in one interval, shard after shard; each round reads the shards' transforms in the order of the
   interleave and deals its entries by the symbol read (a counting sort of one symbol, no suffix is compared again), so
   after round h it is in the order of the first h symbols.  The round in which two neighbours part is their common
   prefix; neighbours still together after ``length / block`` rounds are a repeated interval.
3. The repeated bytes of each document are removed.

Symbols are blocks of bytes since rounds of one byte each would be ``block`` times as many; common prefixes are
therefore known in whole symbols, which is what a threshold of a multiple of ``block`` bytes needs.

Runs of one anchor meet in one task, up to ``GROUP_RUNS`` different ones.  That bound is not a cap: windows of anchors
beyond it are counted by their own 128-bit hash with partial aggregation over all tasks, which gives the same windows.

Defined results: a null text is empty; texts shorter than a window keep all bytes; repeated rows are repeats of each
other; an empty table gives an empty one; extra columns are ignored (the stage form keeps them).  Rows are told apart
by doc_id and a hash of the text; equal rows get equal results.  Long texts are read whole, in overlapping segments.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import by_rows, discard, small_batches, stage, texts_of, unused

SEGMENT = 1 << 18
SHARD_RUNS, MOST_SHARDS = 256, 64
TASK_BYTES = 3 << 20
GROUP_RUNS = 8_000
LOW = np.uint64(0xFFFFFFFF)
RUNS = "did long, rid long, first int, windows int, times int, key long, content long"


@dataclass(frozen=True)
class Windows:
    """Bytes of a window, of an anchor and of a symbol; carried in the closures that workers run."""

    length: int = 400
    gram: int = 64
    block: int = 50

    def __post_init__(self):
        if self.length % self.block or not 0 < self.gram <= self.length:
            raise ValueError("a window is a whole number of symbols and holds an anchor")

    @property
    def depth(self) -> int:
        return self.length // self.block


#: of the pipeline: a passage of over 50 words is longer than this
PASSAGE = Windows(length=200)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, for hashes of any part of a text by differences."""

    def __init__(self, size: int, base: int = 0x9E3779B97F4A7C15):
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            self.up = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, base, np.uint64))])
            self.down = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, inverse, np.uint64))])

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out


_powers: dict[int, Powers] = {}


def powers(size: int) -> Powers:
    """Tables for at least ``size`` bytes; one a worker process."""
    have = max(_powers, default=0)
    if have < size:
        _powers.clear()
        have = max(size, SEGMENT << 1)
        _powers[have] = Powers(have)
    return _powers[have]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def runs_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, shape: Windows) -> tuple[np.ndarray, ...]:
    """Text number, first window, windows, times, anchor hash and content hash of the runs of texts in ``data``.

    Runs of equal content that follow each other, as periodic texts have them, are one row with their number in times.
    """
    length, gram = shape.length, shape.gram
    fits = np.flatnonzero(sizes >= length)
    if not len(fits):
        return tuple(np.empty(0, np.int64) for _ in range(6))
    pw = powers(len(data))
    prefix = pw.prefix(data)
    grams = mix((prefix[gram:] - prefix[:-gram]) * pw.down[: len(data) - gram + 1])
    ranked = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(ranked, length - gram + 1) & LOW).astype(np.int64)
    count = sizes[fits] - length + 1
    owner = np.repeat(fits, count)
    window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[fits], count)
    at = anchor[window]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(window)))
    begin, place = window[first], at[first]
    whole = (prefix[begin + many - 1 + length] - prefix[begin]) * pw.down[begin]
    content = mix(whole + mix(((place - begin).astype(np.uint64) << np.uint64(32)) + many.astype(np.uint64)))
    key = grams[place]
    same = (owner[first][1:] == owner[first][:-1]) & (content[1:] == content[:-1]) & (key[1:] == key[:-1])
    lead = np.flatnonzero(np.concatenate([[True], ~same]))
    times = np.diff(np.append(lead, len(first)))
    begin, many = begin[lead], many[lead]
    number = owner[first][lead]
    return number, begin - starts[number], many, times, key[lead].view(np.int64), content[lead].view(np.int64)


def segments(texts: list[bytes], length: int):
    """Groups of (text number, offset, part) of about ``SEGMENT`` bytes; longer texts in parts that overlap by a window less one."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), SEGMENT):
            part = text[at : at + SEGMENT + length - 1]
            if size + len(part) > SEGMENT + length and group:
                yield group
                group, size = [], 0
            group.append((i, at, part))
            size += len(part)
    if group:
        yield group


def identified(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-1)).alias("did"), F.xxhash64("doc_id", "text").alias("rid"))


def window_runs(docs: DataFrame, shape: Windows) -> DataFrame:
    """All runs of windows of all texts."""

    def run(cols):
        texts = texts_of(cols["text"])
        did, rid = cols["did"].to_numpy(), cols["rid"].to_numpy()
        out = []
        for group in segments(texts, shape.length):
            number = np.array([g[0] for g in group])
            offset = np.array([g[1] for g in group])
            sizes = np.array([len(g[2]) for g in group])
            data = np.frombuffer(b"".join(g[2] for g in group), np.uint8)
            part, first, many, times, key, content = runs_of(data, np.cumsum(sizes) - sizes, sizes, shape)
            part = part.astype(np.int64)
            out.append((did[number[part]], rid[number[part]], first + offset[part], many, times, key, content))
        joined = [np.concatenate(x) for x in zip(*out, strict=True)]
        names = {"did": pa.int64(), "rid": pa.int64(), "first": pa.int32(), "windows": pa.int32(), "times": pa.int32(), "key": pa.int64(), "content": pa.int64()}
        return {n: pa.array(v.astype(k.to_pandas_dtype(), copy=False), k) for (n, k), v in zip(names.items(), joined, strict=True)}

    return by_rows(docs, ["did", "rid", "text"], run, RUNS)


def dealt(symbol: np.ndarray) -> np.ndarray:
    """Stable order of ``symbol`` (from 0) by counting: one pass for each 16 bits."""
    order = np.argsort((symbol & 0xFFFF).astype(np.uint16), kind="stable")
    most = int(symbol.max(initial=0))
    for shift in range(16, most.bit_length(), 16):
        order = order[np.argsort(((symbol[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


@dataclass
class Shard:
    """A shard's suffixes (places in the data, -1 for the end of a string) in order, and the symbol before each."""

    suffixes: np.ndarray
    transform: np.ndarray


def shard_transform(symbol: np.ndarray, used: np.ndarray, run: np.ndarray, ends: int, shape: Windows) -> tuple[Shard, int]:
    """The transform of the strings that the ascending places ``used`` form in steps of a block, and their number.

    ``symbol`` has the number of the block at each place, ``run`` the run of each used place; no string leaves its run.  Each string ends in a symbol of its own, numbered from
    ``ends`` on and below all others, and is read as a ring: the symbol before its first one is its end.
    """
    n = len(used)
    after = np.searchsorted(used, used + shape.block)
    there = np.minimum(after, n - 1)
    follows = (used[there] == used + shape.block) & (run[there] == run)
    leads = np.ones(n, bool)
    leads[after[follows]] = False
    # elements: suffixes 0..n-1, then the end of each string
    heads = np.flatnonzero(leads)
    string = np.empty(n, np.int64)
    string[heads] = np.arange(len(heads))
    step, here = after, heads
    while len(here):
        here = here[follows[here]]
        string[step[here]] = string[here]
        here = step[here]
    following = np.empty(n + len(heads), np.int64)
    following[:n] = np.where(follows, after, n + string)
    own = np.concatenate([symbol[used], ends + np.arange(len(heads))])
    following[n:] = heads
    before = np.empty(n + len(heads), np.int64)
    before[following] = own
    order = np.arange(n + len(heads))
    keys, at = [], order
    for _ in range(shape.depth):
        keys.append(own[at])
        at = following[at]
    for key in reversed(keys):
        order = order[dealt(key[order])]
    places = np.concatenate([used, np.full(len(heads), -1)])
    return Shard(places[order], before[order]), len(heads)


def merge_transforms(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in merged order and the common prefix, in symbols up to ``depth``, of each with the one before it."""
    transforms = np.concatenate([s.transform for s in shards])
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s.transform) for s in shards])
    interval = np.zeros(len(interleave), np.int64)
    common = np.full(len(interleave), depth, np.int32)
    common[:1] = 0
    for h in range(depth):
        symbol = np.empty_like(transforms)
        symbol[np.argsort(interleave, kind="stable")] = transforms  # each shard's transform, read in its order
        order = dealt(symbol)
        interleave, symbol, interval = interleave[order], symbol[order], interval[order]
        parts = np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])])
        common[parts & (common == depth)] = h
        interval = np.cumsum(parts) - 1
    suffixes = np.empty(len(interleave), np.int64)
    suffixes[np.argsort(interleave, kind="stable")] = np.concatenate([s.suffixes for s in shards])
    return suffixes, common


def repeated_windows(contents: list[bytes], shape: Windows) -> list[np.ndarray]:
    """For each run's bytes, the starts of its windows that occur elsewhere in ``contents``."""
    length, block, depth = shape.length, shape.block, shape.depth
    sizes = np.array([len(c) for c in contents])
    starts = np.cumsum(sizes) - sizes
    none = [np.empty(0, np.int64)] * len(contents)
    data = np.frombuffer(b"".join(contents), np.uint8)
    pw = powers(len(data))
    prefix = pw.prefix(data)
    hashed = mix((prefix[block:] - prefix[:-block]) * pw.down[: len(data) - block + 1])
    _, symbol, times = np.unique(hashed, return_inverse=True, return_counts=True)
    # a window with a symbol that occurs once is no repeat; strings are of the other windows' symbols
    shared = np.zeros(len(data) + length, bool)
    shared[: len(symbol)] = times[symbol] > 1
    window = np.zeros(len(data), bool)
    count = sizes - length + 1
    window[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)] = True
    for k in range(depth):
        window &= shared[k * block : k * block + len(data)]
    used = window.copy()
    for k in range(1, depth):
        used[k * block :] |= window[: -k * block]
    used = np.flatnonzero(used)
    if not len(used):
        return none
    per_shard = max(SHARD_RUNS, -(-len(contents) // MOST_SHARDS))
    cuts = np.searchsorted(used, np.append(starts[::per_shard], len(data)))
    run = np.searchsorted(starts, used, "right")
    symbol = symbol.astype(np.int64) + len(used)  # ends of strings are numbered below
    shards, ends = [], 0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            shard, n = shard_transform(symbol, used[a:b], run[a:b], ends, shape)
            shards.append(shard)
            ends += n
    suffixes, common = merge_transforms(shards, depth)
    together = common == depth
    found = np.sort(suffixes[together | np.append(together[1:], False)])
    found = found[found >= 0]
    cut = np.searchsorted(found, np.append(starts, len(data)))
    return [found[cut[i] : cut[i + 1]] - starts[i] for i in range(len(contents))]


def spans_of(windows: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges [low, high) that windows starting at these sorted places cover."""
    if not len(windows):
        return []
    gap = np.flatnonzero(np.diff(windows) > length)
    low = windows[np.concatenate([[0], gap + 1])]
    high = windows[np.concatenate([gap, [len(windows) - 1]])] + length
    return list(zip(low.tolist(), high.tolist(), strict=True))


SPANS = "did long, rid long, low int, high int"


def _spans_batch(rows: list[tuple[int, int, int, int]]) -> dict[str, pa.Array]:
    kinds = {"did": pa.int64(), "rid": pa.int64(), "low": pa.int32(), "high": pa.int32()}
    return {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds.items())}


def _merging(shape: Windows):
    """Runs of a partition, sorted by anchor, in blocks of whole anchor groups: spans of those that occur once."""

    def flush(rows):
        found = repeated_windows([r[-1] for r in rows], shape) if len(rows) > 1 else []
        out = [(did, rid, first + lo, first + hi) for (_, did, rid, first, n, _), w in zip(rows, found, strict=False) if n == 1 for lo, hi in spans_of(w, shape.length)]
        return pa.RecordBatch.from_pydict(_spans_batch(out)) if out else None

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if size > TASK_BYTES and row[0] != rows[-1][0]:
                    if (made := flush(rows)) is not None:
                        yield made
                    rows, size = [], 0
                rows.append(row)
                size += len(row[-1])
        if (made := flush(rows)) is not None:
            yield made

    return run


RUN_BYTES = ("key", "did", "rid", "first", "n", "data")


def _run_bytes(docs: DataFrame, kinds: DataFrame, shape: Windows) -> DataFrame:
    """key, did, rid, first, n and data (the bytes) of runs (key, kinds, n, at: struct of did, rid, first, windows)."""
    run_of = F.struct("key", "kinds", "n", "at.first", "at.windows").alias("run")
    wanted = kinds.select("at.did", "at.rid", run_of).groupBy("did", "rid").agg(F.collect_list("run").alias("runs"))
    rows = docs.select("did", "rid", "text").join(wanted.hint("shuffle_hash"), ["did", "rid"])
    seen = set()  # of a task: of equal rows, which have the same did and rid, one is enough

    def run(cols):
        out = {n: [] for n in (*RUN_BYTES, "kinds")}
        for did, rid, text, runs in zip(cols["did"].to_pylist(), cols["rid"].to_pylist(), texts_of(cols["text"]), cols["runs"].to_pylist(), strict=True):
            for r in runs if (did, rid) not in seen else ():
                data = text[r["first"] : r["first"] + r["windows"] - 1 + shape.length]
                for name, v in zip(out, (r["key"], did, rid, r["first"], r["n"], data, r["kinds"]), strict=True):
                    out[name].append(v)
            seen.add((did, rid))
        return {n: pa.array(v, pa.binary() if n == "data" else pa.int32() if n == "first" else pa.int64()) for n, v in out.items()}

    return by_rows(rows, ["did", "rid", "text", "runs"], run, "key long, did long, rid long, first int, n long, data binary, kinds long")


def _counted_windows(data: DataFrame, shape: Windows) -> DataFrame:
    """Spans (did, rid, low, high) of runs that occur once, of anchors with very many runs: windows counted by hash over all tasks."""

    def run(cols):
        out = {n: [] for n in ("did", "rid", "first", "n", "low", "h1", "h2")}
        for did, rid, first, times, text in zip(*(cols[c].to_pylist() for c in ("did", "rid", "first", "n", "data")), strict=True):
            bytes_ = np.frombuffer(text, np.uint8)
            pw = powers(len(bytes_))
            prefix = pw.prefix(bytes_)
            n, mid = len(bytes_) - shape.length + 1, shape.length // 2
            half = lambda a, b: mix((prefix[b : b + n] - prefix[a : a + n]) * pw.down[a : a + n]).view(np.int64)  # noqa: E731, B023
            for name, v in zip(out, (*(np.full(n, x) for x in (did, rid, first, times)), np.arange(n), half(0, mid), half(mid, shape.length)), strict=True):
                out[name].append(v)
        return {k: pa.array(np.concatenate(v).astype(np.int64), pa.int64()) for k, v in out.items()}

    windows = by_rows(data, ["did", "rid", "first", "n", "data"], run, "did long, rid long, first long, n long, low long, h1 long, h2 long")
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("times")).filter("times > 1").select("h1", "h2")
    found = windows.filter("n = 1").join(twice, ["h1", "h2"], "left_semi").groupBy("did", "rid", "first").agg(F.sort_array(F.collect_list("low")).alias("low"))

    def spans(cols):
        rows = zip(*(cols[c].to_pylist() for c in ("did", "rid", "first", "low")), strict=True)
        return _spans_batch([(did, rid, first + lo, first + hi) for did, rid, first, low in rows for lo, hi in spans_of(np.array(low), shape.length)])

    return by_rows(found, ["did", "rid", "first", "low"], spans, SPANS)


def repeated_spans(docs: DataFrame, shape: Windows) -> DataFrame:
    """did, rid and spans (array of struct of low and high, byte offsets; may overlap) of texts that hold repeats; a staged table."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # tables are written where a join would follow an aggregation, so that a hot anchor's rows can be split over tasks
    keys = stage(window_runs(docs, shape).groupBy("key").agg(F.sum("times").alias("n")).filter("n > 1").select("key"), "shared-anchors")
    held = stage(window_runs(docs, shape).join(keys, "key"), "shared-runs")
    kinds = stage(held.groupBy("key", "content").agg(F.sum("times").alias("n"), F.min(F.struct("did", "rid", "first", "windows")).alias("at")), "run-kinds")
    groups = stage(kinds.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "differing-anchors")
    data = stage(_run_bytes(docs, kinds.join(groups, "key"), shape), "run-bytes")

    end = (F.col("first") + F.col("windows") * F.col("times") - 1 + shape.length).alias("high")
    whole = held.join(kinds.filter("n > 1").select("key", "content"), ["key", "content"], "left_semi").select("did", "rid", F.col("first").alias("low"), end)
    small_batches(spark)
    some = data.filter(F.col("kinds") <= GROUP_RUNS).select(*RUN_BYTES).repartition(2 * parts, "key").sortWithinPartitions("key")
    found = some.mapInArrow(_merging(shape), SPANS)
    found = found.unionByName(_counted_windows(data.filter(F.col("kinds") > GROUP_RUNS), shape))
    # rows that repeat a document in full have the same spans: each is held once
    spans = stage(whole.unionByName(found).groupBy("did", "rid").agg(F.collect_set(F.struct("low", "high")).alias("spans")), "spans")
    discard(keys, held, kinds, groups, data)
    return spans


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans as maximal disjoint ranges; ranges that touch are one run of removed bytes."""
    out: list[list[int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans or ()):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _with_spans(docs: DataFrame, shape: Windows) -> DataFrame:
    """The documents with did, rid and the spans to remove (null where there are none)."""
    return docs.join(repeated_spans(docs, shape).hint("shuffle_hash"), ["did", "rid"], "left")


def removal_digest(docs: DataFrame, shape: Windows = Windows()) -> DataFrame:  # noqa: B008
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""

    def run(cols):
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for text, spans in zip(texts_of(cols["text"]), cols["spans"].to_pylist(), strict=True):
            ranges = merged(spans)
            kept = kept_bytes(text, ranges)
            for name, v in zip(out, (len(text), len(text) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest()), strict=True):
                out[name].append(v)
        return {"doc_id": cols["doc_id"]} | {k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()}

    return by_rows(_with_spans(identified(docs), shape), ["doc_id", "text", "spans"], run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, shape: Windows = PASSAGE) -> DataFrame:
    """The documents with repeated passages taken out of text (and n_chars, where there is one, counted anew).

    Where a passage begins or ends inside a character, what is left of the character goes too.
    """
    names = docs.columns
    did, rid, gone = (unused(x, names) for x in ("_did", "_rid", "_gone"))
    spans = repeated_spans(identified(docs), shape).withColumnsRenamed({"did": did, "rid": rid, "spans": gone})
    rows = docs.select("*", F.coalesce("doc_id", F.lit(-1)).alias(did), F.xxhash64("doc_id", "text").alias(rid))
    rows = rows.join(spans.hint("shuffle_hash"), [did, rid], "left").select(*names, gone)
    small_batches(docs.sparkSession)
    schema = docs.schema

    def run(batches):
        for batch in batches:
            cols = {c: batch.column(i) for i, c in enumerate(names)}
            texts = []
            for text, spans in zip(cols["text"].cast(pa.binary()).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                texts.append(kept_bytes(text, merged(spans)).decode("utf-8", "ignore") if text and spans else text if text is None else text.decode())
            cols["text"] = pa.array(texts, pa.string())
            if "n_chars" in cols:
                counted = pa.array([None if t is None else len(t) for t in texts], cols["n_chars"].type)
                cols["n_chars"] = counted
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    return rows.mapInArrow(run, schema)
