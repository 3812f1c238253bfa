"""Operator 2: MinHash near-duplicates with b-bit signatures.

Method.  A document's set is that of its distinct five-word shingles (as 64-bit hashes).  ``HASHES`` minima are taken
per set; bands of ``BAND_ROWS`` of them give candidate buckets.  Of each minimum only the low ``BITS`` bits are kept,
packed into longs; the share of equal fields, counted by bits and corrected for chance collisions, estimates the
similarity, and only candidates whose estimate is within reach of the threshold are confirmed, on full sets.

Documents with equal sets (by number of shingles and a 128-bit fingerprint) form one class; its smallest doc_id stands for
it.  Within a bucket not all pairs are made: each class is paired with the hub of its bucket, confirmed links give
components, and only pairs that lie in different components are looked at again, block against block: first signatures
alone, which leaves the members that have one within reach of the threshold in another component, then the full sets of
those members and no others, in parts of a bounded number of shingles.

Defined results: a null, empty or blank text has the empty set and links with nothing; a text of fewer than five
words has its whole sequence as its one shingle; repeated rows are one class; rows with a null doc_id link with
nothing and keep a null component; an empty table gives an empty one; extra columns are ignored.  Long texts are
hashed whole, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from plumbline.llm.common import by_rows, discard, small_batches, stage, texts_of
from plumbline.llm.components import connected_components
from plumbline.operators.ranks import numbered

WORDS = 5
THRESHOLD = (75, 100)
HASHES, BAND_ROWS, BITS = 128, 4, 2
BANDS, PER_LONG = HASHES // BAND_ROWS, 64 // BITS
LONGS = HASHES // PER_LONG
BLOCK = 1 << 10
#: standard errors that an estimate may fall short of the threshold: one in 300,000 linked pairs falls further
REACH = 4.5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_rng = np.random.default_rng(20)
#: of the hash of a shingle, one odd factor for each of its words
FACTORS = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
#: multiplier (odd) and addend of each min-hash function
MULTIPLY = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text.  Only A-Z are lowered."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(WORDS, len(words))
    total = np.full(len(h) - k + 1, k, np.uint64)  # a short sequence differs from a shingle by its length
    for i in range(k):
        total += h[i : len(h) - k + 1 + i] * FACTORS[i]
    total = mix(total)
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def minima(hashed: np.ndarray) -> np.ndarray:
    x = (hashed >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), BLOCK):
        np.minimum(low, (MULTIPLY * x[None, at : at + BLOCK] + ADD).min(axis=1), out=low)
    return low


def signature(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits of the minima (spread first, as products keep low bits apart badly), and the band keys."""
    spread = mix(low.astype(np.uint64) + (np.arange(HASHES, dtype=np.uint64) << np.uint64(32)))
    fields = (spread & np.uint64((1 << BITS) - 1)).reshape(LONGS, PER_LONG) << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS))
    bands = spread.reshape(BANDS, BAND_ROWS)
    key = np.zeros(BANDS, np.uint64)
    for i in range(BAND_ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, i])
    return np.bitwise_or.reduce(fields, axis=1).view(np.int64), key.view(np.int64)


#: what tells sets apart: the number of shingles and two 64-bit sums over them
SET = ["n_shingles", "f1", "f2"]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, f1 and f2 (a 128-bit fingerprint of the set), sig and bands (arrays of long)."""

    def run(cols):
        out = {"n_shingles": [], "f1": [], "f2": [], "sig": [], "bands": []}
        for text in texts_of(cols["text"]):
            s = shingles(text)
            sig, bands = signature(minima(s)) if len(s) else (np.empty(0, np.int64), np.empty(0, np.int64))
            for name, v in zip(out, (len(s), *fingerprint(s), sig, bands), strict=True):
                out[name].append(v)
        longs = pa.list_(pa.int64())
        kinds = {"n_shingles": pa.int64(), "f1": pa.int64(), "f2": pa.int64(), "sig": longs, "bands": longs}
        return {"doc_id": cols["doc_id"]} | {k: pa.array(v, kinds[k]) for k, v in out.items()}

    return by_rows(docs, ["doc_id", "text"], run, "doc_id long, n_shingles long, f1 long, f2 long, sig array<long>, bands array<long>")


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    return int(np.add.reduce(s).view(np.int64)), int(np.bitwise_xor.reduce(mix(s + np.uint64(1))).view(np.int64))


def full_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """cls and shingles (array of long) of the classes in ``members`` (cls, doc_id of one of its documents, and ``SET``)."""

    def run(cols):
        sets = [shingles(t) for t in texts_of(cols["text"])]
        of = [(len(s), *fingerprint(s)) for s in sets]
        same = np.array([a == b for a, b in zip(of, zip(*(cols[c].to_pylist() for c in SET), strict=True), strict=True)], bool)
        shingled = pa.array([s.view(np.int64) if ok else [] for s, ok in zip(sets, same, strict=True)], pa.list_(pa.int64()))
        return pa.RecordBatch.from_pydict({"cls": cols["cls"], "shingles": shingled}).filter(pa.array(same))

    got = by_rows(docs.select("doc_id", "text").join(members, "doc_id"), ["cls", "text", *SET], run, "cls long, shingles array<long>")
    return got.dropDuplicates(["cls"])


def estimate(a: str, b: str) -> Column:
    """Similarity by the share of equal fields, less what chance makes equal."""
    odd = (1 << 64) // 3  # 0101...01: the low bit of each field
    fields = F.lit(odd - (1 << 64) if odd >> 63 else odd)
    differ = lambda i: F.bit_count((F.col(a)[i].bitwiseXOR(F.col(b)[i])).bitwiseOR(F.shiftrightunsigned(F.col(a)[i].bitwiseXOR(F.col(b)[i]), 1)).bitwiseAND(fields))
    equal = HASHES - sum((differ(i) for i in range(1, LONGS)), differ(0))
    chance = 1 / (1 << BITS)
    return (equal / HASHES - chance) / (1 - chance)


def within_reach() -> float:
    """The least estimate that is looked at: the threshold less ``REACH`` standard errors of the estimate there."""
    chance, t = 1 / (1 << BITS), THRESHOLD[0] / THRESHOLD[1]
    p = t + (1 - t) * chance
    return t - REACH * float(np.sqrt(p * (1 - p) / HASHES)) / (1 - chance)


def linked(common: Column, n_a: Column, n_b: Column) -> Column:
    return THRESHOLD[1] * common >= THRESHOLD[0] * (n_a + n_b - common)


#: pairs of signatures that are compared at once
PAIRS = 1 << 19


class Members:
    """Members of whole groups (two blocks of a bucket each, all columns of ``NAMES``), in the order of groups."""

    NAMES = ("key", "one", "two", "cls", "comp", "block", "n_shingles", "sig", "bands")

    def __init__(self, table: pa.Table):
        column = lambda n: table.column(n).combine_chunks()
        self.key, self.one, self.two, self.cls, self.comp, self.block, self.size = (column(n).to_numpy() for n in self.NAMES[:7])
        self.sig = column("sig").flatten().to_numpy().view(np.uint64).reshape(-1, LONGS)
        self.bands = column("bands").flatten().to_numpy().reshape(-1, BANDS)
        new = np.concatenate([[True], (self.key[1:] != self.key[:-1]) | (self.one[1:] != self.one[:-1]) | (self.two[1:] != self.two[:-1])])
        first = np.flatnonzero(new)
        self.low = first[np.cumsum(new) - 1]
        self.many = np.diff(np.append(first, len(new)))[np.cumsum(new) - 1]
        self.band = (self.bands == self.key[:, None]).argmax(axis=1)

    def within_reach(self):
        """Pairs (i, j), in portions, of a group's two blocks: of different components, within reach, in their first common band."""
        odd, floor, chance = np.uint64((1 << 64) // 3), within_reach(), 1 / (1 << BITS)
        rows = np.flatnonzero(self.block == self.one)
        total = np.cumsum(self.many[rows])
        cuts = np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, PAIRS)).tolist() + [len(rows)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            some = rows[a:b]
            many = self.many[some]
            i = np.repeat(some, many)
            j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.low[some], many)
            low, high = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
            ok = (self.block[j] == self.two[j]) & (self.comp[i] != self.comp[j]) & ((self.one[i] != self.two[i]) | (self.cls[j] > self.cls[i])) & (THRESHOLD[1] * low >= THRESHOLD[0] * high)
            i, j = i[ok], j[ok]
            x = self.sig[i] ^ self.sig[j]
            equal = HASHES - np.bitwise_count((x | (x >> np.uint64(1))) & odd).sum(axis=1).astype(np.int64)
            ok = (equal / HASHES - chance) / (1 - chance) >= floor
            i, j = i[ok], j[ok]
            before = ((self.bands[i] == self.bands[j]) & (np.arange(BANDS) < self.band[i][:, None])).any(axis=1)
            yield i[~before], j[~before]


def _by_whole_groups(fn):
    """Of a partition sorted by (key, one, two): ``fn(table)`` of batches that end with a group."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(n).to_numpy() for n in ("key", "one", "two")]
            last = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in new]))
            cut = int(last[-1]) + 1 if len(last) else 0  # rows before the batch's last group
            same = bool(held) and all(held[-1].column(n)[-1].as_py() == c[-1] for n, c in zip(("key", "one", "two"), new, strict=True))
            if cut or (held and not same):
                yield fn(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield fn(pa.Table.from_batches(held))

    return lambda batches: (b for t in run(batches) for b in t.to_batches())


#: shingles of full sets that a task holds of each side of a comparison (or one set, if larger)
SHINGLES = 1 << 22


def _with_partners(table: pa.Table) -> pa.Table:
    """The members that have one of another component within reach."""
    held = np.zeros(table.num_rows, bool)
    for i, j in Members(table).within_reach():
        held[i] = True
        held[j] = True
    return table.filter(pa.array(held))


def _confirmed(table: pa.Table) -> pa.Table:
    """Links, by full sets (column shingles), between members of different components."""
    m = Members(table)
    shingles = table.column("shingles").combine_chunks()
    flat, at = shingles.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(m.size)])
    u, v = [], []
    for i, j in m.within_reach():
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            common = len(np.intersect1d(flat[at[a] : at[a + 1]], flat[at[b] : at[b + 1]], assume_unique=True))
            if THRESHOLD[1] * common >= THRESHOLD[0] * (m.size[a] + m.size[b] - common):
                u.append(int(m.cls[a]))
                v.append(int(m.cls[b]))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def block_pairs(member: DataFrame, block_rows: int) -> DataFrame:
    """Members of buckets (key, cls, comp), once for each pair of blocks (one <= two) of the bucket that they take part in.

    A component with at least ``block_rows`` members of a bucket has blocks of its own, which are never compared with one
    another; the others share blocks.  So a bucket that one component fills but for a few members costs its members
    little more than one row each.
    """
    sizes = member.groupBy("key", "comp").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("comp").rowsBetween(Window.unboundedPreceding, -1)  # at most n / block_rows rows a key
    large = sizes.filter(F.col("n") >= block_rows).withColumn("k", F.ceil(F.col("n") / block_rows)).withColumn("low", F.coalesce(F.sum("k").over(before), F.lit(0)))
    large = large.select("key", "comp", F.col("k").cast("long").alias("k"), F.col("low").cast("long").alias("low"))
    small = F.sum(F.when(F.col("n") < block_rows, F.col("n")).otherwise(0))
    pure = F.sum(F.when(F.col("n") >= block_rows, F.ceil(F.col("n") / block_rows)).otherwise(0))
    mixed = sizes.groupBy("key").agg(pure.cast("long").alias("pure"), F.ceil(small / block_rows).cast("long").alias("shared"), F.count("*").alias("comps")).filter("comps > 1")
    dealt = member.join(mixed, "key").join(large, ["key", "comp"], "left")
    at = lambda n: F.pmod(F.xxhash64("cls"), F.greatest(n, F.lit(1)))
    dealt = dealt.withColumn("block", F.when(F.col("k").isNull(), F.col("pure") + at(F.col("shared"))).otherwise(F.col("low") + at(F.col("k"))))
    every = F.sequence(F.lit(0).cast("long"), F.col("pure") + F.col("shared") - 1)
    own = lambda b: F.col("k").isNotNull() & (b >= F.col("low")) & (b < F.col("low") + F.col("k"))
    paired = dealt.select("key", "cls", "comp", "block", F.explode(F.filter(every, lambda b: ~own(b))).alias("other"))
    return paired.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "cls", "comp", "block")


def by_bytes(near: DataFrame, shingles: int) -> DataFrame:
    """Members of pairs of blocks, blocks split so that the sets of each part together have at most ``shingles`` (or are one).

    A part is named by its block and number, and a member comes once for each part of the other side.
    """
    pair = ["key", "one", "two"]
    so_far = F.sum("n_shingles").over(Window.partitionBy(*pair, "block").orderBy("cls").rowsBetween(Window.unboundedPreceding, -1))
    cut = near.withColumn("part", F.floor(F.coalesce(so_far, F.lit(0)) / shingles).cast("long"))
    parts = cut.groupBy(*pair, "block").agg(F.max("part").alias("_last"))
    facing = F.when(F.col("block") == F.col("one"), F.col("two")).otherwise(F.col("one"))
    cut = cut.withColumn("_facing", facing).join(parts.withColumnRenamed("block", "_facing"), [*pair, "_facing"])
    name = lambda block, part: F.shiftleft(F.col(block), 24).bitwiseOR(F.col(part))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("_part"))
    cut = cut.withColumn("_mine", name("block", "part")).withColumn("_theirs", name("_facing", "_part"))
    new = {"one": F.least("_mine", "_theirs"), "two": F.greatest("_mine", "_theirs"), "block": F.col("_mine")}
    return cut.select(*(new.get(c, F.col(c)).alias(c) for c in Members.NAMES))


def near_duplicates(docs: DataFrame, block_rows: int = 1024, shingles: int = SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    spark = docs.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = stage(signatures(docs), "signatures")
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    told = numbered(usable.groupBy(*SET).agg(F.min("doc_id").alias("doc_id")), [F.col(c).asc() for c in ("f1", "f2", "n_shingles")], "cls")
    classes = stage(told.join(usable, [*SET, "doc_id"]).dropDuplicates(["cls"]), "classes")
    discard(told)

    keyed = classes.select("cls", F.explode("bands").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("cls").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    buckets = stage(keyed.join(hubs, "key"), "buckets")
    sets = stage(full_sets(docs, buckets.select("cls").distinct().join(classes.select("cls", "doc_id", *SET), "cls")), "sets")

    pairs = buckets.filter("cls <> hub").select("cls", "hub").distinct()
    sigs = classes.select("cls", "sig", "n_shingles")
    for side, name in (("a", "cls"), ("b", "hub")):
        pairs = pairs.join(sigs.select(F.col("cls").alias(name), F.col("sig").alias(f"sig_{side}"), F.col("n_shingles").alias(f"n_{side}")), name)
    near = (estimate("sig_a", "sig_b") >= within_reach()) & (THRESHOLD[1] * F.least("n_a", "n_b") >= THRESHOLD[0] * F.greatest("n_a", "n_b"))
    pairs = pairs.filter(near).select("cls", "hub", "n_a", "n_b")
    for side, name in (("a", "cls"), ("b", "hub")):
        pairs = pairs.join(sets.select(F.col("cls").alias(name), F.col("shingles").alias(side)), name)
    star = pairs.filter(linked(F.size(F.array_intersect("a", "b")), F.col("n_a"), F.col("n_b"))).select(F.col("cls").alias("u"), F.col("hub").alias("v"))
    first = connected_components(star)

    member = buckets.join(first.select(F.col("node").alias("cls"), "component"), "cls", "left").select("key", "cls", F.coalesce("component", "cls").alias("comp"))
    member = stage(member, "bucket-members")
    paired = block_pairs(member, block_rows).join(classes.select("cls", "sig", "bands", "n_shingles"), "cls").select(*Members.NAMES)
    pair = ["key", "one", "two"]
    small_batches(spark)
    near = stage(paired.repartition(spread * 2, *pair).sortWithinPartitions(*pair).mapInArrow(_by_whole_groups(_with_partners), paired.schema), "near-members")
    cross = by_bytes(near, shingles).join(sets, "cls").repartition(spread, *pair).sortWithinPartitions(*pair).mapInArrow(_by_whole_groups(_confirmed), "u long, v long")
    label = lambda side: first.select(F.col("node").alias(side), F.col("component").alias(f"{side}_comp"))
    cross = cross.join(label("u"), "u", "left").join(label("v"), "v", "left").select(F.coalesce("u_comp", "u").alias("u"), F.coalesce("v_comp", "v").alias("v"))
    second = connected_components(cross)
    discard(sets, near, member)

    labels = first.unionByName(second.select("node", F.col("node").alias("component")).join(first.select("node"), "node", "left_anti"))
    labels = labels.join(second.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select(F.col("node").alias("cls"), F.coalesce("top", "component").alias("comp"))
    least = labels.join(classes.select("cls", "doc_id"), "cls").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_class = classes.select("cls", *SET, F.col("doc_id").alias("own")).join(labels.join(least, "comp"), "cls", "left").select(*SET, F.coalesce("component_id", "own").alias("component_id"))
    of_class = stage(of_class, "class-components")  # written, so that the rows of a class that very many share can be split over tasks
    discard(classes, buckets, first, second)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    found = signed.select("doc_id", *SET).join(of_class, SET, "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, with all its columns; rows without a doc_id stay."""
    kept = near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    held = docs.join(stage(kept, "kept-ids").hint("shuffle_hash"), "doc_id", "left_semi")
    return held.dropDuplicates(["doc_id", "text"]).unionByName(docs.filter("doc_id IS NULL"))
