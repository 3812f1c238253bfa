"""Operator 6: best-fit packing of token sequences with Martello-Toth dominance reduction.

Method.  The plan needs only the number of pieces of each length, at most ``capacity`` rows however large the corpus
is; that histogram alone reaches the driver.  There the reduction fixes sets of pieces that provably dominate
whatever else a sequence with the same longest piece could hold, and shrinks the instance; what is left goes best-fit
in decreasing order.  Equal lengths are handled as one class with a count.  The plan is a list of patterns (lengths in a
sequence, times the pattern is used), bounded whatever the size of the corpus: each pattern is made by using up a class or
an open pattern, so there are at most five for each of ``capacity`` lengths.

The pieces then find their places on Spark: each piece gets a rank within its length (its number in the order of all
pieces by length, from ranges and the counts of ranges, so that a length which a third of all pieces share is no single
group), and ranks of a length are dealt to patterns in consecutive ranges.  Offsets follow from the pattern.  No piece moves through the driver.

Defined results: a null text is an empty document and has the end id alone; repeated rows, also repeated doc_ids, are
packed each on its own; an empty table gives an empty result; extra columns are ignored.  Ties between equal lengths
are broken by doc_id, piece, crc and row, so lengths per sequence are deterministic.
"""

from __future__ import annotations

import bisect
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import PROBES, Memo, by_rows, discard, stage, texts_of
from plumbline.operators.ranks import numbered

END_ID = 1
SIGNS = b"!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"
PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


class WordCoder:
    """Ids of the word-end BPE, by words between ASCII white space, which the tokenizer drops.

    ASCII capitals are lowered before the lookup, as the tokenizer's normalizer does with all capitals.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = {i for t, i in vocab.items() if t.endswith("</w>")}
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = Memo(self.encode_word, limit=400_000)
        made = self.encode_all([t.encode() for t in PROBES])
        if wrong := [t for t, ids in zip(PROBES, made, strict=True) if ids != self.encode_whole(t.encode())]:
            raise ValueError(f"the tokenizer splits or normalises in a way that word-by-word encoding does not know: {wrong}")

    @staticmethod
    def letters(word: bytes) -> str | None:
        """The word as the normalizer leaves it, if that is one run of letters."""
        text = unicodedata.normalize("NFC", word.decode())
        return text if text.lower().isalpha() else None

    def encode_word(self, word: bytes) -> bytes:
        core = word.rstrip(SIGNS)
        if 0 < len(core) < len(word) and self.letters(core):  # a run of letters ends where signs begin
            return self.memo[core] + self.memo[word[len(core) :]]
        return self.encode_whole(word)

    def encode_whole(self, text: bytes) -> bytes:
        return array("I", self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()

    def learn(self, unknown: set[bytes]) -> None:
        """Encode new words of letters alone with few calls: each is one run of letters, so each ends at a word end.

        Every word has at least one end, so where a block has as many ends as words, each has exactly one; else its
        words are left to be encoded one by one.
        """
        cores = {w.rstrip(SIGNS) for w in unknown}
        new = [w for w in cores if w and w not in self.memo and len(w) <= self.memo.longest and self.letters(w)]
        if len(self.memo) + len(unknown) > self.memo.limit:
            self.memo.clear()
        for at in range(0, len(new), 512):
            block = new[at : at + 512]
            ids = self.tokenizer.encode(b" ".join(block).decode(), add_special_tokens=False).ids
            cuts = [k for k, i in enumerate(ids, 1) if i in self.ends]
            if len(cuts) == len(block):
                packed, first = array("I", ids).tobytes(), 0
                for word, cut in zip(block, cuts, strict=True):
                    self.memo[word] = packed[4 * first : 4 * cut]
                    first = cut

    def encode_all(self, texts: list[bytes]) -> Iterator[bytes]:
        """Packed ids of each text.  Words that are new to the memo are gathered over all texts and learnt at once."""
        get, unknown, split = self.memo.get, set(), []
        for text in texts:
            low = text.lower()
            if b"<|" in low and any(low.count(s) != text.count(s) for s in self.special):
                split.append((None, self.encode_whole(text)))  # special only in lower case: nothing may be lowered first
                continue
            words = low.split()  # the tokenizer's own special strings hold no white space
            parts = list(map(get, words))
            unknown.update(compress(words, map(not_, parts)))
            split.append((words, parts))
        self.learn(unknown)
        for words, parts in split:
            if words is None:
                yield parts
                continue
            for i in compress(range(len(parts)), map(not_, parts)):
                parts[i] = self.memo[words[i]]
            yield b"".join(parts)


@lru_cache(maxsize=2)
def coder(path: str) -> WordCoder:
    return WordCoder(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = 4096) -> DataFrame:
    """The pieces to pack: whole documents with the end id, longer ones cut into pieces of ``capacity`` tokens."""
    end = array("I", [END_ID]).tobytes()

    def run(cols):
        c = coder(path)
        coded = c.encode_all(texts_of(cols["text"]))
        out = {k: [] for k in ("doc_id", "row", "piece", "start", "length", "ids_crc32")}
        for doc_id, row, ids in zip(cols["doc_id"].to_pylist(), cols["row"].to_pylist(), coded, strict=True):
            ids += end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                for name, v in (("doc_id", doc_id), ("row", row), ("piece", k), ("start", at // 4), ("length", len(part) // 4), ("ids_crc32", zlib.crc32(part))):
                    out[name].append(v)
        return {k: pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in out.items()}

    return by_rows(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), ["doc_id", "row", "text"], run, PIECES)


def dominance_reduce(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fixed patterns with their multiplicities, and the counts that remain.

    From the longest piece down.  With j the longest and k the longest that fits beside it: where nothing fits, {j}
    is fixed; where k fills the sequence, or no two further pieces fit beside j, {j, k} dominates every set with j and
    is fixed; where exactly three can fit and some pair beside j is no longer than k, {j, k} dominates it too.
    """
    left = dict(counts)
    lengths = sorted(left)
    fixed: list[tuple[tuple[int, ...], int]] = []
    for j in sorted(counts, reverse=True):
        while left.get(j):
            room = capacity - j
            at = bisect.bisect_right(lengths, room) - 1
            while at >= 0 and (left[lengths[at]] < 1 or (lengths[at] == j and left[j] < 2)):
                at -= 1
            if at < 0:
                fixed.append(((j,), left[j]))
                left[j] = 0
                break
            k = lengths[at]
            small = []
            for s in lengths:
                n = left[s] - (s == j)
                if n > 0:
                    small += [s] * min(n, 3 - len(small))
                if len(small) == 3:
                    break
            two = sum(small[:2]) <= room if len(small) > 1 else False
            three = sum(small) <= room if len(small) > 2 else False
            best_pair = _longest_pair(lengths, left, j, room) if two and not three and k < room else 0
            if k == room or not two or (not three and best_pair <= k):
                times = left[j] // 2 if k == j else min(left[j], left[k])
                fixed.append(((j, k), times))
                left[j] -= times
                left[k] -= times
                if times == 0:
                    break
            else:
                break
    return fixed, {x: n for x, n in left.items() if n}


def _longest_pair(lengths: list[int], left: dict[int, int], j: int, room: int) -> int:
    """The longest sum of two pieces that fit beside j, by two pointers over the lengths still there."""
    here = [s for s in lengths if left[s] - (s == j) > 0 and s <= room]
    a, b, best = 0, len(here) - 1, 0
    while a <= b:
        total = here[a] + here[b]
        if total > room:
            b -= 1
        elif a == b and left[here[a]] - (here[a] == j) < 2:
            break
        else:
            best = max(best, total)
            a += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on classes: each class goes to the open patterns with the least room that holds it."""
    open_: dict[int, list[list]] = {}  # room -> [lengths, times]
    rooms: list[int] = []

    def put(room, lengths, times):
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append([lengths, times])

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length  # equal pieces side by side, as one by one they would fall
                if n >= each:
                    put(capacity - each * length, (length,) * each, n // each)
                if n % each:
                    put(capacity - (n % each) * length, (length,) * (n % each), 1)
                break
            room = rooms[at]
            groups = open_[room]
            lengths, times = groups.pop()
            if not groups:
                del open_[room]
                rooms.pop(at)
            each = min(room // length, n)
            used = min(times, n // each)
            put(room - each * length, lengths + (length,) * each, used)
            if times > used:
                put(room, lengths, times - used)
            n -= used * each
    return [(tuple(lengths), times) for groups in open_.values() for lengths, times in groups]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    fixed, rest = dominance_reduce(counts, capacity)
    return fixed + best_fit(rest, capacity)


def place(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """length -> ranges (first rank, first sequence, offset, ...) in order of rank; consecutive sequences a range."""
    used: dict[int, int] = dict.fromkeys(counts, 0)
    ranges: dict[int, list] = {x: [] for x in counts}
    sequence = 0
    for lengths, times in plan(counts, capacity):
        offset = 0
        for length in lengths:
            ranges[length].append((used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return ranges


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, row, piece, start, length, ids_crc32)."""
    spark = pieces.sparkSession
    pieces = stage(pieces, "pieces")
    # a row a length, whatever the size of the corpus
    counts = {r["length"]: r["n"] for r in sorted(pieces.groupBy("length").agg(F.count("*").alias("n")).collect())}
    before = {x: sum(n for y, n in counts.items() if y < x) for x in counts}
    ranked = numbered(pieces, [F.col(c).asc() for c in ("length", "doc_id", "piece", "ids_crc32", "row")], "rank")
    discard(pieces)
    # the counts and the bounded plan, as arrays
    first = {x: [np.array(c, np.int64) for c in zip(*v, strict=True)] for x, v in place(counts, capacity).items()}
    shared = spark.sparkContext.broadcast((before, first))
    names = ["doc_id", "row", "piece", "start", "length", "ids_crc32", "rank"]

    def run(cols):
        before, table = shared.value
        length, rank = (cols[c].to_numpy() for c in ("length", "rank"))
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for x in np.unique(length):
            rows = np.flatnonzero(length == x)
            here = rank[rows] - 1 - before[x]
            first, seq, off = table[x]
            at = np.searchsorted(first, here, "right") - 1
            sequence[rows], offset[rows] = seq[at] + here - first[at], off[at]
        kept = {c: cols[c] for c in ("doc_id", "row", "piece", "start", "length", "ids_crc32")}
        return kept | {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())}

    return by_rows(ranked, names, run, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    return pack(token_pieces(docs, path, capacity), capacity).drop("row")
