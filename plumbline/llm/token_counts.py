"""Operator 8: token counts, huge documents by overlap resynchronisation.

Method.  A document of at most ``chunk`` characters is counted by one task.  A longer one is cut into overlapping
chunks that Spark spreads over tasks; each chunk is encoded on its own, with offsets.  Two neighbouring chunks are
spliced at a position inside their overlap where both encodings have a token boundary and which is *proven stable*: a
visible character before it and a blank, tab or newline after it.  The pattern of the byte-level pre-tokenizer never
lets a token reach across such a position and looks at nothing before it, so the encodings agree from there on
whatever precedes.  Where an overlap holds no such position, the overlap is widened eightfold, and at last to the
whole document; no document is given up.

Counts of short parts (blanks and the word after them) are memoised per worker; parts are cut only at stable
positions.  Texts with other kinds of white space go to the library whole.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows each get their own result, also
repeated doc_ids; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import PROBES, Memo, by_rows, stage

#: white space that ends no part: the pre-tokenizer's and Python's idea of it may differ
ODD_SPACE = re.compile(r"[^\S \t\n\r]")
PART = re.compile(r"[ \t\n\r]*\S+|[ \t\n\r]+")
STABLE = re.compile(r"\S(?=[ \t\n\r])")
#: a word and one sign after it never share a token: letters end where the sign begins
WORD_SIGN = re.compile(r"( ?[A-Za-z]+)([.,])")
#: splice candidates that a chunk reports on either side
CANDIDATES = 32


class Counter:
    """Counts tokens with the tokenizers library; special strings in a text are handled as its default."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts = Memo(self.count_part, limit=800_000)
        if wrong := [t for t in PROBES if self.count(t) != len(self.encode(t).ids)]:
            raise ValueError(f"the tokenizer joins parts in a way that counting by parts does not know: {wrong}")

    def encode(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def count_part(self, part: str) -> int:
        if m := WORD_SIGN.fullmatch(part):
            return self.parts[m[1]] + self.parts[m[2]]
        return len(self.encode(part).ids)

    def count(self, text: str) -> int:
        if ODD_SPACE.search(text):
            return len(self.encode(text).ids)
        return sum(map(self.parts.__getitem__, PART.findall(text)))

    def boundaries(self, text: str) -> tuple[int, list[tuple[int, int]]]:
        """Token count, and (position, tokens before it) at each stable position that is a token boundary."""
        if ODD_SPACE.search(text):
            e = self.encode(text)
            ends = {}
            for k, (_, end) in enumerate(e.offsets):
                ends[end] = k + 1
            odd = {m.start() for m in ODD_SPACE.finditer(text)}
            found = [(m.end(), ends[m.end()]) for m in STABLE.finditer(text) if m.end() in ends and m.start() not in odd]
            return len(e.ids), found
        at = n = 0
        found = []
        for part in PART.findall(text):
            n += self.parts[part]
            at += len(part)
            found.append((at, n))
        return n, found[:-1]  # what follows the last part is unknown here


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, chunk: int = 1 << 15, overlap: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every whole text."""
    size = F.coalesce(F.char_length("text"), F.lit(0))
    docs = docs.select("doc_id", "text")

    def short(cols):
        c = counter(path)
        texts = [t or "" for t in cols["text"].to_pylist()]
        return {"doc_id": cols["doc_id"], "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array([c.count(t) for t in texts], pa.int64())}

    counted = by_rows(docs.filter(size <= chunk), ["doc_id", "text"], short, "doc_id long, n_bytes long, n_tokens long")
    huge = stage(docs.filter(size > chunk).withColumn("row", F.monotonically_increasing_id()), "huge-texts")
    counted = counted.unionByName(_huge_counts(huge, path, chunk, overlap))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def _huge_counts(huge: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    done, left = None, huge
    for width in (overlap, 8 * overlap, None):
        if width is None:  # overlaps as wide as the document: it is one chunk

            def whole(cols):
                c = counter(path)
                return {"row": cols["row"], "n_tokens": pa.array([c.count(t) for t in cols["text"].to_pylist()], pa.int64())}

            got = by_rows(left, ["row", "text"], whole, "row long, n_tokens long")
        else:
            spliced = stage(_spliced(left, path, chunk, width), "spliced-counts")
            got = spliced.filter(F.col("aligned")).select("row", "n_tokens")
            left = left.join(spliced.filter(~F.col("aligned")).select("row"), "row", "left_semi")
        done = got if done is None else done.unionByName(got)
    return huge.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes")).join(done, "row").select("doc_id", "n_bytes", "n_tokens")


def _spliced(huge: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """row, n_tokens and aligned (every pair of neighbouring chunks has a common stable boundary)."""
    last = F.floor((F.char_length("text") - 1) / chunk)
    chunks = huge.select("row", "text", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("k"))
    chunks = chunks.select("row", "k", F.substring("text", F.col("k") * chunk + 1, F.lit(chunk + overlap)).alias("part"))
    spread = int(huge.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def encode(cols):
        c = counter(path)
        out = {"row": cols["row"], "k": cols["k"], "n": [], "head": [], "tail": []}
        for k, part in zip(cols["k"].to_pylist(), cols["part"].to_pylist(), strict=True):
            n, found = c.boundaries(part)
            base = k * chunk
            head = [(base + p, t) for p, t in found if p < overlap][:CANDIDATES] if k else []
            tail = [(base + p, t) for p, t in found if chunk < p]
            out["n"].append(n)
            out["head"].append([{"p": p, "t": t} for p, t in head])
            out["tail"].append([{"p": p, "t": t} for p, t in tail[:CANDIDATES]])
        kind = pa.list_(pa.struct([("p", pa.int64()), ("t", pa.int64())]))
        return out | {"n": pa.array(out["n"], pa.int64()), "head": pa.array(out["head"], kind), "tail": pa.array(out["tail"], kind)}

    kind = "array<struct<p: bigint, t: bigint>>"
    ends = by_rows(chunks.repartition(spread, "row", "k"), ["row", "k", "part"], encode, f"row long, k int, n long, head {kind}, tail {kind}")
    after = Window.partitionBy("row").orderBy("k")
    ends = ends.withColumn("next", F.lead("head").over(after))
    common = F.array_min(F.array_intersect(F.transform("tail", lambda x: x.p), F.transform("next", lambda x: x.p)))
    ends = ends.withColumn("at", common)
    tokens = lambda side: F.get(F.filter(side, lambda x: x.p == F.col("at")), 0).t
    # tokens of the document up to the splice by this chunk, less those before the splice by the next one
    cut = F.when(F.col("next").isNull(), F.col("n")).otherwise(tokens("tail") - tokens("next"))
    return ends.groupBy("row").agg(F.sum(cut).alias("n_tokens"), F.bool_and(F.col("next").isNull() | F.col("at").isNotNull()).alias("aligned"))
