"""Operator 5: exact encoding with a SentencePiece merge model by backtracking, and decoding.

Method.  An encoding of a merge model is the only sequence of pieces in which every piece re-merges to itself and
every adjacent pair, re-merged from its characters, gives the same pair again.  ``PieceModel`` finds it from left to
right: an Aho-Corasick automaton over the pieces gives all matches, the longest one that is compatible with the piece
before it is taken, and when none is, the encoder steps back; a bitfield of end positions from which no encoding
exists keeps it from trying them again.

A text is cut beforehand where no piece can lie across: between two adjacent characters that occur next to each
other in no piece (no merge result could hold both).  Encodings of the parts are memoised per worker, so a word
costs one dictionary lookup after its first use.

Defined results: a null text is encoded as an empty one (begin and end ids only); repeated rows give repeated rows;
an empty table gives an empty one; extra columns are ignored.  Texts are never cut off; a word of any length is
encoded in time linear in its length, and only short ones enter the memo.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import PROBES, Memo, by_rows

SPACE = "▁"  # the model's stand-in for a space
#: a newline, spaces with the word after them, or trailing spaces: words never share a piece across these
CHUNK = re.compile(r"\n| *[^ \n]+| +")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceModel:
    """Pieces, scores and byte ids of a ``.model`` file, and the backtracking encoder over them."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.ids, self.score, self.byte_ids, self.text = {}, {}, {}, {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.text[i] = bytes([int(piece[1:-1], 16)])
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text[i] = b""
            else:
                self.ids[piece], self.score[piece] = i, sp.get_score(i)
                self.text[i] = piece.replace(SPACE, " ").encode()
        self.known = {c for p in self.ids for c in p}
        if any(c not in self.ids for c in self.known):
            raise ValueError("the model has a character that is no piece by itself")
        self.neighbours = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self._pairs: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}
        self.memo = Memo(self.packed, limit=500_000)
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in self.ids):
            raise ValueError("the model has pieces that lie across words; texts cannot be cut between them")
        if wrong := [t for t in PROBES if self.encode(t) != sp.encode(t, add_bos=True, add_eos=True) or self.decode(self.encode(t)) != sp.decode(self.encode(t))]:
            raise ValueError(f"the model normalises or merges in a way this encoder does not know: {wrong}")

    def remerge(self, text: str) -> list[str]:
        """Merge from single characters: the adjacent pair with the best score first, the leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def reachable(self, piece: str) -> bool:
        got = self._whole.get(piece)
        if got is None:
            got = self._whole[piece] = self.remerge(piece) == [piece]
        return got

    def compatible(self, left: str, right: str) -> bool:
        got = self._pairs.get((left, right))
        if got is None:
            if len(self._pairs) > 500_000:
                self._pairs.clear()
            got = self._pairs[left, right] = left[-1] + right[0] not in self.neighbours or self.remerge(left + right) == [left, right]
        return got

    def backtrack(self, text: str) -> list[str]:
        """Pieces of ``text``, all of whose characters the model knows."""
        n = len(text)
        if n == 1:
            return [text]
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, length in self.automaton.iter(text):
            starts[end - length + 1].append(length)  # ends ascend, so lengths do
        failed = bytearray(n + 1)
        taken: list[str] = []
        pos, left = 0, len(starts[0]) - 1  # left: index of the next length to try at pos
        stack: list[int] = []
        while pos < n:
            placed = False
            while left >= 0:
                end = pos + starts[pos][left]
                if not failed[end]:
                    piece = text[pos:end]
                    if self.reachable(piece) and (not taken or self.compatible(taken[-1], piece)):
                        taken.append(piece)
                        stack.append(left)
                        pos, placed = end, True
                        left = len(starts[pos]) - 1 if pos < n else -1
                        break
                left -= 1
            if not placed:
                if not taken:
                    raise ValueError("no encoding exists")
                failed[pos] = 1
                pos -= len(taken.pop())
                left = stack.pop() - 1
        return taken

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a part of a text, spaces not yet replaced; cut where no piece can lie across."""
        text = chunk.replace(" ", SPACE)
        cuts = [0, *(i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.neighbours), len(text)]
        out: list[int] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if text[a] not in self.known:
                out += [self.byte_ids[x] for x in text[a:b].encode()]
            elif len(cuts) > 2 and b - a > 2:
                out += array("I", self.memo[chunk[a:b]][0])
            else:
                out += [self.ids[p] for p in self.backtrack(text[a:b])]
        return out

    def packed(self, chunk: str) -> tuple[bytes, bytes]:
        """Ids as little-endian unsigned 32-bit integers, and the bytes that those ids decode to."""
        ids = self.encode_chunk(chunk)
        return array("I", ids).tobytes(), self.decode_ids(ids)

    def encode_parts(self, text: str) -> list[tuple[bytes, bytes]]:
        return list(map(self.memo.__getitem__, CHUNK.findall(" " + text.replace(SPACE, " ")))) if text else []

    def encode(self, text: str) -> list[int]:
        """All ids, with begin and end."""
        return [self.bos, *array("I", b"".join([p[0] for p in self.encode_parts(text)])), self.eos]

    def decode_ids(self, ids) -> bytes:
        return b"".join([self.text[i] for i in ids])

    def decode(self, ids) -> str:
        """As the library does: bytes joined, a leading space of the first piece dropped, broken UTF-8 replaced."""
        return self.decode_ids(ids).removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One model a worker process; workers are reused, and so are the memos."""
    return PieceModel(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Columns doc_id, ids (array of int, begin and end included) and decoded, for any DataFrame with doc_id and text."""

    def run(cols):
        m = model(path)
        ids = [m.encode(t or "") for t in cols["text"].to_pylist()]
        return {"doc_id": cols["doc_id"], "ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array([m.decode(x) for x in ids], pa.string())}

    return by_rows(docs, ["doc_id", "text"], run, "doc_id long, ids array<int>, decoded string")


def encoding_digest(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of ids, and SHA-256 of the ids and of the text decoded from those ids."""

    def run(cols):
        m = model(path)
        first, last = array("I", [m.bos]).tobytes(), array("I", [m.eos]).tobytes()
        n, ids_sha, text_sha = [], [], []
        for text in cols["text"].to_pylist():
            parts = m.encode_parts(text or "")
            ids = b"".join([first, *(p[0] for p in parts), last])
            decoded = b"".join([p[1] for p in parts]).removeprefix(b" ")
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
        return {"doc_id": cols["doc_id"], "n_tokens": pa.array(n, pa.int64()), "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    return by_rows(docs, ["doc_id", "text"], run, SCHEMA)
