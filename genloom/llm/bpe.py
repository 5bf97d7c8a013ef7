"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged over, so a text may be cut there and the fragments
encoded on their own: the ids of the whole are the ids of the fragments in order. The vocabulary gives a 256 x 256 table
of such pairs. The pre-split of the vocabulary's file (pieces of letters, digits, other signs and white space) forces
further cuts, and so do the strings of special tokens. Fragments and the words they make up are cached, with their ids
and with the bytes that decoding these ids gives.

The path of the vocabulary is a parameter; nothing of it is in this repository.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genloom.llm import textkernel as tk
from genloom.runtime import table

#: The pre-split of byte-level vocabularies of this kind; a fixed value.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A cut before white space that follows no white space is also a cut of the pre-split. 0x1C-0x1F are no white space there.
WORD = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+\Z")
#: A word that is one piece: letters after at most one space.
PLAIN = re.compile(r" ?[A-Za-z]+").fullmatch
CACHE = 100_000


def byte_alphabet() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBpe:
    """encode(text) → ids and decode(ids) → text for the byte-level vocabulary in a JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.bytes = {i: t for t, i in self.ids.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {}
        for n, (a, b) in enumerate(merges):
            self.rank.setdefault((self.ids[raw(a)], self.ids[raw(b)]), (n, self.ids[raw(a + b)]))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        inside = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        self.joint = [[bytes((a, b)) in inside for b in range(256)] for a in range(256)]
        self.pieces = regex.compile(PIECES)
        self.fast = self._library()
        if self.fast:
            self.rank = {}  # not needed beside the library's own table
        self.fragments: dict[bytes, tuple[str, bytes]] = {}
        self.words: dict[str, tuple[str, bytes]] = {}
        self.old: dict[str, tuple[str, bytes]] = {}

    def _library(self):
        """A compiled merge loop for fragments, where the installed library has one and ids rank as merges do; or None."""
        try:
            import tiktoken

            ranks = [self.rank[p][1] for p in self.rank]
            if ranks != sorted(ranks):
                return None
            plain = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=dict(self.ids), special_tokens={})
            return plain._core_bpe.encode_single_piece
        except (ImportError, AttributeError, ValueError):
            return None

    def cuts(self, piece: bytes) -> list[bytes]:
        """piece cut at every pair that no token holds."""
        joint, out, at = self.joint, [], 0
        for i in range(1, len(piece)):
            if not joint[piece[i - 1]][piece[i]]:
                out.append(piece[at:i])
                at = i
        out.append(piece[at:])
        return out

    def _merge(self, fragment: bytes) -> tuple[int, ...]:
        if fragment in self.ids and len(fragment) == 1:
            return (self.ids[fragment],)
        if len(fragment) > 200:
            return self._merge_long(fragment)
        ids, rank = [self.ids[fragment[i : i + 1]] for i in range(len(fragment))], self.rank
        pairs = [rank.get(p) for p in zip(ids, ids[1:])]
        while True:
            best, at = None, -1
            for i, p in enumerate(pairs):
                if p is not None and (best is None or p < best):
                    best, at = p, i
            if best is None:
                return tuple(ids)
            ids[at : at + 2] = [best[1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = rank.get((ids[at], ids[at + 1]))
            if at:
                pairs[at - 1] = rank.get((ids[at - 1], ids[at]))

    def _merge_long(self, fragment: bytes) -> tuple[int, ...]:
        """The same merges from a heap over a linked list, for fragments of any length."""
        import heapq

        n = len(fragment)
        ids, nxt, prv = [self.ids[fragment[i : i + 1]] for i in range(n)], list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := self.rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], nxt[i] = new, None, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < n and (r := self.rank.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[y], r[1]))
        return tuple(i for i in ids if i is not None)

    def _word(self, word: str) -> tuple[str, bytes]:
        """(ids as text, decoded bytes) of a run of white space and what follows it.

        Words are cached in two generations: a full young one becomes the old one, from which words in use come back, so
        that a long run of new words never drops the frequent ones.
        """
        made = self.old.get(word)
        if made is None:
            texts, raw = [], []
            for piece in [word] if PLAIN(word) else self.pieces.findall(word):
                for f in self.cuts(piece.encode()):
                    got = self.fragments.get(f)
                    if got is None:
                        ids = self.fast(f) if self.fast else self._merge(f)
                        got = (",".join(map(str, ids)), b"".join(map(self.bytes.__getitem__, ids)))
                        if len(f) <= 16 and len(f) < len(piece):
                            if len(self.fragments) >= CACHE:
                                self.fragments.clear()
                            self.fragments[f] = got
                    texts.append(got[0])
                    raw.append(got[1])
            made = (",".join(texts), b"".join(raw))
        if len(word) <= 64:
            if len(self.words) >= CACHE:
                self.old, self.words = self.words, {}
            self.words[word] = made
        return made

    def _parts(self, text: str) -> tuple[str, bytes]:
        """(ids as text, decoded bytes)."""
        parts: list[tuple[str, bytes]] = []
        for k, part in enumerate(self.special_re.split(text) if self.special_re else [text]):
            if k % 2:
                i = self.special[part]
                parts.append((str(i), self.bytes[i]))
            else:
                words = WORD.findall(part)
                some = list(map(self.words.get, words))
                if None in some:
                    for at, got in enumerate(some):
                        if got is None:
                            w = words[at]
                            some[at] = self.words.get(w) or self._word(w)
                parts += some
        if not parts:
            return "", b""
        texts, raw = zip(*parts)
        return ",".join(texts), b"".join(raw)

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, hash of the ids joined by commas, hash of the text that decoding them gives)."""
        ids, raw = self._parts(text)
        back = raw.decode("utf-8", "replace").encode()
        return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()

    def encode(self, text: str) -> list[int]:
        ids = self._parts(text)[0]
        return list(map(int, ids.split(","))) if ids else []

    def forget(self) -> None:
        """Drops the caches; a worker may live on without encoding more."""
        self.words, self.old, self.fragments = {}, {}, {}

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")


@cache
def _model(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 256) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): the token ids of every text and whether decoding them gives the text again.

    Nulls, repeated rows and empty tables as in digests(); rows is how many results go to the JVM at once.
    """

    def part(batches):
        m = _model(path)
        for b in batches:
            for at in range(0, b.num_rows, rows):
                some = b.slice(at, rows)
                texts = [t.as_py() or "" for t in some.column(1)]
                ids = [m.encode(t) for t in texts]
                same = [m.decode(i) == t for i, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])
        m.forget()

    return tk.map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col), part, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of docs.

    A null text counts as empty: no ids, and the digests of the empty string. Special tokens' strings in a text are these
    tokens. Repeated rows are encoded each; an empty table gives no rows; other columns are not read; a null id stays.
    """

    def part(batches):
        m = _model(path)
        for b in batches:
            n, i, d = [], [], []
            for t in b.column(1):
                x = m.digest(t.as_py() or "")
                n.append(x[0])
                i.append(x[1])
                d.append(x[2])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        m.forget()

    return tk.map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col), part, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), vocabulary_path())


QUERIES = {"op10_bpe": op10_bpe}
ORACLES: dict = {}
