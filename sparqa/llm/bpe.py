"""Byte-level BPE encoding and decoding with a pair occurrence index.

A task cuts its texts into pieces (words with their leading space, numbers, runs of marks, white space) and gathers
the distinct pieces it has not met. These lie end to end in one symbol array; an index maps each adjacent pair
that has a rank to all its positions. The lowest active rank is applied at all of its positions at once, then
the pairs to the left and right of every merge join the lists of their own ranks, until no rank is active.
Positions whose pair has changed meanwhile are dropped when their list comes up.

The vocabulary is a parameter: the path of a tokenizer file, read once by each Python worker.

Edge cases: a NULL or empty text has no tokens; the text of an added token is that token, as in the tokenizers
library; a text of any length is encoded whole; extra columns and repeated rows do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparqa.llm.hashing import release

#: Fixed value: how byte-level BPE cuts a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces kept per worker, and characters of text handled at a time.
CACHE_PIECES = 200_000
CHUNK_CHARS = 2 << 20
ROW_CHUNK = 1 << 12


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file -> the byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and added tokens of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = _byte_letters(), spec["model"]
        vocab = model["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        code = (left << 32) | right
        order = np.argsort(code, kind="stable")
        self.pair_code, self.pair_rank = code[order], order
        self.left, self.right = left, right
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        added = sorted(self.added, key=len, reverse=True)
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.cut = regex.compile(PIECES)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it has none."""
        code = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_code, code), len(self.pair_code) - 1)
        return np.where(self.pair_code[at] == code, self.pair_rank[at], -1)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_pieces(pieces: list[str], v: Vocabulary) -> list[list[int]]:
    """Token ids of each piece, all pieces at once by the pair occurrence index."""
    raw = [p.encode() for p in pieces]
    size = np.array([len(r) for r in raw], np.int64)
    if not int(size.sum()):
        return [[] for _ in raw]
    # a gap of one place after each piece keeps pieces apart
    place = np.cumsum(size + 1) - (size + 1)
    flat = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    sym = v.byte_id[flat]
    sym[place + size] = -1
    n = len(sym)
    nxt = np.arange(1, n + 1)
    prv = np.arange(-1, n - 1)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def note(at: np.ndarray) -> None:
        """Put the pairs that begin at ``at`` into the lists of their ranks."""
        at = at[at >= 0]
        a, b = sym[at], sym[np.minimum(nxt[at], n - 1)]
        ok = (a >= 0) & (b >= 0) & (nxt[at] < n)
        at = at[ok]
        if not len(at):
            return
        r = v.ranks(a[ok], b[ok])
        at, r = at[r >= 0], r[r >= 0]
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        cut = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else r
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(r)], strict=True) if len(r) else ():
            rank = int(r[lo])
            if rank not in index:
                index[rank] = []
                heapq.heappush(heap, rank)
            index[rank].append(at[lo:hi])

    note(np.arange(n - 1))
    while heap:
        rank = heapq.heappop(heap)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b = v.left[rank], v.right[rank]
        to = nxt[at]
        ok = (sym[at] == a) & (to < n)
        at, to = at[ok], to[ok]
        ok = sym[to] == b
        at, to = at[ok], to[ok]
        if a == b and len(at) > 1:  # in a run of one symbol every second pair is taken, from the left
            at = np.sort(at)
            to = nxt[at]
            head = np.concatenate([[True], to[:-1] != at[1:]])
            group = np.cumsum(head) - 1
            odd = (np.arange(len(at)) - np.flatnonzero(head)[group]) % 2 == 1
            at, to = at[~odd], to[~odd]
        if not len(at):
            continue
        sym[at] = v.result[rank]
        sym[to] = -2
        after = nxt[to]
        nxt[at] = after
        inside = after < n
        prv[after[inside]] = at[inside]
        note(np.unique(np.concatenate([prv[at], at])))
    keep = sym >= 0
    count = np.concatenate([[0], np.cumsum(keep)])
    begin, ends = count[place], count[place + size]
    ids = sym[keep].tolist()
    return [ids[i:j] for i, j in zip(begin.tolist(), ends.tolist(), strict=True)]


class Encoder:
    """Encodes texts, remembering the pieces it has met."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.known: dict[str, list[int]] = {}

    def cut(self, text: str) -> list[str]:
        """The pieces of a text; the text of an added token is one."""
        v = self.v
        if v.added_split is None or not any(t in text for t in v.added):
            return v.cut.findall(text)
        out: list[str] = []
        for part in v.added_split.split(text):
            out.extend([part] if part in v.added else v.cut.findall(part))
        return out

    def pieces(self, fresh: set[str]) -> list[tuple[str, list[int]]]:
        """Each of the distinct pieces with its ids."""
        plain = [p for p in fresh if p not in self.v.added]
        return [*zip(plain, encode_pieces(plain, self.v), strict=True), *((p, [self.v.added[p]]) for p in fresh if p in self.v.added)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [self.cut(t) for t in texts]
        known = self.known
        if len(known) > CACHE_PIECES:
            known.clear()
        known.update(self.pieces({p for pieces in cut for p in pieces if p not in known}))
        out = []
        for pieces in cut:
            ids: list[int] = []
            for p in pieces:
                ids += known[p]
            out.append(ids)
        return out

    def raw(self, ids: list[int]) -> bytes:
        table = self.v.bytes
        return b"".join([table[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.raw(ids).decode("utf-8", "replace")


def _texts(batches, column: str, chunk: int):
    """(batch, texts) in pieces of about ``chunk`` characters."""
    for t in batches:
        lo = 0
        texts = [x or "" for x in t.column(column).to_pylist()]
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= chunk) and hi - lo < ROW_CHUNK:
                size += len(texts[hi])
                hi += 1
            yield t.slice(lo, hi - lo), texts[lo:hi]
            lo = hi


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of ``text`` (array<int>)."""
    schema = df.withColumn(ids, F.array().cast("array<int>")).schema

    def run(batches):
        enc = Encoder(path)
        for t, texts in _texts(batches, text, CHUNK_CHARS):
            cols = {c: t.column(c) for c in t.schema.names} | {ids: pa.array(enc.encode(texts), pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema], [f.name for f in schema])
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of the token ids; NULL ids are an empty text."""
    schema = df.withColumn(text, F.lit("")).schema

    def run(batches):
        enc = Encoder(path)
        for t in batches:
            out = [enc.decode(x or []) for x in t.column(ids).to_pylist()]
            cols = {c: t.column(c) for c in t.schema.names} | {text: pa.array(out, pa.string())}
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema], [f.name for f in schema])
    return df.mapInArrow(run, schema)


def report(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the round trip of every whole text, digested in the task."""
    def run(batches):
        enc = Encoder(path)
        # a piece's ids are written out and decoded once, when it is first met
        told: dict[str, tuple[int, str, bytes]] = {}
        for t, texts in _texts(batches, "text", CHUNK_CHARS):
            n, a, b = [], [], []
            if len(told) > CACHE_PIECES:
                told.clear()
            cut = [enc.cut(x) for x in texts]
            for p, ids in enc.pieces({p for pieces in cut for p in pieces if p not in told}):
                told[p] = (len(ids), ",".join(map(str, ids)), enc.raw(ids))
            for pieces in cut:
                met = [told[p] for p in pieces]
                n.append(sum([m[0] for m in met]))
                a.append(hashlib.sha256(",".join([m[1] for m in met]).encode()).hexdigest())
                b.append(hashlib.sha256(b"".join([m[2] for m in met]).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([t.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        told.clear()
        release()
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
