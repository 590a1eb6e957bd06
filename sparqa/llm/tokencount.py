"""Token counts by heap-and-linked-list byte-pair merging; no token id is ever put out.

A piece of text starts as its bytes, one symbol each, in a linked list. A heap holds the adjacent pairs that have
a merge rank; the lowest is popped and merged, and the two pairs that come about around it are pushed. A popped
pair that has changed meanwhile is passed over. The count of a piece is its initial symbols minus its merges, and a
text's count is the sum over its pieces. A worker remembers the counts of short pieces it has met; the memory this
takes is bounded. The vocabulary is a parameter: the path of a tokenizer file, read once by each Python worker.

Edge cases: a NULL or empty text has no tokens and no bytes; the text of an added token counts as one token, as in
the tokenizers library; a text or piece of any length is counted whole (n log n for a piece of n bytes); repeated
rows are counted each; other columns are kept, one named like a result is replaced; an empty table stays empty.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparqa.llm.bpe import Vocabulary, vocabulary
from sparqa.llm.hashing import release

#: Counts remembered by a worker, and the longest piece (in characters) that is remembered.
KNOWN_PIECES = 600_000
KNOWN_CHARS = 64


class Merges:
    """The merge rules of a vocabulary: the rank of a pair of symbols, and the symbol that a rank makes."""

    def __init__(self, v: Vocabulary):
        self.width = len(v.bytes)
        self.rank = {a * self.width + b: rank for rank, (a, b) in enumerate(zip(v.left.tolist(), v.right.tolist(), strict=True))}
        self.result = v.result.tolist()

    def count(self, sym: list[int]) -> int:
        """Merges that the symbols go through, lowest rank first and from the left among equal ranks; ``sym`` is used up."""
        n, width, rank_of, result = len(sym), self.width, self.rank.get, self.result
        live = [rank_of(a * width + b, -1) for a, b in zip(sym, sym[1:])]  # rank of the pair that starts here now
        live.append(-1)
        heap = [r * n + i for i, r in enumerate(live) if r >= 0]
        heapq.heapify(heap)
        follow, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if live[i] != r:
                continue
            merges += 1
            j = follow[i]
            made = sym[i] = result[r]
            live[j] = -1
            follow[i] = k = follow[j]
            if k < n:
                before[k] = i
                live[i] = r = rank_of(made * width + sym[k], -1)
                if r >= 0:
                    heapq.heappush(heap, r * n + i)
            else:
                live[i] = -1
            h = before[i]
            if h >= 0:
                live[h] = r = rank_of(sym[h] * width + made, -1)
                if r >= 0:
                    heapq.heappush(heap, r * n + h)
        return merges


class Counter:
    """Counts the tokens of texts."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.merges = Merges(self.v)
        self.symbol = self.v.byte_id.tolist()
        self.known: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        symbols = [self.symbol[b] for b in piece.encode()]
        return len(symbols) - self.merges.count(symbols)

    def _plain(self, text: str) -> int:
        known, pieces = self.known, self.v.cut.findall(text)
        if len(known) > KNOWN_PIECES:
            known.clear()
        long = 0
        for p in set(pieces).difference(known):
            if len(p) <= KNOWN_CHARS:
                known[p] = self.piece(p)
            else:
                long = 1
        if not long:
            return sum(map(known.__getitem__, pieces))
        return sum(known[p] if len(p) <= KNOWN_CHARS else self.piece(p) for p in pieces)

    def count(self, text: str) -> int:
        v = self.v
        if v.added_split is None or not any(t in text for t in v.added):
            return self._plain(text)
        return sum(1 if part in v.added else self._plain(part) for part in v.added_split.split(text))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter a worker, so that later tasks of the worker find its pieces."""
    return Counter(path)


def with_counts(df: DataFrame, path: str, text: str = "text", tokens: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of ``text``."""
    schema = df.withColumn(tokens, F.lit(0).cast("long")).schema

    def run(batches):
        c = counter(path)
        for t in batches:
            # one text at a time is turned into Python text
            n = pa.array((c.count(x.as_py()) if x.is_valid else 0 for x in t.column(text)), pa.int64())
            cols = {k: t.column(k) for k in t.schema.names} | {tokens: n}
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema], [f.name for f in schema])
        release()
    return df.mapInArrow(run, schema)


def report(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    return with_counts(sized, path).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
