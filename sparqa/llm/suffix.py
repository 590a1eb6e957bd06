"""Suffix-array dedup of long repeated byte strings.

Every byte that lies in a 50-byte string which also starts in a document with a smaller id is removed. The
work runs in blocks of documents and buckets of text:

1. *Anchors.* Every window of 31 consecutive 20-byte hashes picks its least; a 50-byte string holds one such
   window, so equal strings pick the same anchor. Blocks send their distinct anchors to buckets, which
   tell the blocks those that occur in two documents or more.
2. *Contexts.* Around every shared anchor a block cuts the bytes of the strings that picked it. Equal
   contexts of a block become one entry with its smallest document id, so a passage in a third of all documents
   costs one entry per block, not one per document. An anchor that would give a bucket too many contexts is hot: its
   50-byte strings become entries of their own, dealt out by a hash of their own bytes, so equal strings still meet.
3. *Suffix array.* Each bucket puts its distinct contexts end to end and sorts their suffixes in two stages: those
   smaller than their successors directly, the others by induction in bucket scans. Common prefixes of
   neighbours then split the order into runs of equal 50-byte strings, whose smallest ids go back to the blocks.
4. *Removal.* A block marks each string whose smallest id is below its document's.

Nothing is capped: anchors only choose what is sorted together. Edge cases: a NULL text is empty; a NULL id is
larger than all others; rows with one id never remove each other's bytes; texts under 50 bytes stay whole;
other columns are kept as they are; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparqa.llm.common import scratch, stored
from sparqa.llm.hashing import mix, odd, released, text_buffer

MATCH = 50
GRAM = 20
WINDOW = MATCH - GRAM + 1
CONTEXT = MATCH + WINDOW - 1
#: Text of a block, anchors (8 bytes each) and contexts of a bucket: what a task holds at a time.
BLOCK_BYTES = 4 << 20
ANCHOR_BUCKET_BYTES = 4 << 20
CONTEXT_BUCKET_ENTRIES = 12_000
MAX_BUCKETED = 50_000
CHUNK = 1 << 18
NO_ID = 2 ** 63 - 1
_C = odd(5, 16)
_ONE = np.uint64(1)
#: The low bits of an anchor's hash carry what a block or a bucket says of it.
_LOW = np.uint64(63)


# ---- anchors ------------------------------------------------------------------------------------------

def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position (GRAM = 16 + 4)."""
    h = buf.astype(np.uint64) + _ONE
    four = None
    for i, k in enumerate((1, 2, 4, 8)):
        h = h[:-k] * _C[i] + h[k:]
        if k == 2:
            four = h
    return mix(h[:len(h) - 4] * _C[4] + four[16:16 + len(h) - 4])


def _runs(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(document index, first start, number of starts, anchor hash) of each run of 50-byte strings that pick
    one anchor; some documents at a time."""
    lens = np.diff(offs)
    docs = np.flatnonzero(lens >= MATCH)
    ends = np.cumsum(lens[docs])
    i = 0
    while i < len(docs):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHUNK, "right")))
        part = docs[i:j]
        i = j
        n = lens[part]
        text = np.concatenate([buf[offs[d]:offs[d + 1]] for d in part])
        begin = np.cumsum(n) - n
        h = _gram_hashes(text)
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        for k in (1, 2, 4, 8):
            key = np.minimum(key[:-k], key[k:])
        key = np.minimum(key[:len(key) - 15], key[15:])
        pick = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        starts = n - MATCH + 1  # per document
        first = np.cumsum(starts) - starts
        at = np.arange(int(starts.sum())) + np.repeat(begin - first, starts)
        a = pick[at]
        cut = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        s = at[cut]
        d = np.searchsorted(begin, s, "right") - 1
        yield part[d], s - begin[d] + offs[part[d]], np.diff(np.append(cut, len(a))), h[a[cut]]


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _sliced(keys: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) over keys sorted by hash."""
    b = _bucket(keys, n).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    for lo, hi in zip(cut, np.append(cut[1:], len(b)), strict=True):
        yield int(b[lo]), int(lo), int(hi)


_SENT = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("data", T.BinaryType())])
_TOLD = T.StructType([T.StructField("_block", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("data", T.BinaryType())])


def _rows(schema: T.StructType, cols: list[list]) -> pa.Table:
    kinds = {"integer": pa.int32(), "binary": pa.binary(), "long": pa.int64()}
    return pa.table({f.name: pa.array(c, kinds[f.dataType.typeName()]) for f, c in zip(schema, cols, strict=True)})


def _send_anchors(n_buckets: int):
    def send(t: pa.Table) -> pa.Table:
        buf, offs = text_buffer(t["_text"])
        ids = t["_id"].to_numpy()
        found = [(ids[d], h) for d, _, _, h in _runs(buf, offs)]
        out: list[list] = [[], [], []]
        if found:
            d, h = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(h, kind="stable")
            d, h = d[order], h[order] | _LOW
            cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            many = np.minimum.reduceat(d, cut) < np.maximum.reduceat(d, cut)
            power = np.frexp(np.diff(np.append(cut, len(h))))[1] - 1
            # the lowest bit: in two documents of this block; the next five: the power of two in its number of runs
            h = (h[cut] & ~_LOW) | (2 * power + many).astype(np.uint64)
            for b, lo, hi in _sliced(h, n_buckets):
                out[0].append(b)
                out[1].append(t["_block"][0].as_py())
                out[2].append(h[lo:hi].tobytes())
        return _rows(_SENT, out)
    return send


def _shared_anchors(hot_runs: int):
    """Tell each block its shared anchors, the lowest bit off for those of ``hot_runs`` runs or more. The bucket is
    -1 less the entries that the block may make of them."""
    def tell(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.uint64) for x in t["data"]]
        ranks = np.sort(np.concatenate(parts))
        base = ranks | _LOW
        cut = np.flatnonzero(np.concatenate([[True], base[1:] != base[:-1]]))
        size = np.diff(np.append(cut, len(base)))
        shared = (size > 1) | (np.bitwise_or.reduceat(ranks & _ONE, cut) == _ONE)
        hot = (np.add.reduceat(_runs_told(ranks), cut) >= hot_runs)[shared]
        shared = base[cut][shared]
        out: list[list] = [[], [], []]
        for x, block in zip(parts, t["block"].to_pylist(), strict=True):
            at = np.minimum(np.searchsorted(shared, x | _LOW), len(shared) - 1)
            ok = shared[at] == x | _LOW if len(shared) else np.zeros(len(x), bool)
            x, at = x[ok], at[ok]
            if len(x):
                out[0].append(block)
                out[1].append(-1 - int(np.where(hot[at], _runs_told(x) * (WINDOW // 2), 1).sum()))
                out[2].append((shared[at] - hot[at].astype(np.uint64)).tobytes())
        return _rows(_TOLD, out)
    return tell


def _runs_told(h: np.ndarray) -> np.ndarray:
    return np.int64(1) << ((h & _LOW) >> _ONE).astype(np.int64)


# ---- contexts -----------------------------------------------------------------------------------------

def _contexts(t: pa.Table, told: list[bytes]):
    """The runs of a block on shared anchors, and their distinct contexts in a canonical order.

    Returns ids, (document, start, number of starts, entry) of the runs, and of the entries the anchor, a
    hash, the smallest id, the number of starts and where one begins. Runs on hot anchors are cut into their
    strings, which have their own hash in the anchor's place. No bytes are kept, some 35 bytes of hashes and places a run.
    """
    buf, offs = text_buffer(t["_text"])
    ids = t["_id"].to_numpy()
    shared = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in told])) if told else np.zeros(0, np.uint64)
    hot, shared = shared & _ONE == 0, shared | _LOW
    got = []
    padded = np.concatenate([buf, np.zeros(CONTEXT, np.uint8)])
    m1, m2 = odd(7, CONTEXT // 8), odd(9, CONTEXT // 8)
    place = np.int32 if len(buf) < 2 ** 31 else np.int64

    def add(d: np.ndarray, s: np.ndarray, n: np.ndarray, h: np.ndarray | None) -> None:
        for i in range(0, len(d), CHUNK // 8):
            j = slice(i, i + CHUNK // 8)
            ctx, inside = _bytes_of(padded, s[j], n[j])
            w = mix((ctx * inside).view(np.uint64))
            c1, c2 = mix((w * m1).sum(1) + n[j].astype(np.uint64)), mix((w * m2).sum(1))
            got.append((d[j].astype(np.int32), s[j].astype(place), n[j].astype(np.uint8), c1 if h is None else h[j], c1, c2))

    for d, s, n, h in _runs(buf, offs) if len(shared) else ():
        h = h | _LOW
        at = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
        ok = shared[at] == h
        some = ok & ~hot[at]
        add(d[some], s[some], n[some], h[some])
        some = np.flatnonzero(ok & hot[at])
        if len(some):
            k = n[some]
            start = np.arange(int(k.sum())) + np.repeat(s[some] - (np.cumsum(k) - k), k)
            add(np.repeat(d[some], k), start, np.ones(len(start), np.int64), None)
    if not got:
        return buf, offs, ids, None, None
    fields = [list(x) for x in zip(*got, strict=True)]
    got.clear()
    d, s, n, h, c1, c2 = (np.concatenate(fields.pop(0)) for _ in range(6))
    order = np.lexsort([c2, c1, h]).astype(place)
    same = np.ones(len(order), bool)
    same[0] = False
    for x in (h, c1, c2):
        x = x[order]
        same[1:] &= x[1:] == x[:-1]
    cut = np.flatnonzero(~same)
    entry = np.empty(len(order), place)
    entry[order] = np.cumsum(~same, dtype=place) - place(1)
    rep = order[cut]
    least = np.minimum.reduceat(ids[d[order]], cut)
    return buf, offs, ids, (d, s, n, entry), (h[rep], c1[rep], least, n[rep], s[rep])


def _bytes_of(padded: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes from each start, and which of them belong to its ``n`` strings."""
    wide = np.arange(CONTEXT)
    return padded[s[:, None] + wide], wide < (n.astype(np.int64) + MATCH - 1)[:, None]


def _send_contexts(n_buckets: int):
    def send(t: pa.Table, told: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if t.num_rows:
            buf, _, _, _, entries = _contexts(t, [x.as_py() for x in told["data"]])
            if entries:
                h, c, least, n, s = entries
                padded = np.concatenate([buf, np.zeros(CONTEXT, np.uint8)])
                for b, lo, hi in _sliced(h, n_buckets):
                    out[0].append(b)
                    out[1].append(t["_block"][0].as_py())
                    parts = [np.int64(hi - lo).tobytes(), c[lo:hi].tobytes(), least[lo:hi].tobytes(), n[lo:hi].tobytes()]
                    for i in range(lo, hi, CHUNK // 8):
                        j = slice(i, min(hi, i + CHUNK // 8))
                        ctx, inside = _bytes_of(padded, s[j], n[j])
                        parts.append(ctx[inside].tobytes())
                    out[2].append(b"".join(parts))
        return _rows(_SENT, out)
    return send


# ---- suffix array -------------------------------------------------------------------------------------

def _words8(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one big-endian number; zeros follow the text."""
    w = np.concatenate([text, np.zeros(72, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        w = (w[:-k] << np.uint64(8 * k)) | w[k:]
    return w


def two_stage_order(text: np.ndarray, want: np.ndarray, word: np.ndarray | None = None) -> np.ndarray:
    """The positions ``want`` of ``text`` (ascending) in the order of their suffixes, to a depth of 56 bytes
    at least; suffixes that agree so far stand side by side.

    Suffixes smaller than their successors are sorted directly. Scanning the buckets of first bytes upwards, each
    sorted suffix then places its predecessor, if that is larger than it, at the end of the predecessor's
    bucket so far. Suffixes that neither are wanted nor place a wanted one are left out.
    """
    n = len(text)
    if not len(want):
        return want
    word = _words8(text) if word is None else word
    step = np.sign(np.diff(np.append(text, 0).astype(np.int16)))
    # a run of equal bytes is of the type of the step that ends it
    nxt = np.minimum.accumulate(np.where(step != 0, np.arange(n), n)[::-1])[::-1]
    small = np.where(nxt < n, step[np.minimum(nxt, n - 1)] > 0, True)
    needed = np.zeros(n + 1, bool)
    needed[want] = True
    edge = want[~small[want]] + 1
    edge = edge[(edge < n) & ~needed[np.minimum(edge, n)]]
    while len(edge):  # what places a wanted suffix is needed as well
        needed[edge] = True
        edge = edge[~small[edge]] + 1
        edge = edge[(edge < n) & ~needed[np.minimum(edge, n)]]
    p = np.flatnonzero(needed[:n] & small)
    p = p[np.lexsort([word[p + 8], word[p]])]
    if len(p) > 1:
        tied = (word[p][1:] == word[p][:-1]) & (word[p + 8][1:] == word[p + 8][:-1])
        group = np.concatenate([[0], np.cumsum(~tied)])
        again = np.flatnonzero(np.append(tied, False) | np.insert(tied, 0, False))
        q = p[again]
        p[again] = q[np.lexsort([*(word[q + 8 * k] for k in (6, 5, 4, 3, 2)), group[again]])]
    heads = np.searchsorted(text[p], np.arange(257))
    # the last suffix may be the larger kind: what follows the text is smaller than all
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if needed[n - 1] and not small[n - 1]:
        waiting[text[n - 1]].append(np.array([n - 1]))
    out = []

    def place(q: np.ndarray, c: int) -> np.ndarray:
        """Hand out the larger predecessors of ``q``; those of this bucket are returned."""
        q = q[q > 0] - 1
        q = q[needed[q] & ~small[q]]
        if not len(q):
            return q
        b = text[q]
        order = np.argsort(b, kind="stable")
        q, b = q[order], b[order]
        cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        own = q[:0]
        for lo, hi in zip(cut, np.append(cut[1:], len(b)), strict=True):
            if b[lo] == c:
                own = q[lo:hi]
            else:
                waiting[b[lo]].append(q[lo:hi])
        return own

    for c in range(256):
        q = np.concatenate(waiting[c]) if waiting[c] else p[:0]
        while len(q):
            out.append(q)
            q = place(q, c)
        s = p[heads[c]:heads[c + 1]]
        if len(s):
            out.append(s)
            place(s, c)
    order = np.concatenate(out)
    keep = np.zeros(n + 1, bool)
    keep[want] = True
    return order[keep[order]]


def common_prefixes(word: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each but the first of ``order``, the bytes (to MATCH) it shares with the one before it."""
    a, b = order[:-1], order[1:]
    out = np.full(len(b), MATCH, np.int64)
    open_ = np.ones(len(b), bool)
    for k in range(0, 56, 8):
        x = word[a + k] ^ word[b + k]
        hit = open_ & (x != 0)
        lead = sum((x < np.uint64(1 << s)).astype(np.int64) for s in range(8, 64, 8))
        out[hit] = np.minimum(MATCH, k + lead[hit])
        open_ &= ~hit
    return out


def _least_ids(t: pa.Table) -> pa.Table:
    """Sort a bucket's contexts and tell each block, for its entries, where a smaller id has the string."""
    blocks, hashes, ids, counts, texts, sizes = t["block"].to_pylist(), [], [], [], [], []
    for x in t["data"]:
        raw = x.as_py()
        k = int(np.frombuffer(raw, np.int64, 1)[0])
        sizes.append(k)
        hashes.append(np.frombuffer(raw, np.uint64, k, 8))
        ids.append(np.frombuffer(raw, np.int64, k, 8 + 8 * k))
        counts.append(np.frombuffer(raw, np.uint8, k, 8 + 16 * k).astype(np.int64))
        texts.append(np.frombuffer(raw, np.uint8, -1, 8 + 17 * k))
    c, least, n, text = (np.concatenate(x) for x in (hashes, ids, counts, texts))
    size = n + MATCH - 1
    at = np.cumsum(size) - size
    # equal contexts of different blocks become one; equal hashes are confirmed byte by byte
    order = np.lexsort([size, c])
    a, b = order[:-1], order[1:]
    same = (c[a] == c[b]) & (size[a] == size[b])
    padded = np.concatenate([text, np.zeros(CONTEXT, np.uint8)])
    wide = np.arange(CONTEXT)
    for i in range(0, len(same), 1 << 15):
        hit = i + np.flatnonzero(same[i:i + (1 << 15)])
        diff = (padded[at[a[hit]][:, None] + wide] != padded[at[b[hit]][:, None] + wide]) & (wide < size[a[hit]][:, None])
        same[hit[diff.any(1)]] = False
    new = np.concatenate([[True], ~same])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    rep = order[new]
    id_of = np.minimum.reduceat(least[order], np.flatnonzero(new))
    rsize, rn = size[rep], n[rep]
    begin = np.cumsum(rsize) - rsize
    joined = text[np.arange(int(rsize.sum())) + np.repeat(at[rep] - begin, rsize)]
    first = np.cumsum(rn) - rn
    want = np.arange(int(rn.sum())) + np.repeat(begin - first, rn)
    owner = np.repeat(np.arange(len(rep)), rn)
    word = _words8(joined)
    ranked = two_stage_order(joined, want, word)
    group = np.concatenate([[0], np.cumsum(common_prefixes(word, ranked) < MATCH)])
    slot = np.searchsorted(want, ranked)
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    best = np.empty(len(want), np.int64)
    best[slot] = np.minimum.reduceat(id_of[owner[slot]], heads)[group]
    # stretches of a context with one smallest id
    cut = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (best[1:] != best[:-1])]))
    r_owner, r_best = owner[cut], best[cut]
    r_lo = cut - first[r_owner]
    r_hi = np.append(cut[1:], len(want)) - first[r_owner]
    r_first = np.searchsorted(r_owner, np.arange(len(rep) + 1))
    out: list[list] = [[], [], []]
    entry0 = 0
    for block, k, bucket in zip(blocks, sizes, t["bucket"].to_pylist(), strict=True):
        mine = kind[entry0:entry0 + k]
        per = r_first[mine + 1] - r_first[mine]
        e = np.repeat(np.arange(k), per)
        r = np.arange(int(per.sum())) + np.repeat(r_first[mine] - (np.cumsum(per) - per), per)
        ok = r_best[r] < least[entry0 + e]
        e, r = e[ok], r[ok]
        entry0 += k
        if len(e):
            out[0].append(block)
            out[1].append(bucket)
            out[2].append(np.int64(len(e)).tobytes() + r_best[r].tobytes() + e.astype(np.int32).tobytes()
                          + r_lo[r].astype(np.uint8).tobytes() + r_hi[r].astype(np.uint8).tobytes())
    return _rows(_TOLD, out)


# ---- removal ------------------------------------------------------------------------------------------

def _ragged(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The ``many`` numbers from each start."""
    return np.arange(int(many.sum())) + np.repeat(start - (np.cumsum(many) - many), many)


def _covered(t: pa.Table, told: pa.Table, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's bytes, its offsets, and which bytes go."""
    kinds, data = np.array(told["bucket"].to_pylist(), np.int64), told["data"]
    buf, offs, ids, runs, entries = _contexts(t, [data[int(i)].as_py() for i in np.flatnonzero(kinds < 0)])
    gone = np.zeros(len(buf), bool)
    if runs is None:
        return buf, offs, gone
    d, s, n, entry = runs
    h, _, least, size, _ = entries
    size = size.astype(np.int64)
    first = np.cumsum(size) - size  # the strings of an entry side by side
    best = np.repeat(least, size)
    base = {b: lo for b, lo, _ in _sliced(h, n_buckets)}
    for i in np.flatnonzero(kinds >= 0):
        raw = data[int(i)].as_py()
        k = int(np.frombuffer(raw, np.int64, 1)[0])
        least_id = np.frombuffer(raw, np.int64, k, 8)
        e = np.frombuffer(raw, np.int32, k, 8 + 8 * k) + base[int(kinds[i])]
        lo = np.frombuffer(raw, np.uint8, k, 8 + 12 * k).astype(np.int64)
        many = np.frombuffer(raw, np.uint8, k, 8 + 13 * k).astype(np.int64) - lo
        best[_ragged(first[e] + lo, many)] = np.repeat(least_id, many)
    marks = np.zeros(len(buf) + 1, np.int32)
    for i in range(0, len(d), 1 << 15):
        j = slice(i, i + (1 << 15))
        many = n[j].astype(np.int64)
        hit = best[_ragged(first[entry[j]], many)] < np.repeat(ids[d[j]], many)
        marks[_ragged(s[j].astype(np.int64), many)[hit]] = 1
    total = np.cumsum(marks)
    back = np.concatenate([np.zeros(MATCH, np.int32), total[:len(buf) - MATCH]]) if len(buf) >= MATCH else np.zeros(len(buf), np.int32)
    return buf, offs, (total[:len(buf)] - back) > 0


def _spans(gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _whole_characters(raw: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` without the characters that it would only take a part of."""
    head = (raw & 0xC0) != 0x80
    char = np.cumsum(head) - 1
    kept = np.bincount(char[~gone], minlength=char[-1] + 1 if len(char) else 0) > 0
    return gone & ~kept[char] if len(char) else gone


def _report(n_buckets: int):
    def run(t: pa.Table, told: pa.Table) -> pa.Table:
        rows: list[list] = [[], [], [], [], []]
        if t.num_rows:
            buf, offs, gone = _covered(t, told, n_buckets)
            for i, doc in enumerate(t["doc_id"].to_pylist()):
                raw, g = buf[offs[i]:offs[i + 1]], gone[offs[i]:offs[i + 1]]
                rows[0].append(doc)
                rows[1].append(len(raw))
                rows[2].append(int(g.sum()))
                rows[3].append(len(_spans(g)[0]))
                rows[4].append(hashlib.sha256(raw[~g].tobytes()).hexdigest())
        return pa.table({"doc_id": pa.array(rows[0], pa.int64()), **{k: pa.array(v, pa.int64()) for k, v in zip(("n_bytes", "n_removed", "n_spans"), rows[1:4], strict=True)},
                         "kept_sha256": pa.array(rows[4], pa.string())})
    return run


def _clean(n_buckets: int, columns: list[str]):
    def run(t: pa.Table, told: pa.Table) -> pa.Table:
        buf, offs, gone = _covered(t, told, n_buckets) if t.num_rows else (None, None, None)
        texts = []
        for i in range(t.num_rows):
            raw, g = buf[offs[i]:offs[i + 1]], gone[offs[i]:offs[i + 1]]
            texts.append(raw[~_whole_characters(raw, g)].tobytes().decode() if g.any() else raw.tobytes().decode())
        out = {}
        for c in columns:
            if c == "text":
                out[c] = pa.array(texts, pa.string())
            elif c == "n_chars":
                out[c] = pa.array([len(x) for x in texts], pa.int64())
            else:
                out[c] = t[c]
        return pa.table(out)
    return run


# ---- jobs ---------------------------------------------------------------------------------------------

def _blocks(docs: DataFrame, n_blocks: int) -> DataFrame:
    """``docs`` with ``_block``, ``_id``, ``_text``, written once in files by block: later passes read whole blocks
    without shuffling the texts again."""
    spark = docs.sparkSession
    n_files = min(n_blocks, MAX_BUCKETED)
    out = (docs.withColumn("_id", F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long")).withColumn("_text", F.coalesce("text", F.lit("")))
           .drop("text").withColumn("_block", F.pmod(F.xxhash64("_id", F.octet_length("_text")), F.lit(n_blocks)).cast("int")))
    name = f"suffix_blocks_{uuid.uuid4().hex[:12]}"
    (out.repartition(n_files, "_block").write.bucketBy(n_files, "_block").option("path", scratch(spark, "suffix-blocks"))
     .saveAsTable(name))
    back = spark.table(name)
    back.schema  # noqa: B018  resolved now; the files outlive the name
    spark.sql(f"DROP TABLE {name}")
    return back


def _solve(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Blocks, what the buckets tell them, and the number of context buckets."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = _blocks(docs, max(1, -(-size // BLOCK_BYTES)))
    n_anchor = max(1, -(-size * 2 * 8 // (WINDOW + 1) // ANCHOR_BUCKET_BYTES))
    by = blocks.select("_block", "_id", "_text")
    sent = by.groupBy("_block").applyInArrow(released(_send_anchors(n_anchor)), _SENT)
    shared = stored(sent.groupBy("bucket").applyInArrow(released(_shared_anchors(CONTEXT_BUCKET_ENTRIES)), _TOLD), "suffix-anchors")
    n_entries = shared.agg(F.sum(-1 - F.col("bucket").cast("long"))).first()[0] or 0
    n_ctx = max(1, -(-n_entries // CONTEXT_BUCKET_ENTRIES))
    ctx = by.groupBy("_block").cogroup(shared.groupBy("_block")).applyInArrow(released(_send_contexts(n_ctx)), _SENT)
    least = stored(ctx.groupBy("bucket").applyInArrow(released(_least_ids), _TOLD), "suffix-least")
    return blocks, shared.unionByName(least), n_ctx


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    blocks, told, n = _solve(docs.select("doc_id", "text"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return blocks.groupBy("_block").cogroup(told.groupBy("_block")).applyInArrow(released(_report(n)), schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated bytes; columns unchanged, ``n_chars`` counted anew.

    Texts stay valid: a character of which the rule takes some bytes only is kept whole. Documents of which
    nothing but white space is left go.
    """
    blocks, told, n = _solve(docs)
    out = blocks.groupBy("_block").cogroup(told.groupBy("_block")).applyInArrow(released(_clean(n, docs.columns)), docs.schema)
    return out.filter(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "") != "")
