"""Spelling variants: words one edit apart, grouped under a far commoner form.

1. *Vocabulary.* Tasks count the words of their texts and send partial counts; a shuffle adds them up.
2. *Ranges.* Of two words one edit apart, the shorter one of M code points, either the first or the last M // 2 code points are
   the same. So each word goes to four lists: by its first and by its last half, for M its length and one less. A list of
   more than ``LIST_WORDS`` words is dealt out again by one half of what its words do not share yet, until none is longer
   or two code points or fewer are open; a pair counts only in the first list that it can meet in.
3. *Scan.* Spark sorts the lists. Every word is compared with the words after it in its list by a banded edit matrix with
   one row a letter of the other word. The rows of the prefix shared with the word before are kept; where all of a row is above one edit,
   all following words with that prefix are skipped.
4. *Forms.* Near words are counted and the commonest is found per list and then per word; a word's form is that word
   if it is at least ``RATIO`` times as common. Roots follow the forms by pointer jumping.

Edge cases: a NULL or empty text has no words; words have ``MIN_LETTERS`` code points at least, and no upper bound; equal counts are
told apart by code-point order; repeated rows count again; other columns do not matter; an empty table gives an empty vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparqa.llm.common import stored
from sparqa.llm.hashing import release

MIN_LETTERS, MIN_COUNT, RATIO = 7, 2, 10
#: Words of a list before it is dealt out again.
LIST_WORDS = 512
#: Words held by a counting task before it sends them on.
HELD_WORDS = 400_000
_NO_GUARD = 1 << 30
_SALTS = 16


def planted_slip(doc_id: int | None, word: str) -> str:
    """The query's planted slip: in one of 31 (document, word) pairs, by checksum, one code point is missing. A NULL id reads ``None``."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % 31:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def count_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", change: Callable[[int | None, str], str] | None = None,
                min_letters: int = MIN_LETTERS) -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case, after ``change``; those of fewer than ``min_letters`` code points are left out."""
    def run(batches):
        # no change lengthens a word, so shorter runs need no look
        find = re.compile(rf"[a-zÀ-ÿ]{{{min_letters},}}").findall
        held: Counter[str] = Counter()

        def out():
            words = list(held)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])
            held.clear()
        for t in batches:
            column = t.column(text).cast(pa.binary())
            for i, x in zip(t.column(doc_id).to_pylist(), column, strict=True):
                found = find((x.as_py() or b"").lower().decode())  # bytes.lower() changes A-Z only
                if change is None:
                    held.update(found)
                else:
                    for w, n in Counter(found).items():
                        w = change(i, w)
                        if len(w) >= min_letters:
                            held[w] += n
                if len(held) > HELD_WORDS:
                    yield from out()
        yield from out()
        release()
    part = docs.select(doc_id, text).mapInArrow(run, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def _dealt(df: DataFrame) -> DataFrame:
    """``key``: what the words of a list share, with the list's M, lengths and guard."""
    at = F.concat(F.expr("substring(word, 1, head)"), F.expr("right(word, tail)"))
    return df.withColumn("key", F.concat_ws("/", "m", "head", "tail", "guard", at))


def lists(words: DataFrame, limit: int = LIST_WORDS) -> DataFrame:
    """(key, m, head, tail, guard, word, n): each word once per list it belongs to.

    The words of a list have m or m + 1 code points and share their first ``head`` and last ``tail``; pairs that share
    ``guard`` or more first code points meet in another list.
    """
    half = "(m div 2)"
    size = F.length("word")
    todo = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).filter("m > 0")
    todo = todo.select("word", "n", "m", F.explode(F.array(
        F.expr(f"struct({half} AS head, 0 AS tail, {_NO_GUARD} AS guard)"), F.expr(f"struct(0 AS head, {half} AS tail, {half} AS guard)"))).alias("s"))
    todo = _dealt(todo.select("word", "n", "m", "s.*"))
    salted = [F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")]
    while True:
        todo = stored(todo, "spelling-lists")
        hot = stored(todo.filter("m - head - tail > 2").groupBy("key").agg(F.count("*").alias("_c")).filter(f"_c > {limit}").select("key"), "spelling-hot")
        if hot.isEmpty():
            return todo
        # a hot list is dealt over several tasks by a salt
        salt = todo.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(_SALTS)).cast("int"))
        mark = salt.join(hot.select("key", *salted).withColumn("_hot", F.lit(True)), ["key", "salt"], "left").drop("salt")
        step = "((m - head - tail) div 2)"
        again = F.expr(f"""CASE WHEN _hot THEN array(struct(head + {step} AS head, tail AS tail, guard AS guard),
                           struct(head AS head, tail + {step} AS tail, least(guard, head + {step}) AS guard))
                           ELSE array(struct(head AS head, tail AS tail, guard AS guard)) END""")
        todo = _dealt(mark.select("word", "n", "m", F.explode(again).alias("s")).select("word", "n", "m", "s.*"))


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 8:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    while a[lo] == b[lo]:
        lo += 1
    return lo


def scan(words: list[str], m: int, guard: int):
    """Pairs (i, j) of places in a sorted list of distinct words, i < j, that are one edit apart and share less than ``guard``."""
    n = len(words)
    share = [0, *(_shared(a, b) for a, b in zip(words, words[1:], strict=False))]  # with the word before
    less, stack = [n] * n, []  # the next place that shares less with its predecessor
    for i, s in enumerate(share):
        while stack and share[stack[-1]] > s:
            less[stack.pop()] = i
        stack.append(i)
    for i in range(n - 1):
        q = words[i]
        size, j, low = len(q), i + 1, len(q)
        # row d: edits between the first d letters of the other word and the first d - 1, d, d + 1 of q; 2 stands for more
        rows = [(2, 0, 1)] + [(1, 0, 1)] * share[j]
        while j < n:
            keep = share[j]
            low = min(low, keep)
            w = words[j]
            del rows[keep + 1:]
            depth = len(rows) - 1
            a, b, c = rows[depth]
            while depth < len(w):
                x = w[depth]
                u = min(a + (depth < 1 or depth > size or x != q[depth - 1]), b + 1, 2)
                v = min(b + (depth >= size or x != q[depth]), c + 1, u + 1, 2)
                c = min(c + (depth + 1 >= size or x != q[depth + 1]), v + 1, 2)
                a, b = u, v
                depth += 1
                if a + b + c == 6:
                    break
                rows.append((a, b, c))
            if len(rows) <= depth:  # over one edit: so are all words with these first letters
                j += 1
                while j < n and share[j] >= depth:
                    j = less[j]
                continue
            gap = size - len(w)
            if -1 <= gap <= 1 and (a, b, c)[gap + 1] == 1 and low < guard and not (size > m and len(w) > m):
                yield i, j
            j += 1


def near_words(words: DataFrame, limit: int = LIST_WORDS) -> DataFrame:
    """(word, n_near, near, near_n) of the words that have a word one edit away: how many, and the commonest with its count."""
    def run(batches):
        def of(key: list, group: list[tuple[str, int]]):
            _, m, guard = key
            count, best = [0] * len(group), [None] * len(group)
            for i, j in scan([w for w, _ in group], m, guard):
                for a, b in ((i, j), (j, i)):
                    count[a] += 1
                    other = (-group[b][1], group[b][0])
                    if best[a] is None or other < best[a]:
                        best[a] = other
            return [(w, c, b[1], -b[0]) for (w, _), c, b in zip(group, count, best, strict=True) if c]

        def batch(rows: list):
            w, c, b, k = zip(*rows, strict=True) if rows else ((),) * 4
            return pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(c, pa.int64()), pa.array(b, pa.string()), pa.array(k, pa.int64())],
                                              ["word", "n_near", "near", "near_n"])
        key, group, rows = [None], [], []
        for t in batches:
            cols = (t.column(c).to_pylist() for c in ("key", "m", "guard", "word", "n"))
            for k, m, guard, w, n in zip(*cols, strict=True):
                if k != key[0]:
                    if len(group) > 1:
                        rows += of(key, group)
                    key, group = [k, m, guard], []
                group.append((w, n))
            yield batch(rows)
            rows = []
        if len(group) > 1:
            yield batch(of(key, group))
        release()
    dealt = lists(words, limit).select("key", "m", "guard", "word", "n").repartition("key").sortWithinPartitions("key", "word")
    part = dealt.mapInArrow(run, "word string, n_near long, near string, near_n long")
    top = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))
    return (part.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("t"))
            .select("word", "n_near", F.col("t.near").alias("near"), (-F.col("t.m")).alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word on the way from ``word`` by its ``form``. Counts grow along the way, so it ends."""
    jump = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = jump.select(F.col("word").alias("root"), F.col("root").alias("_r"))
        jump = stored(jump.join(on, "root", "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_moved")), "spelling-roots")
        if jump.filter("_moved").isEmpty():
            return jump.select("word", "root")
        jump = jump.drop("_moved")


def variants(words: DataFrame, ratio: int = RATIO, limit: int = LIST_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a vocabulary (word, n) of distinct words, each with two code points or more."""
    words = stored(words.select("word", "n"), "spelling-words")
    near = near_words(words, limit)
    ok = F.col("near_n") >= ratio * F.col("n")
    df = stored(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                        F.when(ok, F.col("near")).alias("form"), F.when(ok, F.col("near_n")).alias("form_n")), "spelling-near")
    last = roots(df.filter("form IS NOT NULL"))
    return df.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    """The query's vocabulary: words of whole texts with planted slips, seen ``MIN_COUNT`` times or more, and their groups."""
    return variants(count_words(docs, change=planted_slip).filter(F.col("n") >= MIN_COUNT))
