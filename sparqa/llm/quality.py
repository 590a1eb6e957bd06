"""Quality rules as a short-circuit cascade (native DataFrame expressions only).

Every rule is a boolean expression that rejects a document. Cost and selectivity are measured on a bounded sample: a rule's
cost is the least time of several runs over it less that of a rule that does nothing, so planning, reading and the words of the text
do not count; its selectivity is its share of what the rules before it leave. The cascade tries rules by falling rejection
per cost, and a CASE expression leaves the remaining rules unevaluated once one has rejected. The verdict does not
depend on the order, only the work does.

Edge cases: a NULL or blank text has no words, so it fails the base rule; NULL ids and extra columns
pass through unchanged; repeated rows are judged one by one; an empty table gives an empty table.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparqa.llm.common import GAP, stored, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Rows on which rules are timed, and runs of each; a bound on work, not on what is judged.
SAMPLE_ROWS = 1000
RUNS = 3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it, wherever Catalyst moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Document:
    """What rules are made of: expressions over a text and its bound list of words."""

    def __init__(self, text: Column, words: Column):
        self.text, self.words = text, words
        self.n_words = F.size(words).cast("long")

    @property
    def word_chars(self) -> Column:
        return F.length(F.regexp_replace(self.text, GAP, "")).cast("long")

    @property
    def n_symbols(self) -> Column:
        return (F.length(self.text) - F.length(F.translate(self.text, SYMBOLS, ""))).cast("long")

    @property
    def lines(self) -> Column:
        """Lines with a word."""
        return F.filter(F.split(self.text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    @property
    def n_dup_lines(self) -> Column:
        return let(self.lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))

    @property
    def n_repeat_words(self) -> Column:
        """Words covered by 3-word windows that occur twice or more."""
        w = self.words
        hashes = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(hashes, _covered_words)).cast("long")

    @property
    def with_letter(self) -> Column:
        return F.size(F.filter(self.words, lambda x: x.rlike(r"\p{L}")))

    @property
    def capitals(self) -> Column:
        return F.length(F.regexp_replace(self.text, r"[^\p{Lu}]+", ""))


def _covered_words(windows: Column) -> Column:
    n = F.size(windows)
    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = lambda a, b: (a >= 0) & (b < n) & (F.get(s, a)["h"] == F.get(s, b)["h"])
        hits = F.filter(s, lambda x, i: same(i - 1, i) | same(i, i + 1))
        return F.sort_array(F.transform(hits, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        nxt = lambda i: F.coalesce(F.get(p, i + 1), F.lit(2**31 - 1))
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), nxt(i) - x)), F.lit(0), lambda a, x: a + x)

    return F.when(F.size(F.array_distinct(windows)) == n, F.lit(0)).otherwise(let(ranked, lambda s: let(starts(s), covered)))


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives the condition on which a document goes."""
    name: str
    rejects: Callable[[Document], Column]


BASE_RULES = (
    Rule("too_short", lambda d: d.n_words < MIN_WORDS),
    Rule("repeated_phrases", lambda d: 100 * d.n_repeat_words > 50 * d.n_words),
)
#: Published web-text thresholds: symbol share, word length, duplicate lines, words with a letter, capitals.
CONTENT_RULES = (
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
    Rule("short_words", lambda d: d.word_chars < 3 * d.n_words),
    Rule("long_words", lambda d: d.word_chars > 10 * d.n_words),
    Rule("duplicate_lines", lambda d: let(d.lines, lambda x: 10 * (F.size(x) - F.size(F.array_distinct(x))) > 3 * F.size(x))),
    Rule("words_with_letters", lambda d: 10 * d.with_letter < 8 * d.n_words),
    Rule("capitals", lambda d: 2 * d.capitals > d.word_chars),
)


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def cascade(rules: Sequence[Rule], d: Document) -> Column:
    """True if no rule rejects; rules after the first rejecting one are not evaluated."""
    out = F
    for r in rules:
        out = out.when(F.coalesce(r.rejects(d), F.lit(False)), F.lit(False))
    return F.lit(True) if out is F else out.otherwise(F.lit(True))


def by_rejection_per_cost(rules: Sequence[Rule], costs: dict[str, float], seen: dict[str, int]) -> list[Rule]:
    """Each time the rule that rejects most per cost of the documents that the rules before it leave.

    ``seen``: documents of the sample by which rules reject them (a 0 or 1 for each rule, in order).
    """
    left, out, todo = dict(seen), [], list(range(len(rules)))
    while todo:
        total = max(sum(left.values()), 1)
        best = max(todo, key=lambda i: (sum(n for bits, n in left.items() if bits[i] == "1") / total / costs[rules[i].name], -i))
        left = {bits: n for bits, n in left.items() if bits[best] == "0"}
        todo.remove(best)
        out.append(rules[best])
    return out


def plan_order(df: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by falling rejection per cost, both measured on a sample of about ``sample_rows`` rows."""
    if len(rules) < 2:
        return list(rules)
    part = stored(df.select(text).sample(min(1.0, sample_rows / max(df.count(), 1)), seed=7), "quality-sample")
    t = _text(text)
    rejects = lambda r, w: F.coalesce(r.rejects(Document(t, w)), F.lit(False))
    bits = let(words(t), lambda w: F.concat(*[rejects(r, w).cast("int").cast("string") for r in rules]))
    seen = {r["b"]: r["count"] for r in part.groupBy(bits.alias("b")).count().collect()}  # at most a row for each sampled one

    def clock(rule: Rule | None) -> float:
        hit = let(words(t), lambda w: rejects(rule, w) if rule else F.size(w) < 0)
        began = time.perf_counter()
        part.agg(F.sum(hit.cast("int"))).first()
        return time.perf_counter() - began
    least: dict[str, float] = {}
    for _ in range(RUNS):  # in turn, so that a slow moment of the machine does not fall on one rule; the first run is a warm-up
        for rule in (None, *rules):
            name = rule.name if rule else ""
            least[name] = min(least.get(name, float("inf")), clock(rule))
    # what cannot be told from nothing costs a hundredth of the empty run
    floor = max(least[""] / 100, 1e-6)
    return by_rejection_per_cost(rules, {r.name: max(least[r.name] - least[""], floor) for r in rules}, seen)


def quality_filter(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that pass every rule, columns unchanged."""
    rules = plan_order(df, BASE_RULES + CONTENT_RULES, text)
    t = _text(text)
    return df.filter(let(words(t), lambda w: cascade(rules, Document(t, w))))


def report(df: DataFrame) -> DataFrame:
    """One row per document: counts and verdict. The cascade of content rules runs where the base has passed."""
    rules = plan_order(df, CONTENT_RULES)
    t = _text("text")

    def judged(w: Column) -> Column:
        d = Document(t, w)
        counts = F.struct(*(getattr(d, c).alias(c) for c in COUNTS))
        return let(counts, lambda c: F.struct(c.alias("c"), failed(c).alias("base_failed"), F.when(failed(c), F.lit(False)).otherwise(cascade(rules, d)).alias("kept")))

    failed = lambda c: (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
    out = df.select("doc_id", let(words(t), judged).alias("_j"))
    return out.select("doc_id", *(F.col(f"_j.c.{c}").alias(c) for c in COUNTS), "_j.base_failed", "_j.kept")
