"""Mixing sources to target weights (native DataFrame expressions only).

Documents of a source are packed end to end, as words, into blocks of a fixed length. A source's target, rounded to a
word, gives its slots: all blocks once for each whole pass, then blocks until the rest is met; the last slot takes only the
words still missing. Each output shard's counts of every source are one multinomial draw given the sources'
slots. The counts number the slots: a shard takes the next so many slots of a source. Slot j of a pass takes block
``walk(j)`` of the source's ``n`` blocks, a keyed pseudorandom permutation for each source and pass, and slots meet
blocks in a join on (source, block). All draws are hashes of keys and a seed: reruns agree.

The permutation is a Feistel network over (a, b) with a * b just above n; what falls outside is walked on until
it is inside again. It is inverted to find the slot of a source's last, shorter block.

Edge cases: NULL sources are one source of their own, last in order; NULL or blank texts have size 0 and
are never taken; repeated rows are rows of their own; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparqa.llm.common import buckets_for, stored, with_start, words

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 16384
TASK_SLOTS = 500_000
#: Steps of the walk back inside. At most a * b - n are ever needed, fewer than this for n up to 1,500; above
#: that a walk goes on with probability 1 / 19 a step at most.
WALK = 40
#: Above this many sources the per-source table is joined by shuffle instead of broadcast.
BROADCAST_SOURCES = 50_000
KEY = ["_nosrc", "_src"]


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("_nosrc", F.col("source").isNull().cast("int")).withColumn("_src", F.coalesce("source", F.lit("")))


def _ranked(src: DataFrame) -> DataFrame:
    """``src`` with ``_rank``, its place in the order of KEY: places inside ranges, and the sizes of the ranges before."""
    ranged = stored(src.repartitionByRange(*KEY).withColumn("_part", F.spark_partition_id()), "mix-ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_c")).withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*KEY)) - 1
    return ranged.withColumn("_in", inside).join(parts, "_part").withColumn("_rank", F.col("_in") + F.col("_off")).drop("_part", "_in", "_off")


def targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(key, source_size, target) for rows (key, size): shares of the whole by weight, each stopped at
    ``repeats`` times its source, the excess reshared by weight among the rest.

    The level (words a unit of weight) rises as sources stop at their caps; it is found by a few aggregates over the table of sources.
    """
    src = _ranked(sizes.groupBy(*KEY).agg(F.sum("size").alias("source_size")))
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("_rank", F.lit(len(weights))).cast("int"))
    src = stored(src.withColumn("_w", weight).withColumn("_cap", F.lit(float(repeats)) * F.col("source_size")), "mix-sources")
    total = float(src.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("_cap") <= F.lit(level) * F.col("_w")
        r = src.agg(F.sum(F.when(full, F.col("_cap")).otherwise(0.0)).alias("cap"), F.sum(F.when(full, 0.0).otherwise(F.col("_w"))).alias("w")).first()
        rest = max(level, (total - r["cap"]) / r["w"]) if r["w"] else level
        if rest <= level:
            break
        level = rest
    return src.select(*KEY, F.col("source_size").cast("long"), F.least(F.col("_cap"), F.lit(level) * F.col("_w")).alias("target"))


def _walked(x: Column, n: Column, turn: Column, seed: int, back: bool = False) -> Column:
    """Where the permutation of 0..n-1 of (source, turn) puts ``x``; ``back`` inverts it."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def step(v: Column) -> Column:
        left, right = F.floor(v / b).cast("long"), F.pmod(v, b)
        for k in (3, 2, 1, 0) if back else (0, 1, 2, 3):
            sign = -1 if back else 1
            if k % 2:
                right = F.pmod(right + sign * F.pmod(F.xxhash64(F.lit(seed + k), *KEY, turn, left), b), b)
            else:
                left = F.pmod(left + sign * F.pmod(F.xxhash64(F.lit(seed + k), *KEY, turn, right), a), a)
        return left * b + right
    first = step(x)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda v, _: F.when(v < n, v).otherwise(step(v)))
    return F.when(first < n, first).otherwise(walk)


def quotas(plan: DataFrame, block_words: int, seed: int) -> DataFrame:
    """The sources that give words, with ``_n`` blocks, ``_slots`` and what the last, unfinished pass takes."""
    size = F.col("source_size")
    plan = plan.filter("source_size > 0").withColumn("_want", F.round("target").cast("long")).filter("_want > 0")
    plan = plan.withColumn("_n", F.ceil(size / block_words).cast("long")).withColumn("_passes", F.floor(F.col("_want") / size).cast("long"))
    plan = plan.withColumn("_rest", F.col("_want") - F.col("_passes") * size).withColumn("_short", F.col("_n") * block_words - size)
    # the slot of the shorter block in the last pass; slots after it begin so many words earlier
    plan = plan.withColumn("_last", _walked(F.col("_n") - 1, F.col("_n"), F.col("_passes"), seed, back=True))
    least = F.ceil(F.col("_rest") / block_words).cast("long")
    more = (least > F.col("_last")) & (least * block_words - F.col("_short") < F.col("_rest"))
    return plan.withColumn("_slots", F.col("_passes") * F.col("_n") + least + more.cast("long"))


def _numbers(df: DataFrame, count: str, name: str, seed: int) -> DataFrame:
    """``df`` with a row for each number below ``count``, made by many tasks where the count is large."""
    step = 8192
    total = df.agg(F.sum(count)).first()[0] or 0
    df = df.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / step).cast("long"))))
    df = df.repartition(max(1, -(-total // TASK_SLOTS)), *(c for c in df.columns if c in (*KEY, "shard")), "_chunk")
    first = F.col("_chunk") * step
    return df.withColumn(name, F.explode(F.sequence(first, F.least(first + step, F.col(count)) - 1))).drop("_chunk")


def shard_counts(quota: DataFrame, seed: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(key, shard, count): how many slots every source has in every output shard, one multinomial draw a source by hashed uniforms."""
    total = quota.agg(F.sum("_slots")).first()[0] or 0
    n = max(1, -(-total // shard_slots))
    draws = _numbers(quota.select(*KEY, "_slots"), "_slots", "_i", seed)
    return draws.groupBy(*KEY, F.pmod(F.xxhash64(F.lit(seed + 9), *KEY, "_i"), F.lit(n)).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("count"))


def slots(plan: DataFrame, block_words: int, seed: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(key, block, pass, slot, words, part, shard) of every slot of the mix: the first ``words`` words of a block; ``part`` if these are not all."""
    quota = stored(quotas(plan, block_words, seed), "mix-quotas")
    counts = stored(shard_counts(quota, seed, shard_slots), "mix-counts")
    counts = with_start(counts, KEY, ["shard"], "count", "_from", buckets_for(counts.count()))
    out = _numbers(stored(counts, "mix-starts"), "count", "_k", seed).join(_small(quota), KEY)
    n, at = F.col("_n"), F.col("_from") + F.col("_k")
    out = out.withColumn("slot", at).withColumn("pass", F.floor(F.col("slot") / n).cast("long")).withColumn("_j", F.pmod("slot", n))
    out = out.withColumn("block", _walked(F.col("_j"), n, F.col("pass"), seed))
    whole = F.lit(block_words) - F.when(F.col("block") == n - 1, F.col("_short")).otherwise(F.lit(0))
    before = F.col("_j") * block_words - F.when(F.col("_j") > F.col("_last"), F.col("_short")).otherwise(F.lit(0))
    taken = F.when(F.col("pass") < F.col("_passes"), whole).otherwise(F.least(whole, F.col("_rest") - before))
    return out.select(*KEY, "block", "pass", "slot", taken.cast("long").alias("words"), (taken < whole).alias("part"), "shard")


def _layout(sized: DataFrame, rows: int, block_words: int) -> DataFrame:
    """``sized`` rows of at least a word with the place ``_at`` of their first word in their source."""
    order = [c for c in ("doc_id", "size", "_sum") if c in sized.columns]
    return with_start(sized.filter("size > 0"), KEY, order, "size", "_at", buckets_for(rows))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast the per-source table only after counting it."""
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


def report(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 11) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_shard) of every document under the mix of all of them; the last is the
    least output shard that takes words of it."""
    sized = stored(_keyed(docs.select("doc_id", "source", "text")).select(
        "doc_id", *KEY, F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("_sum")), "mix-sizes")
    plan = stored(targets(sized), "mix-targets")
    # at most one slot of a source takes a part of its block only
    uses = slots(plan, block_words, seed).groupBy(*KEY, "block").agg(
        F.sum((~F.col("part")).cast("long")).alias("_uses"), F.sum(F.when(F.col("part"), F.col("words")).otherwise(0)).alias("_part"), F.min("shard").alias("_shard"))
    at = _layout(sized, sized.count(), block_words)
    first, last = F.floor(F.col("_at") / block_words), F.floor((F.col("_at") + F.col("size") - 1) / block_words)
    parts = at.withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("_at"), F.col("block") * block_words)
    hi = F.least(F.col("_at") + F.col("size"), (F.col("block") + 1) * block_words)
    parts = parts.withColumn("_in", hi - lo).withColumn("_lo", lo - F.col("block") * block_words)
    inside = F.coalesce("_uses", F.lit(0)) * F.col("_in") + F.greatest(F.lit(0), F.least(F.coalesce("_part", F.lit(0)) - F.col("_lo"), F.col("_in")))
    taken = (parts.join(uses.hint("merge"), [*KEY, "block"], "left")  # uses grow with the corpus
             .groupBy(*KEY, "_at", "doc_id", "size").agg(F.sum(inside).cast("long").alias("taken"), F.min(F.when(inside > 0, F.col("_shard"))).alias("first_shard")))
    empty = sized.filter("size = 0").select(*KEY, "doc_id", "size", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("int").alias("first_shard"))
    rows = taken.select(*KEY, "doc_id", "size", "taken", "first_shard").unionByName(empty)
    return rows.join(_small(plan), KEY).select("doc_id", "size", "source_size", "target", "taken", "first_shard")


def mixed_pieces(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 11, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix itself: (_row, text, shard, slot, block, piece) for every slot and document in its block; ``_row`` has the other columns of ``docs``.

    A piece keeps its words and the white space before each of them; pieces of a slot follow one another by ``piece``,
    the place of the first word in the source. A document taken more than once appears once for each pass.
    """
    # the other columns travel as one, so that none clashes with those made here
    other = F.struct(F.lit(0).alias("_none"), *(c for c in docs.columns if c != "text")).alias("_row")
    keyed = _keyed(docs.select("doc_id", "source", "text", other)).withColumn("size", F.size(words(F.col("text"))).cast("long")).withColumn("_sum", F.xxhash64("text"))
    sized = stored(keyed.select("doc_id", *KEY, "size", "_sum"), "mix-sizes")
    rows = sized.count()
    plan = stored(targets(sized), "mix-targets")
    at = _layout(keyed, rows, block_words)
    first, last = F.floor(F.col("_at") / block_words), F.floor((F.col("_at") + F.col("size") - 1) / block_words)
    pieces = lambda c: F.regexp_extract_all(c, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)
    at = at.withColumn("_pieces", pieces("text"))

    def piece(b):
        lo = F.greatest(F.col("_at"), b * block_words)
        hi = F.least(F.col("_at") + F.col("size"), (b + 1) * block_words)
        text = F.concat_ws("", F.slice("_pieces", (lo - F.col("_at")).cast("int") + 1, (hi - lo).cast("int")))
        return F.struct(b.alias("block"), lo.alias("piece"), (lo - b * block_words).alias("_lo"), text.alias("text"))

    cut = at.withColumn("_cut", F.explode(F.transform(F.sequence(first, last), piece))).select(*KEY, "_row", "_cut.*")
    out = cut.join(slots(plan, block_words, seed, shard_slots).hint("merge"), [*KEY, "block"])
    short = F.concat_ws("", F.slice(pieces("text"), 1, F.greatest(F.col("words") - F.col("_lo"), F.lit(0)).cast("int")))
    out = out.withColumn("text", F.when(F.col("part"), short).otherwise(F.col("text"))).filter("text <> ''")
    return out.select("_row", "text", "shard", "slot", "block", "piece")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 11) -> DataFrame:
    """The pieces of the mix with the columns of ``docs``; ``n_chars`` is the piece's length."""
    out = mixed_pieces(docs, block_words, seed)
    made = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*(made.get(c, F.col("_row")[c].alias(c)) for c in docs.columns))
