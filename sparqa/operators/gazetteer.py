"""Entity mentions from a table of names (C6): many surfaces and labels, found by an Aho-Corasick automaton.

A mention is an occurrence of a surface that no letter or digit touches on either side. Where occurrences overlap the
leftmost wins, and of those with one start the longest. Case matters. A surface with several labels takes the smallest.

The table is dealt into parts of at most ``PART_SURFACES`` rows by a count made first. One part travels with the tasks, which
tag their chunks where they lie: no shuffle. More parts meet blocks of chunks in a grid of (part, block) groups, each
bounded on both sides; spans of all parts are then brought together per chunk, and overlaps are resolved there.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_SURFACES = 100_000
BLOCK_CHUNKS = 20_000
SPANS = "array<struct<start:int,text:string,label:string>>"


def surfaces(entities: DataFrame) -> DataFrame:
    """(surface, label): one row per surface; empty and missing surfaces are left out."""
    return (entities.where("surface <> ''").groupBy("surface").agg(F.min("label").alias("label"))
            .select("surface", F.coalesce("label", F.lit("")).alias("label")))


def automaton(rows: Iterable[tuple[str, str]]):
    """The automaton of (surface, label) rows, or None for no rows."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for surface, label in rows:
        a.add_word(surface, (len(surface), surface, label))
    if not len(a):
        return None
    a.make_automaton()
    return a


def occurrences(a, text: str) -> list[tuple[int, str, str]]:
    """(start, surface, label) of the longest occurrence at each start, in order of starts."""
    best: dict[int, tuple[int, str, str]] = {}
    if a is None or not text:
        return []
    last = len(text) - 1
    for end, (size, surface, label) in a.iter(text):
        start = end - size + 1
        if (start == 0 or not text[start - 1].isalnum()) and (end == last or not text[end + 1].isalnum()):
            if start not in best or best[start][0] < size:
                best[start] = (size, surface, label)
    return [(s, best[s][1], best[s][2]) for s in sorted(best)]


def without_overlaps(spans: list[tuple[int, str, str]]) -> list[tuple[int, str, str]]:
    """Leftmost first; what begins inside a span that was taken goes."""
    out, free = [], 0
    for s, surface, label in spans:
        if s >= free:
            out.append((s, surface, label))
            free = s + len(surface)
    return out


def _array(rows: list[list[tuple[int, str, str]]]) -> pa.Array:
    struct = pa.struct([("start", pa.int32()), ("text", pa.string()), ("label", pa.string())])
    return pa.array([[{"start": s, "text": t, "label": x} for s, t, x in r] for r in rows], pa.list_(struct))


def _tag_in_place(chunks: DataFrame, table: list[tuple[str, str]], text_col: str, out_col: str) -> DataFrame:
    schema = chunks.withColumn(out_col, F.lit(None).cast(SPANS)).schema

    def run(batches):
        a = automaton(table)
        for t in batches:
            found = [without_overlaps(occurrences(a, x)) for x in t.column(text_col).to_pylist()]
            cols = {c: t.column(c) for c in t.schema.names} | {out_col: _array(found)}
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema], [f.name for f in schema])
    return chunks.mapInArrow(run, schema)


def _tag_by_grid(chunks: DataFrame, table: DataFrame, parts: int, keys: list[str], text_col: str, out_col: str) -> DataFrame:
    n_blocks = max(1, -(-chunks.count() // BLOCK_CHUNKS))
    key = F.struct(*keys)
    left = chunks.select(key.alias("_key"), F.col(text_col).alias("_text"), F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int").alias("_block"),
                         F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    right = table.select("surface", "label", F.pmod(F.xxhash64("surface"), F.lit(parts)).cast("int").alias("_part"),
                         F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_block"))
    key_type = left.schema["_key"].dataType.simpleString()

    def run(texts: pa.Table, names: pa.Table) -> pa.Table:
        a = automaton(zip(names["surface"].to_pylist(), names["label"].to_pylist(), strict=True))
        found = [occurrences(a, x) for x in texts["_text"].to_pylist()]
        hit = [i for i, f in enumerate(found) if f]
        return pa.table({"_key": texts["_key"].take(pa.array(hit, pa.int64())), "_spans": _array([found[i] for i in hit])})
    spans = left.groupBy("_part", "_block").cogroup(right.groupBy("_part", "_block")).applyInArrow(run, f"_key {key_type}, _spans {SPANS}")
    # leftmost, then longest; a chunk's spans are bounded by its length
    ordered = F.array_sort(F.flatten(F.collect_list("_spans")), lambda x, y: F.when(x.start != y.start, x.start - y.start)
                           .otherwise(F.length(y.text) - F.length(x.text)))
    empty = F.struct(F.lit(0).alias("free"), F.array().cast(SPANS).alias("taken"))
    fold = F.aggregate("_all", empty, lambda acc, s: F.when(s.start >= acc.free, F.struct(
        (s.start + F.length(s.text)).alias("free"), F.concat(acc.taken, F.array(s)).alias("taken"))).otherwise(acc), lambda acc: acc.taken)
    per = spans.groupBy("_key").agg(ordered.alias("_all")).select("_key", fold.alias(out_col))
    per = per.select(*[F.col("_key")[k].alias(f"_k{i}") for i, k in enumerate(keys)], out_col)
    same = None
    for i, k in enumerate(keys):
        c = chunks[k].eqNullSafe(per[f"_k{i}"])
        same = c if same is None else same & c
    out = chunks.join(per, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    return out.withColumn(out_col, F.coalesce(out_col, F.array().cast(SPANS)))


def tag_mentions(chunks: DataFrame, entities: DataFrame, key_cols: list[str], text_col: str = "chunk", out_col: str = "mentions",
                 part_surfaces: int = PART_SURFACES) -> DataFrame:
    """``chunks`` with the mentions of the names in ``entities`` (surface, label), in order of occurrence.

    ``key_cols`` tell the chunks apart. A NULL text has no mentions.
    """
    names = surfaces(entities)
    parts = max(1, -(-names.count() // part_surfaces))
    if parts == 1:
        return _tag_in_place(chunks, [tuple(r) for r in names.collect()], text_col, out_col)  # at most part_surfaces rows
    return _tag_by_grid(chunks, names, parts, key_cols, text_col, out_col)


def entity_list(mentions: Column) -> Column:
    """The bracketed list of mentions, duplicates kept."""
    return F.concat(F.lit("\n\n[Entities: "), F.array_join(F.transform(mentions, lambda m: F.concat(m.text, F.lit("("), m.label, F.lit(")"))), ", "), F.lit("]"))


def enrich_from_table(chunks: DataFrame, entities: DataFrame, key_cols: list[str], text_col: str = "chunk",
                      part_surfaces: int = PART_SURFACES) -> DataFrame:
    """Chunks with mentions get their list appended, the others stay as they are."""
    tagged = tag_mentions(chunks, entities, key_cols, text_col, "_mentions", part_surfaces)
    text = F.when(F.size("_mentions") > 0, F.concat(F.col(text_col), entity_list(F.col("_mentions")))).otherwise(F.col(text_col))
    return tagged.withColumn(text_col, text).drop("_mentions")
