"""Chunking and chunk enrichment.

The recursive splitter and the greedy packer are higher-order SQL expressions, so a
document is chunked inside the task that scanned it: no shuffle, no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparqa.functions.text import col_of, regex_literal, strip

# Split levels of the recursive splitter, coarsest first, and the
# default chunk size / overlap of the indexer.
SEPARATORS = ["\n\n", "\n", ".", " ", ""]
DEFAULT_CHUNK_SIZE = 500
DEFAULT_OVERLAP = 50
# The method names the entry point knows; only "recursive" is implemented.
METHODS = ["character", "recursive", "document", "semantic"]
# Default mention pattern of the regex tagger: capitalised words.
ENTITY_PATTERN = r"\p{Lu}\p{Ll}+"


def _split_level(text: Column, seps: list[str], size: int) -> Column:
    sep = seps[0]
    parts = F.split(text, regex_literal(sep), -1) if sep else F.array(text)
    rest = seps[1:]
    if not rest:
        return F.transform(parts, lambda p: strip(p))
    return F.flatten(F.transform(
        parts,
        lambda p: F.when(F.length(p) > size, _split_level(p, rest, size))
                   .otherwise(F.array(strip(p)))))


def split_pieces(text: Column | str, chunk_size: int = DEFAULT_CHUNK_SIZE,
                 separators: list[str] | None = None) -> Column:
    """array<string> of stripped pieces.

    Split at the coarsest separator (always, even when the text fits); a part longer
    than ``chunk_size`` goes on to the next separator, any other part is stripped and
    kept. Separators are dropped from the output.
    """
    seps = list(SEPARATORS if separators is None else separators)
    if not seps:
        return F.array(col_of(text))
    return _split_level(F.coalesce(col_of(text), F.lit("")), seps, chunk_size)


def _pack_step(chunk_size: int):
    def step(acc, p):
        fits = F.length(acc["buf"]) + F.length(p) + 1 <= chunk_size
        return F.when(fits, F.struct(acc["chunks"].alias("chunks"),
                                     F.concat(acc["buf"], p, F.lit(" ")).alias("buf"))) \
                .otherwise(F.struct(F.concat(acc["chunks"], F.array(strip(acc["buf"]))).alias("chunks"),
                                    p.alias("buf")))
    return step


def pack_pieces(pieces: Column, chunk_size: int = DEFAULT_CHUNK_SIZE) -> Column:
    """C2 + C3: greedy packing of pieces into chunks, blank chunks dropped.

    A piece is appended with a trailing space while ``len(buf) + len(piece) + 1``
    fits; otherwise the stripped buffer is emitted and the buffer restarts as the
    bare piece (no trailing space, so the next piece is glued on without one).
    One flat fold, quadratic in a long document's chunk count; ``pack_blocked`` (used by
    ``chunk_text``) gives the same result in linear work.
    """
    init = F.struct(F.array().cast("array<string>").alias("chunks"), F.lit("").alias("buf"))
    step = _pack_step(chunk_size)

    def finish(acc):
        return F.when(acc["buf"] != "", F.concat(acc["chunks"], F.array(strip(acc["buf"])))) \
                .otherwise(acc["chunks"])

    return F.filter(F.aggregate(pieces, init, step, finish), lambda c: c != "")


def _let(value: Column, body) -> Column:
    """Bind ``value`` once and use it in ``body`` (a lambda variable is evaluated once)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _buffer_after(chunk_size: int):
    """Buffer-only step of the packer (what the buffer holds after one more piece)."""
    def step(buf, p):
        return F.when(F.length(buf) + F.length(p) + 1 <= chunk_size, F.concat(buf, p, F.lit(" "))).otherwise(p)
    return step


def pack_blocked(pieces: Column, chunk_size: int = DEFAULT_CHUNK_SIZE, block: int | None = None) -> Column:
    """C2 + C3 with work linear in the number of pieces (same result as ``pack_pieces``).

    A fold rebuilds its accumulator at every step, so one flat fold that collects
    chunks costs pieces x chunks for a single document. Here the pieces are cut into
    blocks (``block``, default max(128, sqrt(pieces))); pass 1 folds over the blocks
    carrying only the packer's buffer and records each block's entry buffer; pass 2
    packs every block on its own from that buffer; the lists are flattened and the last
    buffer is flushed. Every accumulator stays small. Intermediate values are bound
    once with ``_let`` so the optimizer cannot duplicate them.
    """
    after = _buffer_after(chunk_size)
    step = _pack_step(chunk_size)

    def with_pieces(ps):
        n = F.size(ps)
        width = F.lit(block) if block else F.greatest(F.lit(128), F.ceil(F.sqrt(n)).cast("int"))
        return _let(width, lambda w: _let(
            F.when(n > 0, F.transform(F.sequence(F.lit(0), (F.ceil(n / w) - 1).cast("int")),
                                      lambda i: F.slice(ps, i * w + 1, w)))
             .otherwise(F.array().cast("array<array<string>>")),
            with_blocks))

    def with_blocks(bl):
        entry = F.aggregate(
            bl, F.struct(F.array().cast("array<string>").alias("bufs"), F.lit("").alias("buf")),
            lambda acc, blk: F.struct(F.concat(acc["bufs"], F.array(acc["buf"])).alias("bufs"),
                                      F.aggregate(blk, acc["buf"], after).alias("buf")))
        return _let(entry, lambda en: _let(
            F.flatten(F.transform(bl, lambda blk, i: F.aggregate(
                blk, F.struct(F.array().cast("array<string>").alias("chunks"),
                              F.element_at(en["bufs"], i + 1).alias("buf")),
                step, lambda st: st["chunks"]))),
            lambda flat: F.when(en["buf"] != "", F.concat(flat, F.array(strip(en["buf"])))).otherwise(flat)))

    return F.filter(_let(pieces, with_pieces), lambda c: c != "")


def check_method(method: str) -> None:
    if method != "recursive":
        raise ValueError(f"Invalid chunking method: {method}. Choose from {METHODS}.")


def chunk_text(text: Column | str, chunk_size: int = DEFAULT_CHUNK_SIZE,
               overlap: int = DEFAULT_OVERLAP, method: str = "character",
               separators: list[str] | None = None, block: int | None = None) -> Column:
    """C4: chunk entry point -> array<string>.

    Only ``method="recursive"`` is implemented; any other name (the default
    included) raises up front. ``overlap`` is accepted and not used.
    """
    del overlap
    check_method(method)
    return pack_blocked(split_pieces(text, chunk_size, separators), chunk_size, block)


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    chunk_size: int = DEFAULT_CHUNK_SIZE, method: str = "recursive",
                    separators: list[str] | None = None) -> DataFrame:
    """C4 + C5: one row per chunk ``(id, pos, chunk)``, pos = order inside the document."""
    check_method(method)
    arr = chunk_text(F.col(text_col), chunk_size, method=method, separators=separators)
    return docs.select(F.col(id_col), F.posexplode(arr).alias("pos", "chunk"))


def chunk_stats(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of chunks and number of documents that produced at least one."""
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"),
                      F.count_distinct(F.col(id_col)).alias("n_docs"))


def entity_mentions(chunks: DataFrame, key_cols: list[str], text_col: str = "chunk",
                    pattern: str = ENTITY_PATTERN, label: str = "TERM") -> DataFrame:
    """Default mention finder for C6: regex matches as ``(keys, m_idx, text, label)``.

    A model-backed tagger plugs in by producing the same long table.
    """
    return chunks.select(*key_cols,
                         F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), 0))
                         .alias("m_idx", "m_text")) \
                 .withColumn("m_label", F.lit(label))


def enrich_inline(text: Column | str, pattern: str = ENTITY_PATTERN, label: str = "TERM") -> Column:
    """C6 with a regex tagger, computed inside the row (no join, no shuffle)."""
    t = col_of(text)
    found = F.regexp_extract_all(t, F.lit(pattern), 0)
    listed = F.array_join(F.transform(found, lambda m: F.concat(m, F.lit(f"({label})"))), ", ")
    return F.when(F.size(found) > 0, F.concat(t, F.lit("\n\n[Entities: "), listed, F.lit("]"))) \
            .otherwise(t)


def enrich_entities(chunks: DataFrame, mentions: DataFrame, key_cols: list[str],
                    text_col: str = "chunk") -> DataFrame:
    """Append ``\\n\\n[Entities: t1(L1), t2(L2)]`` in occurrence order, duplicates kept.

    Mentions are aggregated per chunk first (partial aggregate, one row per chunk
    leaves the map side) and then joined back, so the chunk text never shuffles twice.
    """
    per_chunk = mentions.groupBy(*key_cols).agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("m_idx", "m_text", "m_label"))),
            lambda m: F.concat(m["m_text"], F.lit("("), m["m_label"], F.lit(")"))), ", ").alias("_ents"))
    out = chunks.join(per_chunk, on=key_cols, how="left")
    return out.withColumn(
        text_col,
        F.when(F.col("_ents").isNotNull(),
               F.concat(F.col(text_col), F.lit("\n\n[Entities: "), F.col("_ents"), F.lit("]")))
         .otherwise(F.col(text_col))).drop("_ents")
