"""Native (JVM-side) text expressions shared by all operators.

All of these are plain Column builders: they stay inside Catalyst and, where no
lambda is involved, inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes, derived from str.isspace() itself
# (Unicode White_Space plus the separators U+001C..U+001F).
STRIP_CHARS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
# Token rule of the deterministic stand-ins: lower-case, split on runs of
# characters that are neither letters nor digits, drop empties.
TOKEN_SPLIT_PATTERN = r"[^\p{L}\p{N}]+"
# Statement rule of the deterministic judge: split on '.', strip, drop empties.
STATEMENT_SPLIT_PATTERN = r"[.]"


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Unicode-aware strip, same characters as Python ``str.strip()`` (native trim, no regex)."""
    return F.trim(col_of(c), F.lit(STRIP_CHARS))


def is_blank(c: Column | str) -> Column:
    """True when NULL or empty after strip."""
    c = col_of(c)
    return c.isNull() | (strip(c) == "")


def tokens(c: Column | str) -> Column:
    """array<string> of lower-cased letter/digit runs (empties dropped)."""
    return F.filter(F.split(F.lower(col_of(c)), TOKEN_SPLIT_PATTERN, -1), lambda t: t != "")


def statements(c: Column | str) -> Column:
    """array<string>: text split on '.', each piece stripped, blanks dropped."""
    parts = F.transform(F.split(F.coalesce(col_of(c), F.lit("")), STATEMENT_SPLIT_PATTERN, -1),
                        lambda s: strip(s))
    return F.filter(parts, lambda s: s != "")


def regex_literal(sep: str) -> str:
    """Java-regex pattern that matches ``sep`` literally."""
    return "\\Q" + sep + "\\E"
