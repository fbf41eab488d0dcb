"""Column functions on text: tokens, terms, normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A maximal run of Unicode letters and digits.
TOKEN = r"[\p{L}\p{N}]+"


def norm(c: Column | str) -> Column:
    """Lower case, trimmed, each run of spaces or tabs as one space. Null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"^\s+|\s+$", ""))


def tokens(c: Column | str) -> Column:
    """Tokens with their case kept, in order, repeats kept; null text gives none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def terms(c: Column | str) -> Column:
    """Tokens of the lower-cased text; null text gives none."""
    c = F.col(c) if isinstance(c, str) else c
    return tokens(F.lower(c))


def distinct_terms(c: Column | str) -> Column:
    """Each term of a text once."""
    return F.array_distinct(terms(c))
