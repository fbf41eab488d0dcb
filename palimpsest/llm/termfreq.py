"""Frequency of every distinct term over a collection, and marks on terms too rare or too common.

A record's terms are sorted inside its own row, so each occurrence knows whether it is
the first of its record; occurrences and records are then counted in one aggregation
that combines by hash before the only shuffle on the term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import terms


def records(table: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """One row (id, text) per key: rows of one key hold the same text and count once. Null keys are left out."""
    return table.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(F.col(text)).alias("text"))


def occurrences(recs: DataFrame) -> DataFrame:
    """(id, term, first): every occurrence of a term, `first` true once per record and term.

    Null, empty and sign-only texts have no terms. The text is taken whole.
    """
    ordered = F.array_sort(terms("text"))
    shifted = F.concat(F.array(F.lit(None).cast("string")), ordered)
    pair = F.arrays_zip(ordered.alias("term"), shifted.alias("before"))
    return (
        recs.select("id", F.explode(pair).alias("o"))
        .filter("o.term is not null")
        .select("id", "o.term", (~F.col("o.term").eqNullSafe(F.col("o.before"))).alias("first"))
    )


def term_counts(recs: DataFrame) -> DataFrame:
    """(term, occurrences, records): over the whole collection. Empty input gives no rows."""
    return occurrences(recs).groupBy("term").agg(
        F.count("*").alias("occurrences"), F.count(F.when(F.col("first"), True)).alias("records")
    )


def record_count(recs: DataFrame) -> DataFrame:
    """One row (n): how many records have at least one term."""
    return recs.filter(F.col("text").rlike(r"[\p{L}\p{N}]")).agg(F.count("*").alias("n"))


def with_bands(counts: DataFrame, n: DataFrame, rare_max: int = 2, common_percent: int = 20) -> DataFrame:
    """Adds `band`: rare (at most `rare_max` records), common (more than `common_percent` % of n), else null.

    A term that is both, in a tiny collection, is rare. n is one row, so its join is a scalar subquery.
    """
    common = F.col("records") * 100 > n.scalar() * common_percent
    return counts.withColumn("band", F.when(F.col("records") <= rare_max, "rare").when(common, "common"))
