"""Relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordsearch.operators.match import Phrase, Prefix, Word

# The usual BM25 parameters.
K1 = 1.2
B = 0.75


def idf(n_docs: Column, doc_freq: Column) -> Column:
    return F.log(1 + (n_docs - doc_freq + 0.5) / (doc_freq + 0.5))


def bm25(tf: Column, doc_freq_idf: Column, length: Column, mean_length: Column,
         k1: float = K1, b: float = B, scale: float = 1.0) -> Column:
    """Exact lengths are used; ``scale`` allows a constant factor such as k1 + 1."""
    norm = k1 * (1 - b + b * length / mean_length)
    return scale * doc_freq_idf * tf / (tf + norm)


def saturation(feature: Column, pivot: Column) -> Column:
    """Boost of a positive feature; a missing feature adds nothing."""
    return F.coalesce(F.when(feature > 0, feature / (feature + pivot)), F.lit(0.0))


def feature_pivot(df: DataFrame, column: str, name: str = "pivot") -> DataFrame:
    """Geometric mean of a positive feature, one row."""
    positive = F.when(F.col(column) > 0, F.log(F.col(column)))
    return df.agg(F.exp(F.avg(positive)).alias(name))


def words_of(leaf) -> list[str]:
    if isinstance(leaf, Word):
        return [leaf.text]
    return leaf.text.split(" ") if isinstance(leaf, Phrase) else []


def is_constant(leaf) -> bool:
    """Prefix clauses score 1 wherever they match."""
    return isinstance(leaf, Prefix)
