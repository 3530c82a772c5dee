"""Corpus numbers that are kept beside the documents and follow every load.

Relevance needs the number of documents, the mean lengths and the documents of
each word.  They are counted once; a load then counts only what it adds and
what it replaces.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordsearch.functions.text import EXACT, Analysis

_SIDES = ("plain", "exact")


@dataclass(frozen=True)
class Numbers:
    """``words``: side, token, doc_freq.  ``sizes``: one row with n_docs and of each side its texts and tokens."""

    words: DataFrame
    sizes: DataFrame


def count_numbers(docs: DataFrame, text: str, plain: Analysis = EXACT, exact: Analysis = EXACT) -> Numbers:
    """Numbers of a table of documents; documents without a text count, but have no length."""
    tokens = docs.select(plain.tokens(F.col(text)).alias("plain"), exact.tokens(F.col(text)).alias("exact"))
    if plain == exact:
        tokens = docs.select(plain.tokens(F.col(text)).alias("plain")).withColumn("exact", F.col("plain"))
    listed = tokens.select(F.explode(F.array(*[
        F.struct(F.lit(side).alias("side"), F.array_distinct(side).alias("tokens")) for side in _SIDES])).alias("s"))
    words = listed.select("s.side", F.explode("s.tokens").alias("token")).groupBy("side", "token").agg(F.count("*").alias("doc_freq"))
    sums = [c for side in _SIDES for c in (F.count(side).alias(f"{side}_texts"),
                                           F.coalesce(F.sum(F.size(side).cast("long")), F.lit(0)).alias(f"{side}_tokens"))]
    return Numbers(words, tokens.agg(F.count("*").alias("n_docs"), *sums))


def merge_numbers(kept: Numbers, added: Numbers, removed: Numbers | None = None) -> Numbers:
    """The kept numbers with those of new documents added and those of replaced ones taken off."""
    parts = [(kept, 1), (added, 1)] + ([(removed, -1)] if removed else [])
    words = reduce(DataFrame.unionByName, [n.words.withColumn("doc_freq", sign * F.col("doc_freq")) for n, sign in parts])
    words = words.groupBy("side", "token").agg(F.sum("doc_freq").alias("doc_freq")).where("doc_freq > 0")
    names = kept.sizes.columns
    sizes = reduce(DataFrame.unionByName, [n.sizes.select(*[(sign * F.col(c)).alias(c) for c in names]) for n, sign in parts])
    return Numbers(words, sizes.agg(*[F.sum(c).alias(c) for c in names]))


def numbers_after_load(kept: Numbers, current: DataFrame, incoming: DataFrame, key: list[str], seq: str, text: str,
                       plain: Analysis = EXACT, exact: Analysis = EXACT) -> Numbers:
    """Numbers after ``bulk_load_latest(current, incoming, key, seq)``.

    Only the batch and the documents that it replaces are analysed; of the
    current table the others are read no further than their key.
    """
    last = incoming.groupBy(*key).agg(F.max(seq).alias(seq))
    newest = incoming.join(last.select(seq), seq, "left_semi")
    replaced = current.join(last.select(*key), key, "left_semi")
    return merge_numbers(kept, count_numbers(newest, text, plain, exact), count_numbers(replaced, text, plain, exact))
