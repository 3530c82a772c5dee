"""A stored index of a corpus: postings by token, words with their numbers, narrow documents.

It is built once per corpus and analysis.  A search then reads the postings of
the asked tokens alone: they are stored in buckets by token and sorted in
them, so a token is one bucket and a prefix one interval.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordsearch.functions.text import Analysis, let, token_count
from recordsearch.operators import rank
from recordsearch.operators.postings import normalize_vocabulary
from recordsearch.plans.search import Corpus
from recordsearch.sources.writers import remove


@dataclass(frozen=True)
class Side:
    """One analysis of the corpus.

    ``postings``: token, document key, positions, and the document's length;
    ``words``: token, doc_freq, and most, the largest share of its weight that
    a token has in any document (the score of a document is at most weight
    times this).
    """

    analysis: Analysis
    postings: DataFrame
    words: DataFrame


@dataclass(frozen=True)
class Index:
    """``docs`` has the key, the lengths and what filters and orders need; ``numbers`` is one row."""

    corpus: Corpus
    docs: DataFrame
    plain: Side
    exact: Side
    numbers: DataFrame

    @property
    def key(self) -> str:
        return self.corpus.key


def index_docs(corpus: Corpus) -> DataFrame:
    """key, territory, date, scraped_at, plain_len, exact_len of every document; no length without a text."""
    def lengths(forms):
        plain, exact = corpus.pick(forms)
        return F.struct(token_count(plain).alias("plain_len"), token_count(exact).alias("exact_len"))

    if corpus.plain.language:
        corpus = replace(corpus, plain=corpus.plain.unstemmed())  # a stem is never empty, so there are as many
    have = set(corpus.docs.columns)
    narrow = [F.col(c) if c in have else F.lit(None).cast(kind).alias(c) for c, kind in (
        (corpus.territory, "string"), (corpus.date, "date"), (corpus.scraped_at, "timestamp_ntz"))]
    rows = corpus.docs.select(corpus.key, *narrow, let(corpus.forms(), lengths).alias("l"))
    return rows.select("*", "l.*").drop("l")


def _runs(spots: Column) -> Column:
    """(token, positions) of the sorted (token, pos) of a document: every run of a token is cut out once."""
    def cut(found):
        size = F.size(found)
        begins = F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))),
                          lambda i: (size > 0) & ((i == 0) | (F.get(found, i)["token"] != F.get(found, F.greatest(i - 1, F.lit(0)))["token"])))
        return let(begins, lambda at: F.transform(at, lambda i, n: F.struct(
            F.get(found, i)["token"].alias("token"),
            F.slice(found, i + 1, F.coalesce(F.get(at, n + 1), size) - i)["pos"].alias("positions"))))

    return let(F.sort_array(spots), cut)


#: Parts of the documents for each task: their numbers are dealt by hash, so several even a task out.
_PARTS = 4


def index_postings(corpus: Corpus, analysis: Analysis) -> DataFrame:
    """token, key, positions (ascending) and length: one row for each token of a document."""
    if not analysis.language:
        return _document_tokens(corpus, analysis, [])
    return _stemmed(_document_tokens(corpus, analysis.unstemmed(), ["_part"]), corpus.key, analysis)


def _document_tokens(corpus: Corpus, analysis: Analysis, part: list[str]) -> DataFrame:
    """Postings, with the number of the document's part where ``part`` names a column for it.

    Documents meet their copies (same key and length) as whole texts, and the
    tokens are grouped inside the row, so no single occurrence is shuffled.
    """
    tasks = int(corpus.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def spots(found):
        return F.transform(found, lambda token, pos: F.struct(token.alias("token"), pos.alias("pos")))

    docs = corpus.docs.select(*[F.pmod(F.xxhash64(corpus.key), F.lit(_PARTS * tasks)).alias(c) for c in part], corpus.key, corpus.text)
    texts = docs.repartition(tasks, *(part or [corpus.key]))
    found = texts.select(*part, corpus.key, analysis.tokens(F.col(corpus.text)).alias("tokens"))
    whole = found.select(*part, corpus.key, F.size("tokens").alias("length"), "tokens").where("length > 0")
    alike = whole.groupBy(*part, corpus.key, "length").agg(F.collect_list("tokens").alias("lists"))
    return alike.select(*part, corpus.key, "length", F.inline(_runs(F.flatten(F.transform("lists", spots))))).select(
        *part, "token", corpus.key, "length", "positions")


def _stemmed(rows: DataFrame, key: str, analysis: Analysis) -> DataFrame:
    """Postings in parts of the documents, their distinct words stemmed by the rules of a language once each.

    The stems are sent to the parts that have their words; where joins may
    stay in parts (``_building``), the rows of postings do not move.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = rows.select("_part", "token").distinct()
    stems = words.join(normalize_vocabulary(words, analysis=analysis), "token").repartition(tasks, "_part")
    joined = rows.join(stems.hint("merge"), ["_part", "token"]).drop("token").withColumnRenamed("norm", "token")
    return joined.groupBy("_part", "token", key, "length").agg(
        F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")).drop("_part")


def index_numbers(docs: DataFrame) -> DataFrame:
    """One row: n_docs and the mean lengths."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg("plain_len").alias("plain_len"), F.avg("exact_len").alias("exact_len"))


def index_words(postings: DataFrame, mean: DataFrame) -> DataFrame:
    """token, doc_freq, most; ``mean`` is the one-row table with the mean length first."""
    share = rank.bm25(F.size("positions"), F.lit(1.0), F.col("length"), mean.select(mean.columns[0]).scalar())
    return postings.groupBy("token").agg(F.count("*").alias("doc_freq"), F.max(share).alias("most"))


def build_index(corpus: Corpus) -> Index:
    """The index as a plan; nothing is stored, so every use works it out anew."""
    docs = index_docs(corpus)
    numbers = index_numbers(docs)
    plain, exact = (
        Side(analysis, rows, index_words(rows, numbers.select(mean)))
        for analysis, rows, mean in ((corpus.plain, index_postings(corpus, corpus.plain), "plain_len"),
                                     (corpus.exact, index_postings(corpus, corpus.exact), "exact_len")))
    return Index(corpus, docs, plain, plain if corpus.plain == corpus.exact else exact, numbers)


#: While tables of an index are stored: joins stay in the parts that one of their keys was dealt by, and what was
#: exchanged for a table is removed when the table is there, not when the driver happens to collect its garbage.
_BUILDING = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

#: Files of a table at most; with more tasks and buckets, rows are exchanged by bucket before they are stored.
MOST_FILES = 1 << 14


@contextmanager
def _building(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _BUILDING}
    try:
        for k, v in _BUILDING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_index(corpus: Corpus, folder: str, name: str | None = None, buckets: int = 64) -> Index:
    """Store the index below ``folder`` and return it; ``name`` starts the names of its tables.

    A bucket is written by several tasks, dealt by document, so a token that
    every document has fills no task.  Each task writes a file for every bucket
    and no posting is exchanged for that, as long as the files are not too many.
    """
    spark = corpus.docs.sparkSession
    name = name or f"index_{uuid.uuid4().hex}"
    with _building(spark):
        return _write(corpus, folder, name, buckets)


def _write(corpus: Corpus, folder: str, name: str, buckets: int) -> Index:
    spark = corpus.docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splits = max(1, -(-tasks // buckets))

    def store(rows: DataFrame, part: str, buckets: int = 0, by: str = "token") -> DataFrame:
        writer = rows.write.format("parquet").option("path", f"{folder}/{name}/{part}")
        if buckets:
            writer = writer.bucketBy(buckets, by).sortBy(by)
        writer.saveAsTable(f"{name}_{part}")
        return spark.table(f"{name}_{part}")

    def by_token(rows: DataFrame, part: str) -> DataFrame:
        if tasks * buckets > MOST_FILES:
            rows = rows.repartition(tasks, F.pmod(F.hash("token"), F.lit(buckets)),
                                    F.pmod(F.xxhash64(corpus.key), F.lit(splits)) if corpus.key in rows.columns else F.lit(0))
        return store(rows, part, buckets)

    docs = store(index_docs(corpus), "docs")
    numbers = store(index_numbers(docs), "numbers")

    def side(analysis: Analysis, part: str, mean: str) -> Side:
        if analysis.language:  # the parts are read twice, so they are worked out and kept once
            parts = store(_document_tokens(corpus, analysis.unstemmed(), ["_part"]), f"{part}_parts", tasks, "_part")
            rows = by_token(_stemmed(parts, corpus.key, analysis), f"{part}_postings")
            spark.sql(f"DROP TABLE {name}_{part}_parts")
            remove(spark, f"{folder}/{name}/{part}_parts")
        else:
            rows = by_token(index_postings(corpus, analysis), f"{part}_postings")
        return Side(analysis, rows, by_token(index_words(rows, numbers.select(mean)), f"{part}_words"))

    plain = side(corpus.plain, "plain", "plain_len")
    exact = plain if corpus.plain == corpus.exact else side(corpus.exact, "exact", "exact_len")
    return Index(corpus, docs, plain, exact, numbers)


def read_index(spark: SparkSession, corpus: Corpus, name: str) -> Index:
    """An index that was stored under ``name``, by the analyses of ``corpus``."""
    def side(analysis: Analysis, part: str) -> Side:
        return Side(analysis, spark.table(f"{name}_{part}_postings"), spark.table(f"{name}_{part}_words"))

    plain = side(corpus.plain, "plain")
    exact = plain if corpus.plain == corpus.exact else side(corpus.exact, "exact")
    return Index(corpus, spark.table(f"{name}_docs"), plain, exact, spark.table(f"{name}_numbers"))


def only_tokens(index: Index, plain: list[str] | None, exact: list[str] | None) -> Index:
    """The index with the postings of these tokens alone (None: all): other buckets are not read."""
    def cut(side: Side, tokens):
        return side if tokens is None else replace(side, postings=side.postings.where(F.col("token").isin(*tokens)))

    return replace(index, plain=cut(index.plain, plain), exact=cut(index.exact, exact))
