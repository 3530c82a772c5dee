"""Words of a corpus as tables: vocabulary, postings, and search for many
queries at once.

The postings table is written once and read by token.  A batch of queries is
an equi-join on the token; prefixes and fuzzy words are first resolved on the
vocabulary, also by equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordsearch.functions.text import EXACT, Analysis, let, token_count, token_runs, token_stops, within_edits
from recordsearch.operators.skew import lookup, spread_join


def analyze_tokens(df: DataFrame, text: str, analyses: dict[str, Analysis]) -> DataFrame:
    """Add one token array per named analysis."""
    return df.withColumns({name: a.tokens(F.col(text)) for name, a in analyses.items()})


def build_postings(docs: DataFrame, key: str, text: str, analysis: Analysis = EXACT) -> DataFrame:
    """One row per token occurrence: key, token, position and start offset.

    A text becomes rows of a few tokens first, so offsets are summed over
    short arrays and no array of all places of a text is made.
    """
    runs = docs.select(key, F.inline(token_runs(F.col(text), analysis.token_pattern))
                       .alias("_first", "_begin", "_tokens", "_gaps"))
    sums = runs.select(key, "_first", "_tokens", token_stops(F.col("_begin"), F.col("_tokens"), F.col("_gaps")).alias("_stops"))
    spots = sums.select(key, "_first", F.posexplode(F.arrays_zip("_tokens", "_stops")).alias("_at", "_spot"))
    raw = F.col("_spot._tokens")
    rows = spots.select(key, F.lower(raw).alias("token"), (F.col("_first") + F.col("_at")).alias("pos"),
                        (F.col("_spot._stops") - F.length(raw)).alias("start"))
    if analysis.stopwords:
        rows = rows.where(~F.col("token").isin(*analysis.stopwords))
    return rows.withColumn("token", analysis.stem(F.col("token")))


def token_rows(docs: DataFrame, key: str, text: str, analysis: Analysis = EXACT) -> DataFrame:
    """Postings without offsets, straight from the token array."""
    return docs.select(key, F.posexplode(analysis.tokens(F.col(text))).alias("pos", "token"))


def term_frequencies(postings: DataFrame, key: str) -> DataFrame:
    """Occurrences per document and token.

    A document's tokens leave one task, so most of the counting is done there,
    before the shuffle.
    """
    return postings.groupBy(key, "token").agg(F.count("*").alias("tf"))


def write_postings(postings: DataFrame, table: str, buckets: int) -> None:
    """Store by token; later joins on the token need no shuffle of this side."""
    (postings.write.bucketBy(buckets, "token").sortBy("token")
     .mode("overwrite").format("parquet").saveAsTable(table))


def token_stats(frequencies: DataFrame) -> DataFrame:
    """Documents and occurrences per token (one row per document and token in)."""
    return frequencies.groupBy("token").agg(
        F.count("*").alias("doc_freq"), F.sum("tf").alias("total_freq")
    )


def document_lengths(docs: DataFrame, key: str, text: str, analysis: Analysis = EXACT) -> DataFrame:
    """Token count of every document, also of those without tokens; no shuffle."""
    return docs.select(key, let(analysis.spaced(F.col(text)), token_count).alias("length"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    return lengths.agg(
        F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"),
    )


def normalize_vocabulary(postings: DataFrame, dictionary: DataFrame | None = None,
                         analysis: Analysis | None = None) -> DataFrame:
    """(token, norm): every distinct token normalised once.

    By a dictionary (token, norm), by the suffix rule of an analysis, or both;
    the dictionary goes first.
    """
    vocabulary = postings.select("token").distinct()
    norm = analysis.stem(F.col("token")) if analysis else F.col("token")
    if dictionary is None:
        return vocabulary.select("token", norm.alias("norm"))
    entries = dictionary.groupBy("token").agg(F.min("norm").alias("_entry"))
    return vocabulary.join(entries, "token", "left").select(
        "token", F.coalesce("_entry", norm).alias("norm")
    )


def apply_vocabulary(postings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings with their normal forms in place of the tokens.

    Only the rows of very frequent tokens are spread, as the vocabulary is too
    large to be repeated as a whole.
    """
    spot = [c for c in postings.columns if c != "token"]
    joined = lookup(postings, vocabulary, ["token"], spot)
    return joined.withColumn("token", F.col("norm")).drop("norm").select(*postings.columns)


def expand_prefixes(vocabulary: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(query_id, term, token) for prefix terms, by an equi-join on prefixes.

    A token lists its beginnings of the lengths that are asked, mostly one or
    two, and no pair has to be tried.
    """
    lengths = prefixes.agg(F.collect_set(F.length("term"))).scalar()  # at most as many as the longest term has letters
    listed = vocabulary.select("token", lengths.alias("_lengths"))
    starts = F.transform(F.filter("_lengths", lambda n: n.between(1, F.length("token"))),
                         lambda n: F.col("token").substr(F.lit(1), n))
    return prefixes.join(listed.select("token", F.explode(starts).alias("term")), "term").select("query_id", "term", "token")


def _deletions(word: Column, edits: int) -> Column:
    """The word and all forms with up to ``edits`` letters left out."""
    def shorter(w):
        return F.transform(
            F.when(F.length(w) > 0, F.sequence(F.lit(1), F.length(w))).otherwise(
                F.array().cast("array<int>")
            ),
            lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w))),
        )

    forms = F.array(word)
    last = forms
    for _ in range(edits):
        last = F.array_distinct(F.flatten(F.transform(last, shorter)))
        forms = F.array_union(forms, last)
    return forms


def _segments(edits: int, size: Column) -> Column:
    """(number, begin, length) of the parts of a word of ``size`` letters: so many that edits leave one as it is."""
    n = 2 * edits + 1  # a swap over a border touches two
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.struct(
        j.alias("number"), F.floor(j * size / n).cast("int").alias("begin"),
        (F.floor((j + 1) * size / n) - F.floor(j * size / n)).cast("int").alias("length")))


def _own_pieces(word: Column, edits: int) -> Column:
    return F.transform(_segments(edits, F.length(word)), lambda s: F.struct(
        F.length(word).alias("size"), s["number"].alias("number"), word.substr(s["begin"] + 1, s["length"]).alias("piece")))


def _asked_pieces(word: Column, edits: int, least: int) -> Column:
    """What the parts of a word within the edits would be, for each length it may have and each place a part may have moved to."""
    size = F.length(word)
    sizes = F.filter(F.sequence(size - edits, size + edits), lambda n: n >= least)

    def of_part(n, s):
        begins = F.filter(F.sequence(s["begin"] - edits, s["begin"] + edits), lambda b: (b >= 0) & (b + s["length"] <= size))
        return F.transform(begins, lambda b: F.struct(
            n.alias("size"), s["number"].alias("number"), word.substr(b + 1, s["length"]).alias("piece")))

    def of_size(n):
        return F.flatten(F.transform(_segments(edits, n), lambda s: of_part(n, s)))

    return F.array_distinct(F.flatten(F.transform(sizes, of_size)))


def expand_fuzzy(vocabulary: DataFrame, terms: DataFrame, edits: int = 1) -> DataFrame:
    """(query_id, term, token) for tokens within the edit distance of a term; a swap of neighbours is one edit.

    A token is cut into 2N + 1 parts, of which N edits leave one as it is, at
    most N letters from its place: candidates meet in an equi-join on length,
    number and letters of a part, so the vocabulary makes a few rows a token.
    Words too short to be cut meet on the forms with up to N letters left out.
    All candidates are then measured.
    """
    least = 2 * (2 * edits + 1)  # letters of the shortest token that is cut, two a part
    asked = terms.select("term").where(F.length("term") > 0).distinct()
    long = vocabulary.where(F.length("token") >= least).select("token", F.inline(_own_pieces(F.col("token"), edits)))
    wide = asked.where(F.length("term") >= least - edits).select("term", F.inline(_asked_pieces(F.col("term"), edits, least)))
    short = vocabulary.where(F.length("token") < least).select("token", F.explode(_deletions(F.col("token"), edits)).alias("form"))
    small = asked.where(F.length("term") < least + edits).select("term", F.explode(_deletions(F.col("term"), edits)).alias("form"))
    met = long.join(wide, ["size", "number", "piece"]).select("term", "token").unionByName(
        short.join(small, "form").select("term", "token")).distinct()
    close = met.where(within_edits(F.col("token"), F.col("term"), edits))
    return terms.select("query_id", "term").join(close, "term").select("query_id", "term", "token").distinct()


def search_postings(postings: DataFrame, query_terms: DataFrame, spread: bool = True) -> DataFrame:
    """Match query terms to documents: postings joined to terms on the token.

    Frequent tokens are spread over salted parts.  When Spark finds the terms
    small it sends them to the postings instead and nothing is shuffled.  With
    ``spread=False`` postings stored by token stay where they are.
    """
    return spread_join(postings, query_terms, ["token"], spread)


def phrase_places(postings: DataFrame, key: str, words: DataFrame, phrase: list[str], rest: tuple[str, ...] = (),
                  tasks: int | None = None) -> DataFrame:
    """For each phrase and document with all of its words: ``places``, the places of the phrase with their positions.

    ``postings`` has token, key, positions and the columns ``rest``; ``words``
    has the columns ``phrase`` that name a phrase, token, place and doc_freq.
    The rarest word of a phrase chooses its documents; only for these the
    other words are looked up, by token and document, so a frequent word costs
    no more than the rarest one has documents.  With ``tasks``, the places
    found are dealt by document to so many tasks and grouped there.
    """
    order = Window.partitionBy(*phrase).orderBy("doc_freq", "place")
    size = F.count("*").over(Window.partitionBy(*phrase))
    ranked = words.withColumns({"_rank": F.row_number().over(order), "_n": size})
    first = postings.select("token", key).join(ranked.where("_rank = 1").select(*phrase, "token"), "token").drop("token")
    asked = first.join(ranked.drop("_rank", "doc_freq"), phrase)
    found = postings.select("token", key, "positions", *rest).join(asked, ["token", key])
    found = found.repartition(tasks, key) if tasks else found
    rows = found.groupBy(*phrase, key, *rest, "_n").agg(F.collect_list(F.struct("place", "token", "positions")).alias("places"))
    return rows.where(F.size("places") == F.col("_n")).drop("_n")


def times_in_a_row(places: Column) -> Column:
    """How often the words of a phrase stand in a row: starts (position minus place) that all places have."""
    starts = F.transform(places, lambda p: F.transform(p["positions"], lambda x: x - p["place"]))
    return F.size(F.aggregate(F.slice(starts, 2, F.size(starts)), F.element_at(starts, 1), F.array_intersect))


def match_phrases(postings: DataFrame, key: str, phrase_terms: DataFrame, words: DataFrame) -> DataFrame:
    """(query_id, document, occurrences) where the words of a phrase stand in a row.

    ``postings`` has a row (token, document, positions) for each token of a
    document, ``phrase_terms`` holds (query_id, token, place) and ``words``
    (token, doc_freq).  A phrase with a word that no document has matches
    nothing.
    """
    known = phrase_terms.join(words.select("token", "doc_freq"), "token", "left")
    known = known.withColumn("doc_freq", F.coalesce("doc_freq", F.lit(0)))
    rows = phrase_places(postings, key, known, ["query_id"])
    return rows.select("query_id", key, times_in_a_row(F.col("places")).cast("long").alias("occurrences")).where("occurrences > 0")
