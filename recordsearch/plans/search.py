"""One search over a corpus of documents or of themed excerpts."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordsearch.functions.text import EXACT, Analysis, token_count
from recordsearch.functions.urls import FileStore
from recordsearch.operators import filters, match, page, rank, results
from recordsearch.operators.catalogue import theme_route
from recordsearch.operators.highlight import highlight
from recordsearch.operators.numbers import Numbers

QUOTES = str.maketrans("“”‘’", "\"\"''")


@dataclass(frozen=True)
class SearchRequest:
    """What to look for; ``querystring`` may also be a clause tree."""

    querystring: object = ""
    territory_ids: tuple[str, ...] = ()
    published_since: date | None = None
    published_until: date | None = None
    scraped_since: datetime | None = None
    scraped_until: datetime | None = None
    excerpt_size: int = 500
    number_of_excerpts: int = 1
    pre_tags: tuple[str, ...] = ("",)
    post_tags: tuple[str, ...] = ("",)
    size: int = 10
    offset: int = 0
    sort_by: str = "relevance"


@dataclass(frozen=True)
class ThemeRequest(SearchRequest):
    theme: str = ""
    entities: tuple[str, ...] = ()
    subthemes: tuple[str, ...] = ()
    excerpt_size: int = 10000


@dataclass(frozen=True)
class Corpus:
    """A document table with its column names and analyses.

    ``analysed_plain`` and ``analysed_exact`` name stored columns of analysed
    text; without them it is worked out.  Searches take corpus numbers that
    are kept beside the documents as ``stats``.
    """

    docs: DataFrame
    key: str = "file_checksum"
    text: str = "source_text"
    date: str = "date"
    scraped_at: str = "scraped_at"
    territory: str = "territory_id"
    plain: Analysis = EXACT
    exact: Analysis = EXACT
    analysed_plain: str | None = None
    analysed_exact: str | None = None

    def forms(self) -> Column:
        """Struct of both analysed forms; one computation when they are equal."""
        plain = (F.col(self.analysed_plain) if self.analysed_plain
                 else self.plain.spaced(F.col(self.text)))
        if self.plain == self.exact and not self.analysed_exact:
            return F.struct(plain.alias("plain"))
        exact = (F.col(self.analysed_exact) if self.analysed_exact
                 else self.exact.spaced(F.col(self.text)))
        return F.struct(plain.alias("plain"), exact.alias("exact"))

    def pick(self, forms: Column) -> tuple[Column, Column]:
        one = self.plain == self.exact and not self.analysed_exact
        return forms["plain"], forms["plain" if one else "exact"]


class Found:
    """Lazy parts of a search: the page and the exact number of hits."""

    def __init__(self, page: DataFrame, hits):
        self.page = page
        self._hits = hits

    @cached_property
    def total(self) -> DataFrame:
        return page.total_hits(self._hits())


def clause_of(querystring, corpus: Corpus):
    """The clause tree of a request; None when there is no text to look for."""
    if querystring is None or querystring == "":
        return None
    if isinstance(querystring, str):
        querystring = match.read_clauses(querystring.translate(QUOTES))
    return match.resolve(querystring, corpus.plain, corpus.exact)


def corpus_stats(corpus: Corpus, clause) -> DataFrame:
    """One row: documents, mean lengths, and documents per word or fuzzy clause."""
    leaves = match.leaves(clause)
    plain_words = [w for x in leaves if isinstance(x, match.Word) for w in rank.words_of(x)]
    exact_words = [w for x in leaves if isinstance(x, match.Phrase) for w in rank.words_of(x)]
    fuzzy = [x for x in leaves if isinstance(x, match.Fuzzy)]

    def features(forms):
        plain, exact = corpus.pick(forms)
        out = {f"{side}_len": token_count(form) for side, form in
               (("plain", plain), ("exact", exact)) if side in _sides(leaves)}
        out["any"] = F.lit(True)
        for w in plain_words:
            out["plain " + w] = F.contains(plain, F.lit(f" {w} "))
        for w in exact_words:
            out["exact " + w] = F.contains(exact, F.lit(f" {w} "))
        for leaf in fuzzy:
            out[_fuzzy_name(leaf)] = match.present(leaf, plain, exact)
        return F.struct(*[c.alias(name) for name, c in out.items()])

    lines = corpus.docs.select(F.inline(F.transform(F.array(corpus.forms()), features)))
    sums = [
        F.avg(c).alias(c) if c.endswith("_len") else F.count_if(F.col(f"`{c}`")).alias(c)
        for c in lines.columns
    ]
    return lines.agg(F.count("*").alias("n_docs"), *sums)


def kept_stats(numbers: Numbers, corpus: Corpus, clause) -> DataFrame:
    """The row of ``corpus_stats`` from kept numbers: one read of the words asked, none of the corpus.

    How many documents have any word near a fuzzy one can't be told from the
    words alone; only this is counted in the corpus.
    """
    leaves = match.leaves(clause)
    asked = {f"{side} {w}": (side, w) for x in leaves for side, kind in (("plain", match.Word), ("exact", match.Phrase))
             if isinstance(x, kind) for w in rank.words_of(x)}
    found = numbers.words.where(F.col("token").isin(*{w for _, w in asked.values()})) if asked else numbers.words.where(F.lit(False))
    words = found.agg(F.count("*").alias("_"), *[
        F.coalesce(F.max(F.when((F.col("side") == side) & (F.col("token") == w), F.col("doc_freq"))), F.lit(0)).alias(name)
        for name, (side, w) in asked.items()]).drop("_")
    lengths = [(F.col(f"{s}_tokens") / F.nullif(F.col(f"{s}_texts"), F.lit(0))).alias(f"{s}_len") for s in ("plain", "exact")]
    row = numbers.sizes.select("n_docs", *lengths).join(words)  # two tables of one row
    fuzzy = tuple(x for x in leaves if isinstance(x, match.Fuzzy))
    if fuzzy:
        near = corpus_stats(corpus, match.AnyOf(fuzzy))
        row = row.join(near.select(*[f"`{_fuzzy_name(x)}`" for x in fuzzy]))
    return row


def _fuzzy_name(leaf) -> str:
    """A column name that holds whatever the user wrote, in hexadecimal."""
    return f"fuzzy {leaf.text.encode('utf-8', 'surrogatepass').hex()} {leaf.edits}"


def _sides(leaves) -> set[str]:
    """Which analysed lengths the scores of the leaves need."""
    return {"exact" if isinstance(x, match.Phrase) else "plain"
            for x in leaves if not rank.is_constant(x)}


def _score(clause, frequency, matched, stats: Column, lengths) -> Column:
    """Score Column of a clause tree; a part that does not hold adds nothing."""
    if isinstance(clause, (match.AllOf, match.AnyOf)):
        total = F.lit(0.0)
        for c in clause.clauses:
            total = total + _score(c, frequency, matched, stats, lengths)
        if isinstance(clause, match.AllOf):
            return F.when(match.condition(clause, matched), total).otherwise(0.0)
        return total
    if isinstance(clause, match.Not):
        return F.when(~match.condition(clause.clause, matched), 1.0).otherwise(0.0)
    if isinstance(clause, match.Nothing):
        return F.lit(0.0)
    tf = frequency(clause)
    if rank.is_constant(clause):
        return F.when(tf > 0, 1.0).otherwise(0.0)
    field_name = "exact" if isinstance(clause, match.Phrase) else "plain"
    if isinstance(clause, match.Fuzzy):
        names = [_fuzzy_name(clause)]
    else:
        names = [f"{field_name} {w}" for w in rank.words_of(clause)]
    weight = F.lit(0.0)
    for name in names:
        weight = weight + rank.idf(stats["n_docs"], stats[name])
    return F.when(
        tf > 0, rank.bm25(tf, weight, lengths[field_name], stats[field_name + "_len"])
    ).otherwise(0.0)


def text_hits(corpus: Corpus, rows: DataFrame, clause, scored: bool = True,
              score: str = "score", stats: DataFrame | Numbers | None = None) -> DataFrame:
    """Rows that match the clause, with their score.

    One pass: a substring test on the raw text, then the analysis of the rest,
    whose result is bound once and gives match, frequencies and lengths.
    Corpus numbers come from the whole corpus, also when rows were filtered.
    """
    leaves = match.leaves(clause)
    sloppy = [x for x in leaves if isinstance(x, match.Phrase) and x.slop]
    number = {leaf: i for i, leaf in enumerate(leaves)}
    # a stem by rules may hold letters that the text has not
    unlike = corpus.analysed_plain is not None or corpus.plain.language
    hint = None if unlike else match.raw_hint(clause, F.lower(F.col(corpus.text)))
    rows = filters.where(rows, hint)
    columns = rows.columns

    for leaf in sloppy:
        exact_form = rows.select(corpus.key, corpus.pick(corpus.forms())[1].alias("_exact"))
        near = match.phrase_slop(exact_form, corpus.key, "_exact", leaf)
        rows = rows.join(
            near.withColumn(f"_near{number[leaf]}", F.lit(True)), corpus.key, "left"
        )

    def matched_in(plain, exact):
        def of_leaf(leaf):
            if leaf in sloppy:
                return F.coalesce(F.col(f"_near{number[leaf]}"), F.lit(False))
            return F.coalesce(match.present(leaf, plain, exact), F.lit(False))
        return of_leaf

    def features(forms):
        plain, exact = corpus.pick(forms)
        out = [match.condition(clause, matched_in(plain, exact)).alias("_match")]
        if scored:
            out += [token_count(form).alias(f"_{side}_len") for side, form in
                    (("plain", plain), ("exact", exact)) if side in _sides(leaves)]
            for leaf, i in number.items():
                tf = (F.when(matched_in(plain, exact)(leaf), 1).otherwise(0).cast("long")
                      if leaf in sloppy else match.frequency(leaf, plain, exact))
                out.append(F.coalesce(tf, F.lit(0)).alias(f"_tf{i}"))
        return F.struct(*out)

    bound = F.filter(F.transform(F.array(corpus.forms()), features), lambda s: s["_match"])
    rows = rows.select(*columns, F.inline(bound))
    if not scored:
        return rows.select(*columns)
    numbers = corpus_stats(corpus, clause) if stats is None else stats
    if isinstance(numbers, Numbers):
        numbers = kept_stats(numbers, corpus, clause)
    rows = rows.withColumn("_stats", numbers.select(F.struct("*")).scalar())
    points = _score(
        clause,
        lambda leaf: F.col(f"_tf{number[leaf]}"),
        lambda leaf: F.col(f"_tf{number[leaf]}") > 0,
        F.col("_stats"),
        {"plain": F.col("_plain_len"), "exact": F.col("_exact_len")},
    )
    return rows.withColumn(score, points).select(*columns, score)


def _shared_filters(request: SearchRequest, corpus: Corpus) -> list[Column]:
    found = [
        filters.terms(corpus.territory, request.territory_ids),
        filters.date_range(corpus.date, request.published_since, request.published_until),
        filters.datetime_range(corpus.scraped_at, request.scraped_since, request.scraped_until),
    ]
    return [c for c in found if c is not None]


def gazette_hits(corpus: Corpus, request: SearchRequest, stats: DataFrame | Numbers | None = None):
    """(matching rows with a score, clause): nothing asked, nothing found."""
    clause = clause_of(request.querystring, corpus)
    conditions = _shared_filters(request, corpus)
    if clause is None and not conditions:
        return filters.match_none(corpus.docs).withColumn("score", F.lit(0.0)), None
    rows = filters.where(corpus.docs, *conditions)
    if clause is None:
        return rows.withColumn("score", F.lit(0.0)), None
    scored = request.sort_by == "relevance"
    rows = text_hits(corpus, rows, clause, scored, stats=stats)
    return (rows if scored else rows.withColumn("score", F.lit(0.0))), clause


def search_gazettes(corpus: Corpus, request: SearchRequest, store: FileStore = FileStore(),
                    stats: DataFrame | Numbers | None = None, public: bool = False,
                    keep: tuple[str, ...] = ()) -> Found:
    """Filters, text, relevance or date order, page, excerpts and result rows."""
    hits, clause = gazette_hits(corpus, request, stats)
    order = page.sort_columns(request.sort_by, corpus.date, ties=(corpus.territory, corpus.key))
    rows = page.paginate(hits, order, request.offset, request.size)
    rows = rows.withColumn("excerpts", _excerpts(corpus, clause, request))
    unscored = replace(request, sort_by="descending_date")
    return Found(
        results.gazette_result(rows, store, public, keep),
        lambda: gazette_hits(corpus, unscored)[0],
    )


def _excerpts(corpus: Corpus, clause, request: SearchRequest) -> Column:
    return highlight(
        F.col(corpus.text), clause, corpus.plain, corpus.exact, request.excerpt_size,
        request.number_of_excerpts, request.pre_tags, request.post_tags,
    )


def excerpt_hits(corpus: Corpus, request: ThemeRequest, stats: DataFrame | Numbers | None = None,
                 pivots: DataFrame | None = None):
    """(excerpts of the theme with a score, clause).  No condition finds all."""
    theme = replace(corpus, docs=corpus.docs.where(F.col("theme") == request.theme))
    clause = clause_of(request.querystring, corpus)
    conditions = _shared_filters(request, corpus)
    conditions += [c for c in (filters.array_any("excerpt_entities", request.entities),
                               filters.array_any("excerpt_subthemes", request.subthemes))
                   if c is not None]
    if clause is None and not conditions:
        return filters.match_all(theme.docs), None
    rows = filters.where(theme.docs, *conditions)
    scored = request.sort_by == "relevance"
    if clause is not None:
        rows = text_hits(theme, rows, clause, scored, "score", stats)
    if not scored:
        return rows.withColumn("score", F.lit(0.0)), clause
    if clause is None:
        rows = rows.withColumn("score", F.lit(0.0))
    features = ("excerpt_tfidf_score", "excerpt_embedding_score")
    if pivots is None:
        centre = [F.exp(F.avg(F.when(F.col(c) > 0, F.log(c)))).alias(c) for c in features]
        pivots = theme.docs.agg(*centre)
    rows = rows.withColumn("_pivots", pivots.select(F.struct("*")).scalar())
    for c in features:
        rows = rows.withColumn(
            "score", F.col("score") + rank.saturation(F.col(c), F.col("_pivots")[c])
        )
    return rows.drop("_pivots"), clause


def search_excerpts(corpus: Corpus, request: ThemeRequest, store: FileStore = FileStore(),
                    stats: DataFrame | Numbers | None = None, public: bool = False,
                    keep: tuple[str, ...] = (), themes: DataFrame | None = None) -> Found:
    """Theme search: boosts added to relevance; the text is the first highlight.

    With the catalogue of ``themes``, a theme that it lacks is an error.
    """
    if themes is not None:
        theme_route(corpus.docs, themes, request.theme, check=True)
    hits, clause = excerpt_hits(corpus, request, stats)
    order = page.sort_columns(request.sort_by, corpus.date, ties=(corpus.territory, corpus.key))
    rows = page.paginate(hits, order, request.offset, request.size)
    rows = rows.withColumn("excerpts", _excerpts(corpus, clause, request))
    unscored = replace(request, sort_by="descending_date")
    return Found(
        results.excerpt_result(rows, store, public, keep),
        lambda: excerpt_hits(corpus, unscored)[0],
    )


def excerpt_corpus(excerpts: DataFrame, **options) -> Corpus:
    """Corpus of the themed-excerpt table."""
    names = {"key": "excerpt_id", "text": "excerpt", "date": "source_date",
             "scraped_at": "source_scraped_at", "territory": "source_territory_id"}
    return Corpus(excerpts, **{**names, **options})
