"""Golden rows of the toy corpus."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from recordsearch.functions.text import STANDARD_TOKEN_PATTERN, Analysis
from recordsearch.operators import filters, match, page
from recordsearch.operators.match import AllOf, AnyOf, Fuzzy, Not, Phrase, Prefix, Word
from recordsearch.plans.search import (
    Corpus, SearchRequest, gazette_hits, search_gazettes, text_hits, clause_of,
)

T = date(2024, 6, 15)
ALL_CONTENT = [1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 13]


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def found(corpus, clause):
    return ids(text_hits(corpus, corpus.docs, clause_of(clause, corpus)))


@pytest.fixture(scope="module")
def corpus(toy_current):
    return Corpus(toy_current)


def test_last_row_of_a_key_replaces_the_document(toy_current):
    assert toy_current.count() == 12
    row = toy_current.where("file_checksum = 'sum12'").first()
    assert (row.id, row.edition_number, row.is_extra_edition) == (13, None, None)


def test_filters(toy_current):
    assert ids(filters.where(toy_current, filters.terms("territory_id", ["3304557"]))) == [1, 4, 6]
    assert filters.terms("territory_id", []) is None
    assert ids(filters.where(toy_current, filters.date_range("date", since=T))) == [1, 3, 5, 6]
    until = filters.date_range("date", until=date(2024, 6, 8))
    assert ids(filters.where(toy_current, until)) == [7, 8, 10, 11]
    at = datetime(2020, 10, 30, 7, 4, 29)
    assert len(ids(filters.where(toy_current, filters.datetime_range("scraped_at", until=at)))) == 12
    exact = filters.datetime_range("scraped_at", until=at, whole_second=False)
    assert ids(filters.where(toy_current, exact)) == []


@pytest.mark.parametrize(
    "clause, rows",
    [
        ("otherlantern lantern1", [4, 5]),
        ("+harbour +budget", ALL_CONTENT),
        (AllOf((Word("harbour"), Not(Word("after")))), [1, 2, 3, 4, 5, 6]),
        ("harbour + -after", [1, 2, 3, 4, 5, 6]),
        ('"some lanterm"', [6]),
        ('"harbour budget"', []),
        ('"harbour budget"~1', ALL_CONTENT),
        ('"budget harbour"~1', []),
        ('"budget harbour"~3', ALL_CONTENT),
        (Prefix("lantern"), [5]),
        ("lant*", [5, 6]),
        ("lantern~1", [5, 6]),
        (AllOf((Word("budget"), AnyOf((Word("6"), Word("11"))))), [7, 13]),
        ("+budget +(6 | 11)", [7, 13]),
        ("“some lanterm”", [6]),
        ('"is is"~1', []),
        ('"000 000 000"', [6]),
        ("nosuchword", []),
        ("!!!", []),
    ],
)
def test_text_clauses(corpus, clause, rows):
    assert found(corpus, clause) == rows


def test_nothing_asked_nothing_found(corpus):
    out = search_gazettes(corpus, SearchRequest())
    assert out.page.count() == 0
    assert out.total.first().total == 0


def test_date_order_and_pages(corpus):
    request = SearchRequest(territory_ids=("3304557", "4205902", "4205919", "4205920"),
                            sort_by="descending_date", size=100)
    out = search_gazettes(corpus, request, keep=("id",))
    assert [r.id for r in out.page.collect()] == [3, 5, 1, 6, 4, 2, 9, 13, 8, 11, 7, 10]
    part = SearchRequest(**{**request.__dict__, "offset": 4, "size": 3})
    out = search_gazettes(corpus, part, keep=("id",))
    assert [r.id for r in out.page.collect()] == [4, 2, 9]
    assert out.total.first().total == 12


def test_pages_joined_are_the_whole_order(corpus):
    order = page.sort_columns("ascending_date")
    whole = [r.id for r in corpus.docs.orderBy(*order).collect()]
    pages = []
    for offset in range(0, 12, 5):
        pages += [r.id for r in page.paginate(corpus.docs, order, offset, 5).collect()]
    assert pages == whole


def test_not_is_the_complement(corpus):
    everything = set(ids(corpus.docs))
    for clause in (Word("after"), Phrase("some lanterm"), Fuzzy("lantern", 1)):
        assert set(found(corpus, Not(clause))) == everything - set(found(corpus, clause))


def test_excerpts(corpus):
    ask = SearchRequest("lantern1", pre_tags=("<b>",), post_tags=("</b>",))
    row = search_gazettes(corpus, ask).page.first()
    assert row.excerpts == ["Our town plans harbour repair budget. <b>lantern1</b>"]
    only_filter = SearchRequest(territory_ids=("3304557",))
    assert {tuple(r.excerpts) for r in search_gazettes(corpus, only_filter).page.collect()} == {()}


def test_relevance_prefers_rare_words(corpus):
    out = search_gazettes(corpus, SearchRequest("harbour lantern1"), keep=("id", "score"))
    rows = out.page.collect()
    assert rows[0].id == 5
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)


def test_standard_tokens(spark):
    text = spark.range(1).select(F.lit("x 000.000.000-00").alias("t"))
    whole = Analysis(STANDARD_TOKEN_PATTERN)
    assert text.select(whole.tokens(F.col("t"))).first()[0] == ["x", "000.000.000", "00"]
    assert text.select(whole.spaced(F.col("t"))).first()[0] == " x  000.000.000  00 "
    assert text.select(Analysis().tokens(F.col("t"))).first()[0] == ["x", "000", "000", "000", "00"]
    assert text.select(Analysis().spaced(F.col("t"))).first()[0] == " x  000  000  000  00 "


def test_stopwords_and_suffixes(spark):
    plain = Analysis(stopwords=("de", "a"), suffixes=("s", "mente", "a"))
    text = spark.createDataFrame([("A casa de rapidamente casas da a",), ("",), ("...",)], "t string")
    got = [tuple(r) for r in text.select(plain.tokens(F.col("t")), plain.spaced(F.col("t"))).collect()]
    assert got[0] == (["cas", "rapida", "casa", "da"], " cas  rapida  casa  da ")
    assert got[1][0] == got[2][0] == []
    assert plain.words("A casa de rapidamente") == ["cas", "rapida"]


def test_stopwords_only_match_nothing(toy_current):
    corpus = Corpus(toy_current, plain=Analysis(stopwords=("town", "our")))
    assert ids(gazette_hits(corpus, SearchRequest("our town"))[0]) == []
    assert len(ids(gazette_hits(corpus, SearchRequest('"our town"'))[0])) == 12
    assert len(ids(gazette_hits(corpus, SearchRequest("our harbour"))[0])) == 12


def test_text_without_words_says_nothing_inside_clauses():
    plain = Analysis(stopwords=("the",))
    read = lambda text: match.resolve(match.read_clauses(text), plain)
    assert read("+contract +the") == Word("contract")
    assert read("contract -the") == Word("contract")
    assert read("+contract + -(the | the)") == Word("contract")
    assert read("the | -the") == match.Nothing()
    assert read("a the b") == AnyOf((Word("a"), Word("b")))


def test_edits_without_number_and_escapes():
    read = match.read_clauses
    assert read("word~") == Fuzzy("word", 2) and read("word~9") == Fuzzy("word", 2) == Fuzzy("word", 7)
    assert read(r"a\+b") == Word("a+b") and read(r"\-a") == Word("-a") and read(r"a\*") == Word("a*")
    assert read(r"a\~1") == Word("a~1") and read(r'"a \"b\" c"~2') == Phrase('a "b" c', 2)
    assert read("ab*") == Prefix("ab") and read(r"\(a b\)") == AnyOf((Word("(a"), Word("b)")))


def test_any_fuzzy_text_is_searched(corpus):
    assert found(corpus, "a`b~1") == []
    assert found(corpus, "laxtern1~") == [5]
