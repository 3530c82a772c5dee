"""Whole requests for a table of queries and searches over a stored index, against one search of the text each."""

import random
import re
from dataclasses import asdict
from datetime import date, datetime

import pytest

from recordsearch.functions.text import Analysis
from recordsearch.plans import batch
from recordsearch.plans.index import build_index, read_index, write_index
from recordsearch.plans.search import Corpus, SearchRequest, search_gazettes

PLAIN = Analysis(stopwords=("the", "of"), suffixes=("ing", "s"))
WORDS = "harbour harbours the of repair repairing plan plans town towns budget abc abd bac".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(160):
        text = rng.choice(["", None, "12,5 ... !"]) if i % 20 == 0 else " ".join(rng.choices(WORDS, k=rng.randrange(1, 25)))
        rows.append((i, f"t{i % 4}" if i % 9 else None, "Town", "RJ", date(2024, 1, 1 + i % 28) if i % 11 else None,
                     datetime(2024, 2, 1, 10, i % 60, 5, 500000 * (i % 2)), "1", False, f"sum{i:03d}", "u", "r", text))
    return spark.createDataFrame(rows, "id long, territory_id string, territory_name string, state_code string, date date,"
                                 " scraped_at timestamp_ntz, edition_number string, is_extra_edition boolean, file_checksum string,"
                                 " url string, file_raw_txt string, source_text string").repartition(3)


TEXTS = ["harbour", "harbour budget", "+harbour +budget", '"harbour repair"', '"the harbour" town', '"town budget"~2', '"town the town"~3',
         "harb*", "abc~1", "abc~2 budget", "abd~0", "+town + -budget", "town -budget", "-town", "+(town | budget) +(plan*)", "-(town | abc~)",
         '+"of the" + -harbour', "the", "the of", "", "zzz", "zzz -zzz", "town town", "(town + (budget | -plan)) | abc", "+a* +b*", '"town plan" -"plan town"',
         "-(-(town))", "+harbour + (the)", "“the harbour”"]
ASKED = [
    {}, {"territory_ids": ("t1", "t2")}, {"published_since": date(2024, 1, 5), "published_until": date(2024, 1, 20)},
    {"scraped_until": datetime(2024, 2, 1, 10, 30, 5)}, {"scraped_since": datetime(2024, 2, 1, 10, 7, 5), "territory_ids": ("t3",)},
    {"sort_by": "descending_date", "size": 4, "offset": 3}, {"sort_by": "ascending_date", "size": 400},
]


def requests_of(spark, asked):
    columns = "text string, territory_ids array<string>, published_since date, published_until date, scraped_since timestamp_ntz," \
              " scraped_until timestamp_ntz, sort_by string, size int, offset int"
    names = [c.split()[0] for c in columns.split(", ")]
    rows = [(f"q{i}", *[{**asdict(a), "text": a.querystring, "territory_ids": list(a.territory_ids)}[n] for n in names]) for i, a in enumerate(asked)]
    return spark.createDataFrame(rows, "query_id string, " + columns).repartition(2)


def test_equals_one_search_each(spark, docs):
    corpus = Corpus(docs.cache(), key="id", plain=PLAIN)
    asked = [SearchRequest(text, size=1000) for text in TEXTS]
    asked += [SearchRequest(text, **{"size": 1000, **more}) for more in ASKED for text in ("town -budget", "", '+"the town" +ab*')]
    index = build_index(corpus)
    requests = requests_of(spark, asked)
    got = {}
    for r in batch.batch_requests(index, requests, keep=("id",)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, round(r.score, 6)))
    totals = {r.query_id: r.total for r in batch.batch_totals(index, requests).collect()}
    for i, ask in enumerate(asked):
        found = search_gazettes(corpus, ask, keep=("id", "score"))
        page = [(ask.offset + n, r.id, round(r.score, 6)) for n, r in enumerate(found.page.collect(), 1)]
        mine = sorted(got.get(f"q{i}", []))
        assert [(n, s) for n, _, s in mine] == [(n, s) for n, _, s in page], ask
        if ask.sort_by != "relevance":
            assert mine == page, ask
        assert sorted(x[1] for x in mine) == sorted(x[1] for x in page) or ask.size < 1000, ask
        assert totals[f"q{i}"] == (len(page) if ask.size == 1000 else found.total.first()["total"]), ask


def test_no_requests_and_bad_ones(spark, docs):
    index = build_index(Corpus(docs, key="id"))
    none = requests_of(spark, [SearchRequest("x")]).where("false")
    assert batch.batch_pages(index, none).collect() == [] and batch.batch_totals(index, none).collect() == []
    few = spark.createDataFrame([(1, None), (2, "zzz")], "query_id int, text string")
    assert batch.batch_pages(index, few).collect() == []
    assert sorted(map(tuple, batch.batch_totals(index, few).collect())) == [(1, 0), (2, 0)]
    with pytest.raises(Exception, match="sort mode not allowed"):
        batch.batch_pages(index, few.selectExpr("*", "'best' AS sort_by")).collect()
    nothing = build_index(Corpus(docs.where("false"), key="id"))
    assert batch.batch_pages(nothing, spark.createDataFrame([(1, "town -budget")], "query_id int, text string")).collect() == []


@pytest.fixture(scope="module")
def stored(spark, docs, tmp_path_factory):
    corpus = Corpus(docs, key="id", plain=PLAIN)
    write_index(corpus, str(tmp_path_factory.mktemp("index")), "stored", buckets=16)
    return corpus, read_index(spark, corpus, "stored")


@pytest.mark.parametrize("text", ["harbour budget", '+"harbour repair" +plan', "+harb* +town", "town -budget", "abc~1"])
def test_stored_index_equals_the_text(stored, text):
    corpus, index = stored
    ask = SearchRequest(text, size=7, offset=2, territory_ids=("t0", "t1", "t2"))
    mine, found = batch.search_index(index, ask, keep=("id",)), search_gazettes(corpus, ask, keep=("id", "score"))
    assert [round(r.score, 6) for r in mine.page.collect()] == [round(r.score, 6) for r in found.page.collect()]
    assert mine.total.first() == found.total.first()


def test_only_asked_buckets_are_read(stored):
    index = stored[1]
    for text, most in (("harbour", 1), ('+budget +"the town"', 3)):
        plan = batch.search_index(index, SearchRequest(text)).page._jdf.queryExecution().toString()
        read = [int(n) for n in re.findall(r"SelectedBucketsCount: (\d+) out of 16", plan)]
        assert read and min(read) <= most, plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_grouped_without_shuffling_occurrences(spark):
    from recordsearch.functions.text import EXACT
    from recordsearch.plans.index import index_postings

    rows = [(1, "b a B c"), (1, "a x y z"), (2, "a"), (3, ""), (4, None), (None, "q q"), (5, "+ -")]
    corpus = Corpus(spark.createDataFrame(rows, "id int, source_text string"), key="id")
    found = index_postings(corpus, EXACT)
    assert "hashpartitioning(token" not in plan_of(found)
    assert {(r.token, r.id, r.length): r.positions for r in found.collect()} == {
        ("a", 1, 4): [0, 1], ("b", 1, 4): [0, 2], ("c", 1, 4): [3], ("x", 1, 4): [1], ("y", 1, 4): [2], ("z", 1, 4): [3],
        ("a", 2, 1): [0], ("q", None, 2): [0, 1]}


def test_lengths_of_stemmed_texts_need_no_stems(spark):
    from recordsearch.functions.text import portuguese_analysis
    from recordsearch.plans.index import index_docs

    corpus = Corpus(spark.createDataFrame([(1, "As obras públicas e de"), (2, ""), (3, None), (4, "de")], "id int, source_text string"),
                    key="id", plain=portuguese_analysis())
    found = index_docs(corpus)
    assert "amento" not in plan_of(found)
    assert sorted((r.id, r.plain_len, r.exact_len) for r in found.collect()) == [(1, 2, 5), (2, 0, 0), (3, None, None), (4, 0, 1)]


def test_asked_words_meet_queries_where_a_document_lies(spark):
    from recordsearch.plans.batch import batch_pages
    from recordsearch.plans.index import build_index

    rows = [(1, "a b", "t", date(2024, 1, 1)), (2, "a a c", "u", date(2024, 1, 2)), (3, "d", "t", None)]
    corpus = Corpus(spark.createDataFrame(rows, "id int, source_text string, territory_id string, date date"), key="id")
    asked = spark.createDataFrame([(1, "a b"), (2, "+a -b"), (3, "+a + -b")], "query_id int, text string")
    pages = batch_pages(build_index(corpus), asked)
    assert "hashpartitioning(id#" in plan_of(pages) and "REPARTITION_BY_NUM" in plan_of(pages)
    assert sorted((r.query_id, r.rank, r.id) for r in pages.collect() if r.query_id != 2) == [(1, 1, 1), (1, 2, 2), (3, 1, 2)]


def test_rarest_required_word_chooses_the_documents(spark):
    from recordsearch.functions.text import EXACT
    from recordsearch.plans.batch import _leading, batch_pages, batch_totals, read_requests

    rows = [(i, "a b" + (" c rare" if i in (3, 5) else "") + (" d" if i == 5 else ""), "t", date(2024, 1, 1)) for i in range(30)] + [(99, "rare", "t", None)]
    index = build_index(Corpus(spark.createDataFrame(rows, "id int, source_text string, territory_id string, date date"), key="id", plain=EXACT))
    texts = ["+a +b +rare", "+a +rare + -d", "a rare", "+a +b", "+a +rare +(d | zzz | b)", "+a +b +nowhere", "-a -rare", "+a +b +rare", "+a +b +rare"]
    asked = spark.createDataFrame([(min(n, 7), text) for n, text in enumerate(texts)], "query_id int, text string")
    read = read_requests(index, asked)
    assert read.required
    words = read.leaves.where("kind = 'word'")
    assert {(r.query_id, r.token) for r in _leading(index, words).collect()} == {(0, "rare"), (1, "rare"), (4, "rare"), (5, "nowhere")}
    got = {}
    for r in batch_pages(index, asked.where("query_id < 6")).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    assert got.pop(2) | got.pop(3) <= set(range(30)) | {99}
    assert got == {0: {3, 5}, 1: {3}, 4: {3, 5}}
    assert {r.query_id: r.total for r in batch_totals(index, asked.where("query_id < 6")).collect()} == {0: 2, 1: 1, 2: 31, 3: 30, 4: 2, 5: 0}


def test_only_asked_words_of_phrases_are_exchanged(spark, stored):
    asked = spark.createDataFrame([(1, '"harbour repair"'), (2, '"the town" | harb*')], "query_id int, text string")
    pages = batch.batch_pages(stored[1], asked)
    assert "LeftSemi" in plan_of(pages)
    assert not re.search(r"hashpartitioning\(query_id#\d+, id#", plan_of(pages))
    for number, text in ((1, '"harbour repair"'), (2, '"the town" | harb*')):
        want = search_gazettes(stored[0], SearchRequest(text), keep=("id", "score")).page.collect()
        got = sorted((r["rank"], round(r.score, 6)) for r in pages.where(f"query_id = {number}").collect())
        assert [s for _, s in got] == [round(r.score, 6) for r in want]


def test_stored_stems_move_no_postings_and_leave_nothing(spark, docs, tmp_path):
    from pathlib import Path

    from recordsearch.functions.text import portuguese_analysis

    def exchanged():
        folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f.name for d in folders for f in Path(d).rglob("shuffle_*.data")}

    corpus, before = Corpus(docs.unionAll(docs.where("id < 9")), key="id", plain=portuguese_analysis()), exchanged()
    kept = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    index = write_index(corpus, str(tmp_path), "stems", buckets=4)
    assert not exchanged() - before
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == kept
    assert not (tmp_path / "stems" / "plain_parts").exists() and not spark.catalog.tableExists("stems_plain_parts")
    plan = build_index(corpus)
    for mine, other in ((index.plain, plan.plain), (index.exact, plan.exact)):
        both = [sorted(map(str, side.postings.select("token", "id", "length", "positions").collect())) for side in (mine, other)]
        assert both[0] == both[1] and both[0]
        assert sorted(map(tuple, mine.words.select("token", "doc_freq").collect())) == sorted(map(tuple, other.words.select("token", "doc_freq").collect()))
