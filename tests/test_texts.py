"""Postings, batch search and excerpts, against plain Python on small texts."""

import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from recordsearch.functions.text import (
    CHUNK, EXACT, PIECE, Analysis, located_tokens, phrase_occurrences, piece_at, pieces, token_count, token_runs,
)
from recordsearch.operators import postings
from recordsearch.operators.highlight import highlight
from recordsearch.operators.match import AnyOf, Fuzzy, Phrase, Prefix, Word
from recordsearch.plans.search import (
    Corpus, ThemeRequest, clause_of, excerpt_corpus, search_excerpts, text_hits,
)
from recordsearch.schemas import EXCERPTS

TEXTS = ["Red fox, red FOX; lazy dog.", "a red-fox", "", "...", "dog dog dog dog", "été Été fox's",
         "the lazy red dog and the fox " * 40]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(3).cache()


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def test_located_tokens(docs):
    out = {r.id: r.spots for r in docs.select("id", located_tokens(F.col("text")).alias("spots")).collect()}
    for n, body in enumerate(TEXTS):
        assert [(s.token, s.start, s.stop) for s in out[n]] == [
            (m.group(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", body)]


def test_lengths_and_counts(docs):
    spaced = EXACT.spaced(F.col("text"))
    rows = docs.select("id", token_count(spaced).alias("n"),
                       phrase_occurrences(spaced, ["dog", "dog"]).alias("dd")).collect()
    assert {r.id: r.n for r in rows} == {n: len(words(t)) for n, t in enumerate(TEXTS)}
    assert {r.id: r.dd for r in rows if r.dd} == {4: 3}


def test_postings(docs):
    out = postings.build_postings(docs, "id", "text").collect()
    assert sorted((r.id, r.token, r.pos) for r in out) == sorted(
        (n, w, i) for n, t in enumerate(TEXTS) for i, w in enumerate(words(t)))
    plain = Analysis(stopwords=("the", "a"), suffixes=("s", "zy"))
    kept = postings.build_postings(docs, "id", "text", plain).select("token").distinct().collect()
    assert {r.token for r in kept} == {"red", "fox", "lazy", "dog", "été", "s", "and"}


def test_offsets_come_from_short_runs(spark):
    long = "Ärger, 10 dogs\n" * 70 + "x" * 300 + " 𝒜b 🙂 end..."
    table = spark.createDataFrame([(1, long), (2, None), (3, "... "), (4, " one")], "first int, text string")
    runs = table.select(F.inline(token_runs(F.col("text")))).collect()
    assert max(len(r.tokens) for r in runs) == CHUNK
    out = postings.build_postings(table, "first", "text").collect()
    assert sorted((r.first, r.token, r.pos, r.start) for r in out) == sorted(
        (n, m.group().lower(), i, m.start()) for n, t in ((1, long), (4, " one"))
        for i, m in enumerate(re.finditer(r"[^\W_]+", t)))


def test_stretches_read_from_pieces(spark):
    text = "aé\n🙂" * PIECE
    asked = [(s, n) for s in (0, 1, PIECE - 1, PIECE, 2 * PIECE - 3, 4 * PIECE - 2, 4 * PIECE) for n in (0, 1, 5, PIECE, 3 * PIECE)]
    table = spark.createDataFrame([(text, s, n) for s, n in asked], "text string, s int, n int")
    cut = table.withColumn("cut", pieces(F.col("text")))
    out = cut.select("s", "n", F.size("cut").alias("size"), piece_at(F.col("cut"), F.col("s"), F.col("n")).alias("got")).collect()
    assert {r.size for r in out} == {4}
    assert {(r.s, r.n): r.got for r in out} == {(s, n): text[s:s + n] for s, n in asked}


def test_stored_postings_need_no_shuffle_by_token(spark, docs):
    name = "stored_postings"
    postings.write_postings(postings.build_postings(docs, "id", "text"), name, 4)
    try:
        counted = spark.table(name).groupBy("token").count()
        assert counted.where("token = 'dog'").first()["count"] == 4 + 1 + 40
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_batch_phrases(spark, docs):
    from recordsearch.plans.index import build_index

    side = build_index(Corpus(docs, key="id", text="text")).exact
    asked = [(1, "red fox"), (2, "dog dog dog"), (3, "lazy fox"), (4, "red unheard"), (5, "fox")]
    rows = [(q, w, i) for q, t in asked for i, w in enumerate(t.split())]
    phrases = spark.createDataFrame(rows, "query_id int, token string, place int")
    out = postings.match_phrases(side.postings, "id", phrases, side.words).collect()
    lines = {r.id: postings_line(r.text) for r in docs.collect()}
    want = [(q, i, n) for q, t in asked for i, line in lines.items()
            if (n := sum(line[k:k + len(t.split())] == t.split() for k in range(len(line))))]
    assert sorted((r.query_id, r.id, r.occurrences) for r in out) == sorted(want)


def postings_line(text):
    return EXACT.words(text or "")


def neighbours(word, letters):
    """All words one edit away: a letter more, less or other, or two neighbours swapped."""
    for i in range(len(word) + 1):
        for x in letters:
            yield word[:i] + x + word[i:]
            yield word[:i] + x + word[i + 1:]
        yield word[:i] + word[i + 1:]
        yield word[:i] + word[i:i + 2][::-1] + word[i + 2:]


@pytest.mark.parametrize("edits", [1, 2])
def test_vocabulary_expansion(spark, edits):
    letters = ["".join(p) for n in range(1, 5) for p in product("abc", repeat=n)]
    base = random.Random(edits)
    for word in ("abcabcabcabca", "cabbagecab", "bcaabcab"):  # words that are cut into parts
        level = [word]
        for _ in range(3):
            level = [n for w in level for n in base.sample(sorted(set(neighbours(w, "abcx"))), 6)]
            letters += level
    letters = sorted(set(letters) - {""})
    vocabulary = spark.createDataFrame([(w,) for w in letters], "token string")
    asked = ["abca", "b", "xabc", "cc", "abcabcabcabca", "cabbagecab", "bcaabcab", "bcaacbab"]
    terms = spark.createDataFrame([(i, w) for i, w in enumerate(asked)], "query_id int, term string")
    out = {(r.term, r.token) for r in postings.expand_fuzzy(vocabulary, terms, edits).collect()}
    near = {q: {q} for q in asked}
    for _ in range(edits):
        near = {q: found | {n for w in found for n in neighbours(w, "abcx")} for q, found in near.items()}
    assert out == {(q, w) for q in asked for w in letters if w in near[q]}
    out = {(r.term, r.token) for r in postings.expand_prefixes(vocabulary, terms).collect()}
    assert out == {(q, w) for q in asked for w in letters if w.startswith(q)}


def excerpts_of(spark, text, clause, **options):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(highlight(F.col("t"), clause, **options).alias("e")).first().e


def test_excerpt_windows(spark):
    tags = {"pre_tags": ("<",), "post_tags": (">",)}
    text = "x" * 30 + " fox " + "y" * 30 + " fox " + "z" * 5
    assert excerpts_of(spark, text, Word("fox"), size=9, count=5, **tags) == ["xx <fox> yy", "yy <fox> zz"]
    assert excerpts_of(spark, text, Word("fox"), size=9, count=1, **tags) == ["xx <fox> yy"]
    assert excerpts_of(spark, text, Word("fox"), size=500, count=3, **tags) == [
        "x" * 30 + " <fox> " + "y" * 30 + " <fox> " + "z" * 5]
    assert excerpts_of(spark, text, Word("fox"), size=2, count=1, **tags) == ["<fox>"]
    assert excerpts_of(spark, text, Word("cat"), **tags) == []
    assert excerpts_of(spark, "Fox $1 \\ foxes", Prefix("fox"), pre_tags=("$1",), post_tags=("\\",)) == [
        "$1Fox\\ $1 \\ $1foxes\\"]
    assert excerpts_of(spark, None, Word("fox")) == []


def test_overlaps_are_merged_and_tags_take_turns(spark):
    both = AnyOf((Word("lazy"), Phrase("lazy dog")))
    tags = {"pre_tags": ("<b>",), "post_tags": ("</b>",)}
    assert excerpts_of(spark, "The lazy dog, lazy", both, **tags) == ["The <b>lazy dog</b>, <b>lazy</b>"]
    turns = {"pre_tags": ("<b>", "<i>"), "post_tags": ("</b>", "</i>")}
    three = AnyOf((Word("one"), Word("two"), Fuzzy("thre", 1)))
    assert excerpts_of(spark, "one two three", three, **turns) == ["<b>one</b> <i>two</i> <b>three</b>"]
    plain = Analysis(suffixes=("s",))
    mixed = AnyOf((Word("dog"), Phrase("big dogs")))
    assert excerpts_of(spark, "big dogs, dog", mixed, plain=plain, **tags) == ["<b>big dogs</b>, <b>dog</b>"]


def test_theme_search(spark):
    from datetime import date, datetime

    def row(n, theme, text, subthemes, entities, tfidf):
        return (f"x{n}", text, subthemes, entities, tfidf, 0.5, "t", "Town", "TS", date(2024, 1, n),
                datetime(2024, 1, 1), "a.pdf", "", "1", False, theme)

    table = spark.createDataFrame([
        row(1, "A", "red fox", ["s1"], ["e1"], 0.9), row(2, "A", "red dog", ["s2"], None, 0.1),
        row(3, "A", "red red fox and more words", ["s1", "s2"], ["e2", "e1"], None),
        row(4, "B", "red fox", ["s1"], ["e1"], 0.5)], EXCERPTS)
    corpus = excerpt_corpus(table)

    def ids(**ask):
        return [r.excerpt_id for r in search_excerpts(corpus, ThemeRequest(theme="A", **ask)).page.collect()]

    assert ids(sort_by="ascending_date") == ["x1", "x2", "x3"]
    assert sorted(ids()) == ["x1", "x2", "x3"]
    assert ids(entities=("e1",), subthemes=("s2",)) == ["x3"]
    assert sorted(ids(querystring="fox")) == ["x1", "x3"]
    assert ids(territory_ids=("t",))[0] == "x1"
    found = search_excerpts(corpus, ThemeRequest(theme="A", querystring="dog", pre_tags=("<",), post_tags=(">",)))
    first = found.page.first()
    assert (first.excerpt, first.entities, first.txt_url) == ("red <dog>", [], None)
    assert found.total.first().total == 1
    assert ids(querystring="fox", offset=1, size=1) == [sorted(ids(querystring="fox"), key=["x1", "x3"].index)[1]]


STEMS = """boa boa, boas boas, boataria boat, boates boat, boba bob, bobagem bobag, bobagens bobagens, bobalhões bobalhõ, bobear bob,
    bobeira bobeir, bobinho bobinh, bobs bobs, bocadas boc, bocaiúva bocaiúv, boçal boçal, bodoque bodoqu, body body, boemia boem,
    boêmio boêmi, quilométricas quilométr, quilo quil, quimioterapia quimioterap, quinhão quinhã, quintessência quintessent,
    quintuplicou quintuplic, quiosque quiosqu, rapidamente rapid, constitucionalmente constitucional, cidades cidad,
    atividade ativ, administrações administr, contratação contrat, licitação licit, sociologia sociolog, agitação agit, obras obras"""


def test_portuguese_stems(spark):
    from recordsearch.functions import portuguese

    golden = [tuple(x.split()) for x in STEMS.replace("\n", " ").split(",")]
    assert [(w, portuguese.stem_text(w)) for w, _ in golden] == golden
    rng = random.Random(2)
    ends = portuguese.NOUNS + portuguese.VERBS + ["amente", "ativamente", "idade", "logia", "uções", "ências", "ira", "eira", "gue", "cie", "ç"]
    made = ["".join(rng.choice("aeioubcrstãé") for _ in range(rng.randrange(7))) + rng.choice(ends).replace("a~", "ã").replace("o~", "õ")
            for _ in range(3000)]
    words_ = spark.createDataFrame([(w,) for w, _ in golden] + [(w,) for w in made], "w string")
    for r in words_.select("w", portuguese.stem(F.col("w")).alias("s")).collect():
        assert r.s == portuguese.stem_text(r.w), r


def test_language_search_of_text_and_index_agree(spark):
    from recordsearch.functions.text import portuguese_analysis
    from recordsearch.plans import batch
    from recordsearch.plans.index import build_index
    from recordsearch.plans.search import SearchRequest, search_gazettes

    said = ["A contratação de obras públicas", "Contratações e licitações da cidade", "As cidades contrataram", "de a o", None,
            "existência da agitação", "existentes obras"]
    rows = [(i, "t", "Town", "RJ", None, None, "1", False, f"s{i}", "u", "r", x) for i, x in enumerate(said)]
    docs = spark.createDataFrame(rows, "id long, territory_id string, territory_name string, state_code string, date date, scraped_at timestamp_ntz,"
                                 " edition_number string, is_extra_edition boolean, file_checksum string, url string, file_raw_txt string, source_text string")
    corpus = Corpus(docs, key="id", plain=portuguese_analysis())
    index = build_index(corpus)
    for text, want in (("contratar", {0, 1, 2}), ("+cidade +licitação", {1}), ('"obras públicas" | agitar', {0, 5}), ("da", set()),
                       ("existência", {5, 6})):
        found = search_gazettes(corpus, SearchRequest(text), keep=("id", "score")).page.collect()
        mine = batch.search_index(index, SearchRequest(text), keep=("id",)).page.collect()
        assert {r.id for r in found} == want == {r.id for r in mine}, text
        assert sorted(round(r.score, 6) for r in found) == sorted(round(r.score, 6) for r in mine)
