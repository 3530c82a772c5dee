"""Queries: text analysis, clauses, relevance, searches, excerpts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from recordsearch.functions.text import EXACT, Analysis, piece_at, pieces, portuguese_analysis
from recordsearch.operators import highlight, ingest, numbers, page, postings
from recordsearch.operators.match import AllOf, AnyOf, Not, Phrase, Word
from recordsearch.plans import batch
from recordsearch.plans.index import write_index
from recordsearch.plans.search import (
    Corpus, SearchRequest, ThemeRequest, clause_of, corpus_stats, excerpt_corpus,
    search_excerpts, search_gazettes, text_hits,
)
from recordsearch.sources.writers import shared_folder
from testbed import tables as t
from testbed.registry import query
from testbed.rows import NEW_URL

PLAIN = Analysis(stopwords=("the", "of", "and", "to", "de", "la", "en", "a"),
                 suffixes=("ing", "tion", "ly", "s"))
STOPS = "('the', 'of', 'and', 'to', 'de', 'la', 'en', 'a')"
STEM = "regexp_replace({0}, '^(.{{3,}}?)(tion|ing|ly|s)$', '\\1')"

# Space between words and around the text: the tokens of a text as one string.
LINE = """lines AS (SELECT doc_id AS id, ' ' || array_to_string(
    regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS line FROM documents)"""


def corpus(spark, sf):
    docs = t.documents(spark, sf).withColumnRenamed("doc_id", "id")
    return Corpus(docs, key="id", text="text")


def matching(spark, sf, clause):
    c = corpus(spark, sf)
    return text_hits(c, c.docs, clause_of(clause, c), scored=False).select("id")


# ---- analysis and postings


@query("analyze_tokens", """SELECT doc_id, md5(array_to_string(toks, ' ')) AS exact,
    md5(array_to_string(list_transform(toks, lambda x: """ + STEM.format("x") + """), ' ')) AS with_stopwords,
    md5(array_to_string(list_transform(list_filter(toks, lambda x: x NOT IN """ + STOPS + """),
      lambda x: """ + STEM.format("x") + """), ' ')) AS plain FROM token_lists""", t.TOKENS)
def analyze_tokens(spark, sf):
    kinds = {"exact": EXACT, "with_stopwords": Analysis(suffixes=PLAIN.suffixes), "plain": PLAIN}
    out = postings.analyze_tokens(t.documents(spark, sf), "text", kinds)
    return out.select("doc_id", *[F.md5(F.array_join(k, " ")).alias(k) for k in kinds])


@query("analyze_spaced", """SELECT doc_id, md5(array_to_string(list_transform(list_filter(toks,
      lambda x: x NOT IN """ + STOPS + """), lambda x: """ + STEM.format("x") + """), ' ')) AS plain
  FROM token_lists""", t.TOKENS)
def analyze_spaced(spark, sf):
    words = F.trim(F.replace(PLAIN.spaced(F.col("text")), F.lit("  "), F.lit(" ")))
    return t.documents(spark, sf).select("doc_id", F.md5(words).alias("plain"))


DICTIONARY = """dict AS (SELECT DISTINCT token, 'n_' || token AS norm FROM postings
  WHERE token LIKE 'an%')"""


@query("normalize_vocabulary", """SELECT v.token, coalesce(d.norm, """ + STEM.format("v.token") + """) AS norm
  FROM (SELECT DISTINCT token FROM postings) v LEFT JOIN dict d ON d.token = v.token""", t.TOKENS, DICTIONARY)
def normalize_vocabulary(spark, sf):
    rows = t.postings(spark, sf)
    words = rows.select("token").where("token LIKE 'an%'").distinct()
    dictionary = words.withColumn("norm", F.concat(F.lit("n_"), "token"))
    return postings.normalize_vocabulary(rows, dictionary, PLAIN)


@query("apply_vocabulary", """SELECT token, count(*) AS n, sum(pos)::BIGINT AS positions FROM
  (SELECT """ + STEM.format("token") + """ AS token, pos FROM postings) GROUP BY 1""", t.TOKENS)
def apply_vocabulary(spark, sf):
    rows = t.postings(spark, sf)
    stems = postings.normalize_vocabulary(rows, analysis=PLAIN)
    out = postings.apply_vocabulary(rows, stems)
    return out.groupBy("token").agg(F.count("*").alias("n"), F.sum("pos").cast("long").alias("positions"))


@query("build_postings", """SELECT doc_id, count(*) AS n, sum(pos)::BIGINT AS positions,
    sum(strlen(token))::BIGINT AS bytes FROM postings GROUP BY doc_id""", t.TOKENS)
def build_postings(spark, sf):
    rows = postings.build_postings(t.documents(spark, sf), "doc_id", "text")
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum("pos").cast("long").alias("positions"),
        F.sum(F.octet_length("token")).cast("long").alias("bytes"))


@query("postings_offsets", """SELECT doc_id, count(*) AS n FROM postings GROUP BY doc_id""", t.TOKENS)
def postings_offsets(spark, sf):
    """Occurrences whose text at the start offset is the token: all of them."""
    rows = postings.build_postings(t.documents(spark, sf), "doc_id", "text")
    docs = t.documents(spark, sf).select("doc_id", pieces(F.col("text")).alias("pieces"))
    there = F.lower(piece_at(F.col("pieces"), F.col("start"), F.length("token"))) == F.col("token")
    return rows.join(docs, "doc_id").where(there).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("token_stats", """SELECT token, count(*) AS doc_freq, sum(tf)::BIGINT AS total_freq FROM freqs
  GROUP BY token""", t.TOKENS)
def token_stats(spark, sf):
    return postings.token_stats(postings.term_frequencies(t.postings(spark, sf), "doc_id"))


@query("corpus_stats", """SELECT count(*) AS n_docs, round(avg(length), 6) AS mean_length,
    (SELECT count(*) FROM freqs WHERE token = 'attion') AS attion,
    (SELECT count(*) FROM freqs WHERE token = 'the') AS the FROM lengths""", t.TOKENS)
def corpus_numbers(spark, sf):
    out = corpus_stats(corpus(spark, sf), AnyOf((Word("attion"), Word("the"))))
    return out.select("n_docs", F.round("plain_len", 6).alias("mean_length"),
                      F.col("plain attion").alias("attion"), F.col("plain the").alias("the"))


@query("document_lengths", "SELECT doc_id, length FROM lengths", t.TOKENS)
def document_lengths(spark, sf):
    return postings.document_lengths(t.documents(spark, sf), "doc_id", "text")


# ---- clauses

# The SQL engine measures bytes; one plain letter for each accented one makes
# it measure letters.
PLAIN_LETTERS = "translate({0}, 'ßäçèéêíñóöü', 'ABCDEFGHIJK')"


@query("match_any", "SELECT DISTINCT doc_id AS id FROM postings WHERE token IN ('attion', 'haed', 'oution')",
       t.TOKENS)
def match_any(spark, sf):
    return matching(spark, sf, "attion haed | oution")


@query("match_all_terms", """SELECT doc_id AS id FROM postings WHERE token IN ('attion', 'to', 'haed')
  GROUP BY doc_id HAVING count(DISTINCT token) = 3""", t.TOKENS)
def match_all_terms(spark, sf):
    return matching(spark, sf, "+attion +to +haed")


@query("match_not", """SELECT doc_id AS id FROM token_lists
  WHERE list_contains(toks, 'the') AND NOT list_contains(toks, 'attion')""", t.TOKENS)
def match_not(spark, sf):
    return matching(spark, sf, AllOf((Word("the"), Not(Word("attion")))))


@query("match_phrase", "SELECT id FROM lines WHERE contains(line, ' eriner thanea the ')", LINE)
def match_phrase(spark, sf):
    return matching(spark, sf, '"eriner thanea the"')


@query("match_phrase_slop", """SELECT DISTINCT a.doc_id AS id FROM postings a JOIN postings b
  ON a.doc_id = b.doc_id AND a.token = 'the' AND b.token = 'anea' AND abs(b.pos - 1 - a.pos) <= 3""",
       t.TOKENS)
def match_phrase_slop(spark, sf):
    return matching(spark, sf, '"the anea"~3')


@query("match_phrase_slop_three", """SELECT DISTINCT a.doc_id AS id FROM postings a, postings b, postings c
  WHERE a.doc_id = b.doc_id AND b.doc_id = c.doc_id AND a.token = 'of' AND b.token = 'the' AND c.token = 'haed'
    AND greatest(a.pos, b.pos - 1, c.pos - 2) - least(a.pos, b.pos - 1, c.pos - 2) <= 4""", t.TOKENS)
def match_phrase_slop_three(spark, sf):
    return matching(spark, sf, Phrase("of the haed", 4))


@query("match_prefix", "SELECT id FROM lines WHERE contains(line, ' onble')", LINE)
def match_prefix(spark, sf):
    return matching(spark, sf, "onble*")


@query("match_fuzzy", """SELECT DISTINCT doc_id AS id FROM postings
  WHERE damerau_levenshtein({0}, 'attion') <= 1 OR damerau_levenshtein({0}, 'esnont') <= 2""".format(
    PLAIN_LETTERS.format("token")), t.TOKENS)
def match_fuzzy(spark, sf):
    return matching(spark, sf, "attion~1 esnont~2")


@query("match_grouped", """SELECT id FROM lines WHERE (contains(line, ' attion ') AND
    (contains(line, ' attion to ') OR contains(line, ' nonbl'))) OR
    (contains(line, ' oution ') AND NOT contains(line, ' the '))""", LINE)
def match_grouped(spark, sf):
    return matching(spark, sf, '(+attion +("attion to" | nonbl*)) | (oution + -the)')


@query("match_plain_analysis", """SELECT DISTINCT doc_id AS id FROM postings
  WHERE token NOT IN """ + STOPS + " AND " + STEM.format("token") + " = 'haed'", t.TOKENS)
def match_plain_analysis(spark, sf):
    c = Corpus(corpus(spark, sf).docs, key="id", text="text", plain=PLAIN)
    return text_hits(c, c.docs, clause_of("haedtion of", c), scored=False).select("id")


def matching_plain(spark, sf, clause):
    c = Corpus(corpus(spark, sf).docs, key="id", text="text", plain=PLAIN)
    return text_hits(c, c.docs, clause_of(clause, c), scored=False).select("id")


@query("match_all_stopwords", """SELECT doc_id AS id FROM postings WHERE """ + STEM.format("token") + """ = 'haed'
  GROUP BY doc_id""", t.TOKENS)
def match_all_stopwords(spark, sf):
    return matching_plain(spark, sf, "+haed +the +(of | to)")


@query("match_not_stopwords", """SELECT doc_id AS id FROM token_lists WHERE len(list_filter(toks,
  lambda x: """ + STEM.format("x") + """ = 'haed')) > 0 AND NOT list_contains(toks, 'with')""", t.TOKENS)
def match_not_stopwords(spark, sf):
    return matching_plain(spark, sf, "haed + -the + -(with + the)")


@query("match_phrase_slop_equal_words", """SELECT DISTINCT a.doc_id AS id FROM postings a JOIN postings b
  ON a.doc_id = b.doc_id AND a.token = 'the' AND b.token = 'the' AND b.pos > a.pos JOIN postings c
  ON a.doc_id = c.doc_id AND c.token = 'the' AND c.pos > b.pos AND c.pos - 2 - a.pos <= 4""", t.TOKENS)
def match_phrase_slop_equal_words(spark, sf):
    return matching(spark, sf, '"the the the"~4')


# ---- relevance

SCORE = """ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * length / mean))"""

SCORED = t.TOKENS + """,
corpus AS (SELECT count(*) AS n, avg(length) AS mean FROM lengths),
dfs AS (SELECT token, count(*) AS df FROM freqs GROUP BY token),
scores AS (SELECT doc_id, token, """ + SCORE + """ AS s
  FROM freqs JOIN dfs USING (token) JOIN lengths USING (doc_id), corpus)"""


@query("score_bm25", """SELECT doc_id AS id, round(sum(s), 6) AS score FROM scores
  WHERE token IN ('the', 'attion', 'haed') GROUP BY doc_id""", SCORED)
def score_bm25(spark, sf):
    c = corpus(spark, sf)
    hits = text_hits(c, c.docs, clause_of("the attion haed", c))
    return hits.select("id", F.round("score", 6).alias("score"))


@query("score_phrase", """SELECT id, round((SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5))) FROM dfs, corpus
      WHERE token IN ('attion', 'to')) * tf / (tf + 1.2 * (0.25 + 0.75 * length / mean)), 6) AS score
  FROM (SELECT id, (length(line) - length(replace(line, ' attion to ', ''))) / length(' attion to ') AS tf FROM lines)
  JOIN lengths ON doc_id = id, corpus WHERE tf > 0""", SCORED, LINE)
def score_phrase(spark, sf):
    c = corpus(spark, sf)
    hits = text_hits(c, c.docs, clause_of('"attion to"', c))
    return hits.select("id", F.round("score", 6).alias("score"))


@query("sort_by_relevance", """SELECT doc_id AS id, round(sum(s), 6) AS score FROM scores
  WHERE token IN ('attion', 'the') GROUP BY doc_id ORDER BY round(sum(s), 9) DESC, doc_id LIMIT 50""", SCORED)
def sort_by_relevance(spark, sf):
    c = corpus(spark, sf)
    hits = text_hits(c, c.docs, clause_of("attion the", c))
    top = page.paginate(hits, [F.col("score").desc(), F.col("id")], 0, 50)
    return top.select("id", F.round("score", 6).alias("score"))


PIVOTS = """pivots AS (SELECT exp(avg(ln(excerpt_tfidf_score))) AS p1,
  exp(avg(ln(excerpt_embedding_score))) AS p2 FROM excerpts WHERE theme = 'en')"""
BOOST = """excerpt_tfidf_score / (excerpt_tfidf_score + p1)
    + excerpt_embedding_score / (excerpt_embedding_score + p2)"""


@query("rank_feature_boost", f"""SELECT excerpt_id, round({BOOST}, 6) AS score FROM excerpts, pivots
  WHERE theme = 'en' AND source_territory_id IN ('src1', 'src2', 'src3')""", t.EXCERPTS, PIVOTS)
def rank_feature_boost(spark, sf):
    from recordsearch.plans.search import excerpt_hits

    c = excerpt_corpus(t.excerpts(spark, sf))
    ask = ThemeRequest(theme="en", territory_ids=("src1", "src2", "src3"))
    return excerpt_hits(c, ask)[0].select("excerpt_id", F.round("score", 6).alias("score"))


# ---- searches


def gazette_corpus(spark, sf):
    return Corpus(t.gazettes(spark, sf), key="id")


WANTED = """territory_id <> 'src7' AND date >= DATE '2024-01-05' AND contains(line, ' the ')
    AND (contains(line, ' attion to ') OR contains(line, ' haed '))"""
ASKED = dict(
    querystring='+the +(“attion to” | haed)',
    territory_ids=tuple(f"src{i}" for i in range(20) if i != 7),
    published_since=date(2024, 1, 5), pre_tags=("<b>",), post_tags=("</b>",),
)

FOUND = SCORED + ",\n" + LINE + ",\n" + t.GAZETTES + f""",
weights AS (SELECT token, ln(1 + (n - df + 0.5) / (df + 0.5)) AS w FROM dfs, corpus),
phrase AS (SELECT id AS doc_id, (SELECT sum(w) FROM weights WHERE token IN ('attion', 'to'))
    * tf / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS s
  FROM (SELECT id, (length(line) - length(replace(line, ' attion to ', ''))) / length(' attion to ') AS tf
    FROM lines) JOIN lengths ON doc_id = id, corpus WHERE tf > 0),
points AS (SELECT doc_id AS id, sum(s) AS score FROM
    (SELECT doc_id, s FROM scores WHERE token IN ('the', 'haed') UNION ALL SELECT doc_id, s FROM phrase)
  GROUP BY 1),
found AS (SELECT g.*, score FROM gazettes g JOIN lines USING (id) JOIN points USING (id) WHERE {WANTED})"""


@query("search_gazettes", f"""SELECT id, territory_id, CAST(date AS VARCHAR) AS date,
    {NEW_URL.format('url')} AS url, edition_number AS edition, round(score, 6) AS score, 1 AS n_excerpts
  FROM found ORDER BY round(score, 9) DESC, territory_id, found.date DESC, id LIMIT 10 OFFSET 5""", FOUND)
def search_gazettes_query(spark, sf):
    ask = SearchRequest(**ASKED, offset=5)
    out = search_gazettes(gazette_corpus(spark, sf), ask, t.STORE, keep=("id", "score"))
    return out.page.select(
        "id", "territory_id", F.col("date").cast("string").alias("date"), "url", "edition",
        F.round("score", 6).alias("score"), F.size("excerpts").alias("n_excerpts"))


@query("search_gazettes_by_date", """SELECT id, CAST(date AS VARCHAR) AS date FROM found
  ORDER BY found.date, territory_id, id LIMIT 25""", FOUND)
def search_gazettes_by_date(spark, sf):
    ask = SearchRequest(**ASKED, size=25, sort_by="ascending_date")
    out = search_gazettes(gazette_corpus(spark, sf), ask, t.STORE, keep=("id",))
    return out.page.select("id", F.col("date").cast("string").alias("date"))


@query("search_gazettes_empty", "SELECT doc_id AS id FROM documents WHERE false")
def search_gazettes_empty(spark, sf):
    return search_gazettes(gazette_corpus(spark, sf), SearchRequest(), keep=("id",)).page.select("id")


@query("total_hits", "SELECT count(*) AS total FROM found", FOUND)
def total_hits(spark, sf):
    return search_gazettes(gazette_corpus(spark, sf), SearchRequest(**ASKED)).total


@query("search_excerpts", f"""SELECT excerpt_id, source_territory_id AS territory_id, round(score, 6) AS score
  FROM (SELECT *, {BOOST} + (SELECT coalesce(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf
        / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 0)
      FROM en_freqs f JOIN en_dfs USING (token) JOIN lengths USING (doc_id), en_corpus
      WHERE f.excerpt_id = excerpts.excerpt_id AND token IN ('the', 'haed')) AS score
    FROM excerpts, pivots WHERE theme = 'en'
      AND list_has_any(excerpt_entities, ['e1', 'e2', 'e3'])
      AND EXISTS (SELECT 1 FROM en_freqs f WHERE f.excerpt_id = excerpts.excerpt_id AND token IN ('the', 'haed')))
  ORDER BY round(score, 9) DESC, source_territory_id, source_date DESC, excerpt_id LIMIT 20""",
       t.EXCERPTS, PIVOTS, t.TOKENS, """en_freqs AS (SELECT e.excerpt_id, f.* FROM excerpts e JOIN freqs f
    ON e.excerpt_id = 'x' || f.doc_id WHERE theme = 'en'),
en_dfs AS (SELECT token, count(*) AS df FROM en_freqs GROUP BY token),
en_corpus AS (SELECT count(*) AS n, avg(length) AS mean FROM excerpts JOIN lengths
    ON excerpt_id = 'x' || doc_id WHERE theme = 'en')""")
def search_excerpts_query(spark, sf):
    ask = ThemeRequest(theme="en", querystring="the haed", entities=("e1", "e2", "e3"), size=20)
    out = search_excerpts(excerpt_corpus(t.excerpts(spark, sf)), ask, t.STORE, keep=("score",), themes=t.excerpt_themes(spark, sf))
    return out.page.select("excerpt_id", "territory_id", F.round("score", 6).alias("score"))


@query("search_excerpts_all", """SELECT excerpt_id, length(excerpt) AS n_chars FROM excerpts WHERE theme = 'es'
  ORDER BY source_territory_id, source_date DESC, excerpt_id LIMIT 30""", t.EXCERPTS)
def search_excerpts_all(spark, sf):
    out = search_excerpts(excerpt_corpus(t.excerpts(spark, sf)), ThemeRequest(theme="es", size=30))
    return out.page.select("excerpt_id", F.length("excerpt").cast("long").alias("n_chars"))


# ---- many queries at once

BATCH = SCORED + """,
asked AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS words FROM benchmark),
terms AS (SELECT query_id, unnest(words) AS token FROM asked)"""


def batch_queries(spark, sf):
    """All words of each benchmark text, each once, as one query per text."""
    words = F.array_distinct(EXACT.tokens(F.col("text")))
    return t.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("words"))


def batch_terms(spark, sf):
    return batch_queries(spark, sf).select("query_id", F.explode("words").alias("token"))


@query("search_postings", "SELECT query_id, doc_id, token, tf FROM freqs JOIN terms USING (token)", BATCH)
def search_postings(spark, sf):
    side = t.index(spark, sf).exact
    out = postings.search_postings(side.postings, batch_terms(spark, sf), spread=False)
    return out.select("query_id", F.col("id").alias("doc_id"), "token", F.size("positions").cast("long").alias("tf"))


@query("batch_search", """SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id
      ORDER BY round(score, 9) DESC, source, doc_id % 90 DESC, doc_id)::INT AS rank
    FROM (SELECT query_id, doc_id, sum(s) AS score FROM terms JOIN scores USING (token) GROUP BY 1, 2)
    JOIN documents USING (doc_id)) WHERE rank <= 10""", BATCH)
def batch_search(spark, sf):
    asked = batch_queries(spark, sf).select("query_id", F.array_join("words", " ").alias("text"))
    out = batch.batch_pages(t.index(spark, sf), asked)
    return out.select("query_id", F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@query("batch_search_all", """SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id
    ORDER BY doc_id % 90, source, doc_id)::INT AS rank
  FROM (SELECT query_id, doc_id FROM terms JOIN freqs USING (token) GROUP BY query_id, doc_id
      HAVING count(*) = (SELECT len(words) FROM asked a WHERE a.query_id = terms.query_id)) JOIN documents USING (doc_id)
    WHERE doc_id NOT IN (SELECT doc_id FROM freqs WHERE token = 'attion') AND source <> 'src7'
  QUALIFY rank <= 5""", BATCH)
def batch_search_all(spark, sf):
    text = F.concat(F.lit("+"), F.array_join("words", " +"), F.lit(" + -Attion"))
    towns = F.array(*[F.lit(f"src{i}") for i in range(20) if i != 7])
    asked = batch_queries(spark, sf).select("query_id", text.alias("text"), towns.alias("territory_ids"),
                                            F.lit("ascending_date").alias("sort_by"), F.lit(5).alias("size"))
    out = batch.batch_pages(t.index(spark, sf), asked)
    return out.select("query_id", F.col("id").alias("doc_id"), "rank")


@query("batch_totals", """SELECT query_id, count(DISTINCT doc_id) AS total FROM asked LEFT JOIN terms USING (query_id)
  LEFT JOIN freqs USING (token) GROUP BY query_id""", BATCH)
def batch_totals(spark, sf):
    asked = batch_queries(spark, sf).select("query_id", F.array_join("words", " ").alias("text"))
    return batch.batch_totals(t.index(spark, sf), asked)


#: Word idf, and per document the occurrences of the second and third word in a row, of a prefix and of the fourth word.
REQUESTED = BATCH + """,
wide AS (SELECT doc_id, source, '  ' || array_to_string(toks, '  ') || '  ' AS line, length FROM token_lists
  JOIN lengths USING (doc_id) JOIN documents USING (doc_id)),
weights AS (SELECT token, ln(1 + (n - df + 0.5) / (df + 0.5)) AS w FROM dfs, corpus),
said AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS words FROM benchmark),
tried AS (SELECT query_id, words, doc_id, source,
    (length(line) - length(replace(line, ' ' || words[2] || '  ' || words[3] || ' ', ''))) / (length(words[2]) + length(words[3]) + 4) AS tf,
    contains(line, ' ' || words[4] || ' ') AS has, contains(line, ' ' || words[1][1:3]) AS begun, length FROM said, wide),
judged AS (SELECT query_id, doc_id, source, coalesce(((SELECT w FROM weights WHERE token = words[2]) + (SELECT w FROM weights WHERE token = words[3]))
    * tf / (tf + 1.2 * (0.25 + 0.75 * length / mean)), 0) + CASE WHEN begun AND NOT has THEN 2 ELSE 0 END AS score
  FROM tried, corpus WHERE tf > 0 OR (begun AND NOT has))"""


@query("batch_requests", """SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY round(score, 9) DESC, source, doc_id % 90 DESC, doc_id)::INT AS rank FROM judged
    WHERE doc_id % 90 >= 10 AND source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5')) WHERE rank BETWEEN 3 AND 12""", REQUESTED)
def batch_requests(spark, sf):
    """A phrase, or a prefix without another word, in some towns from a day on, the second page."""
    words = EXACT.tokens(F.col("text"))
    text = F.concat(F.lit('"'), words[1], F.lit(" "), words[2], F.lit('" | (+'), F.left(words[0], F.lit(3)), F.lit("* + -"), words[3], F.lit(")"))
    towns = F.array(*[F.lit(f"src{i}") for i in range(6)])
    asked = t.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), text.alias("text"), towns.alias("territory_ids"), F.lit(date(2024, 1, 11)).alias("published_since"),
        F.lit(10).alias("size"), F.lit(2).alias("offset"))
    out = batch.batch_requests(t.index(spark, sf), asked, t.STORE, keep=("id",))
    return out.select("query_id", F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@query("search_index", f"""SELECT id, territory_id, CAST(date AS VARCHAR) AS date, {NEW_URL.format('url')} AS url,
    round(score, 6) AS score FROM found ORDER BY round(score, 9) DESC, territory_id, found.date DESC, id LIMIT 10 OFFSET 5""", FOUND)
def search_index_query(spark, sf):
    out = batch.search_index(t.index(spark, sf), SearchRequest(**ASKED, offset=5), t.STORE, keep=("id",))
    return out.page.select("id", "territory_id", F.col("date").cast("string").alias("date"), "url", F.round("score", 6).alias("score"))


LATEST = """latest AS (SELECT doc_id FROM documents QUALIFY row_number() OVER (
    PARTITION BY md5(text) ORDER BY doc_id % 2 DESC, doc_id DESC) = 1)"""


def kept_numbers(spark, sf):
    """Numbers of the even documents, then of a load of the odd ones, which replace those with the same text."""
    docs = t.gazettes(spark, sf).select("id", "file_checksum", "source_text")
    current = ingest.bulk_load_latest(None, docs.where("id % 2 = 0"), ["file_checksum"], "id")
    return numbers.numbers_after_load(numbers.count_numbers(current, "source_text"), current, docs.where("id % 2 = 1"),
                                      ["file_checksum"], "id", "source_text")


@query("kept_word_numbers", """SELECT side, token, count(*) AS doc_freq FROM freqs SEMI JOIN latest USING (doc_id),
  (VALUES ('plain'), ('exact')) v(side) GROUP BY ALL""", t.TOKENS, LATEST)
def kept_word_numbers(spark, sf):
    return kept_numbers(spark, sf).words


@query("kept_sizes", """SELECT count(*) AS n_docs, count(*) AS plain_texts, sum(length)::BIGINT AS plain_tokens, count(*) AS exact_texts,
  sum(length)::BIGINT AS exact_tokens FROM lengths SEMI JOIN latest USING (doc_id)""", t.TOKENS, LATEST)
def kept_sizes(spark, sf):
    return kept_numbers(spark, sf).sizes


@query("search_kept_numbers", """SELECT id, round(score, 6) AS score FROM found
  ORDER BY round(score, 9) DESC, territory_id, found.date DESC, id LIMIT 10""", FOUND)
def search_kept_numbers(spark, sf):
    kept = numbers.count_numbers(t.gazettes(spark, sf), "source_text")
    out = search_gazettes(gazette_corpus(spark, sf), SearchRequest(**ASKED), t.STORE, stats=kept, keep=("id", "score"))
    return out.page.select("id", F.round("score", 6).alias("score"))


@query("topk_per_query", """SELECT territory_id, id, row_number() OVER (PARTITION BY territory_id
    ORDER BY date DESC, id)::INT AS rank FROM gazettes QUALIFY rank BETWEEN 3 AND 7""", t.GAZETTES)
def topk_per_query(spark, sf):
    rows = t.gazettes(spark, sf).select("territory_id", "id", "date")
    order = [F.col("date").desc(), F.col("id").asc()]
    out = page.topk_per_group(rows, ["territory_id"], order, 2, 5, ["id"])
    return out.select("territory_id", "id", "rank")


@query("topk_deep_pages", """SELECT lang, doc_id, row_number() OVER (PARTITION BY lang
    ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents QUALIFY rank BETWEEN 101 AND 1300""")
def topk_deep_pages(spark, sf):
    rows = t.table(spark, sf, "documents").select("lang", "doc_id", "n_chars")
    order = [F.col("n_chars").desc(), F.col("doc_id").asc()]
    out = page.topk_per_group(rows, ["lang"], order, 100, 1200, ["doc_id"])
    return out.select("lang", "doc_id", "rank")


PHRASES = """asked_phrases AS (SELECT item_id AS query_id, ' ' || array_to_string(
    regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), '  ') || ' ' AS phrase FROM benchmark),
wide AS (SELECT doc_id, ' ' || array_to_string(toks, '  ') || ' ' AS line FROM token_lists)"""


@query("batch_phrases", """SELECT query_id, doc_id, ((length(line) - length(replace(line, phrase, ''))) / length(phrase))::BIGINT AS occurrences
  FROM asked_phrases JOIN wide ON contains(line, phrase)""", t.TOKENS, PHRASES)
def batch_phrases(spark, sf):
    """All words of each benchmark text as one phrase."""
    words = t.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.posexplode(EXACT.tokens(F.col("text"))).alias("place", "token"))
    side = t.index(spark, sf).exact
    out = postings.match_phrases(side.postings, "id", words, side.words)
    return out.select("query_id", F.col("id").alias("doc_id"), "occurrences")


VOCABULARY = "vocabulary AS (SELECT DISTINCT token FROM postings)"


@query("expand_prefixes", """SELECT query_id, term, v.token FROM
    (SELECT DISTINCT query_id, left(token, 5) AS term FROM terms) q
    JOIN vocabulary v ON starts_with(v.token, term)""", BATCH, VOCABULARY)
def expand_prefixes(spark, sf):
    vocabulary = t.index(spark, sf).exact.words
    prefixes = batch_terms(spark, sf).select("query_id", F.left("token", F.lit(5)).alias("term")).distinct()
    return postings.expand_prefixes(vocabulary, prefixes)


@query("expand_fuzzy", """SELECT query_id, q.token AS term, v.token FROM terms q
    JOIN vocabulary v ON damerau_levenshtein({}, {}) <= 1""".format(
    PLAIN_LETTERS.format("v.token"), PLAIN_LETTERS.format("q.token")), BATCH, VOCABULARY)
def expand_fuzzy(spark, sf):
    vocabulary = t.index(spark, sf).exact.words
    terms = batch_terms(spark, sf).withColumnRenamed("token", "term")
    return postings.expand_fuzzy(vocabulary, terms, 1)


# ---- excerpts with tags

FIRST_AT = """spots AS (SELECT id, text, length(regexp_extract(text,
    '(?is)^(.*?[^\\p{L}\\p{N}]|)thanedble(?:[^\\p{L}\\p{N}]|$)', 1)) AS p FROM
    (SELECT doc_id AS id, text FROM documents JOIN lines ON id = doc_id WHERE contains(line, ' thanedble '))),
cuts AS (SELECT *, greatest(p - 45, 0) AS b0, least(greatest(p - 45, 0) + 100, length(text)) AS e FROM spots),
frames AS (SELECT *, least(b0, greatest(e - 100, 0)) AS b FROM cuts)"""


TAGGED = "regexp_replace({}, '(?i)([^\\p{{L}}\\p{{N}}>]|^)(thanedble)([^\\p{{L}}\\p{{N}}]|$)', '\\1<b>\\2</b>\\3', 'g')"


@query("highlight", f"SELECT id, md5({TAGGED.format(TAGGED.format('text[b+1:e]'))}) AS digest FROM frames",
       LINE, FIRST_AT)
def highlight_query(spark, sf):
    c = corpus(spark, sf)
    clause = clause_of("thanedble", c)
    hits = text_hits(c, c.docs, clause, scored=False)
    marked = highlight.highlight(F.col("text"), clause, size=100, pre_tags=("<b>",), post_tags=("</b>",))
    return hits.select("id", F.md5(marked[0]).alias("digest"))


@query("stem_vocabulary")
def stem_vocabulary(spark, sf):
    """The stem of every word of the corpus, by the rules for Portuguese."""
    return postings.normalize_vocabulary(t.index(spark, sf).exact.words, analysis=portuguese_analysis())


@query("search_portuguese")
def search_portuguese(spark, sf):
    """Language analysis in the index, phrases in the exact one."""
    asked = SearchRequest('ciones +(los | "de la") + -mente*', size=50)
    c = Corpus(t.gazettes(spark, sf), key="id", plain=portuguese_analysis())
    out = batch.search_index(write_index(c, shared_folder(spark), buckets=16), asked, t.STORE, keep=("id",))
    return out.page.select("id", F.round("score", 6).alias("score"))


@query("highlight_merged")
def highlight_merged(spark, sf):
    c = Corpus(corpus(spark, sf).docs, key="id", text="text", plain=PLAIN)
    clause = clause_of('attion "attion to" nonble', c)
    hits = text_hits(c, c.docs, clause, scored=False)
    marked = highlight.highlight(F.col("text"), clause, PLAIN, EXACT, 200, 3, ("<b>",), ("</b>",))
    return hits.select("id", F.array_join(marked, "|").alias("excerpts"))


CYCLE_AT = """first_spots AS (SELECT id, text, length(regexp_extract(text, '{0}', 1)) AS p,
    length(regexp_extract(text, '{0}', 2)) AS n FROM (SELECT doc_id AS id, text FROM documents JOIN lines ON id = doc_id
    WHERE contains(line, ' attion ') OR contains(line, ' haed ') OR contains(line, ' oution '))),
first_cuts AS (SELECT *, greatest(p - (200 - n) // 2, 0) AS b0 FROM first_spots),
first_ends AS (SELECT *, least(b0 + 200, length(text)) AS e FROM first_cuts),
first_frames AS (SELECT *, least(b0, greatest(e - 200, 0)) AS b FROM first_ends),
cut_texts AS (SELECT id, CASE WHEN b > 0 THEN 1 ELSE 0 END AS l, CASE WHEN e < length(text) THEN 1 ELSE 0 END AS r,
    text[b + 1 - CASE WHEN b > 0 THEN 1 ELSE 0 END : e + 1] AS x FROM first_frames)""".format(
        "(?is)^(.*?[^\\p{L}\\p{N}]|)(attion|haed|oution)(?:[^\\p{L}\\p{N}]|$)")


def _tagged(inner: str, word: str, tag: str) -> str:
    once = ("regexp_replace({0}, '(?i)([^\\p{{L}}\\p{{N}}>]|^)(" + word + ")([^\\p{{L}}\\p{{N}}]|$)', '\\1<" + tag
            + ">\\2</" + tag + ">\\3', 'g')")
    return once.format(once.format(inner))


@query("highlight_tags_cycle", "SELECT id, md5(y[1 + l : length(y) - r]) AS digest FROM (SELECT *, "
       + _tagged(_tagged(_tagged("x", "attion", "b"), "haed", "i"), "oution", "b") + " AS y FROM cut_texts)", LINE, CYCLE_AT)
def highlight_tags_cycle(spark, sf):
    c = corpus(spark, sf)
    clause = clause_of("attion haed oution", c)
    hits = text_hits(c, c.docs, clause, scored=False)
    marked = highlight.highlight(F.col("text"), clause, size=200, count=2,
                                 pre_tags=("<b>", "<i>"), post_tags=("</b>", "</i>"))
    return hits.select("id", F.md5(marked[0]).alias("digest"))
