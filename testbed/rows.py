"""Queries: sources, filters, projections, orders, scalar functions."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from recordsearch.functions import dates, taxid, text, urls
from recordsearch.operators import catalogue, cities, files, filters, jobstats, page, results, spiders
from recordsearch.sources import readers, writers
from testbed import tables as t
from testbed.registry import query

# ---- sources and sinks


@query("scan_documents", "SELECT doc_id, lang, source, n_chars FROM documents")
def scan_documents(spark, sf):
    docs = readers.scan_documents(spark, f"{sf}/documents.parquet", schema=None)
    return docs.select("doc_id", "lang", "source", "n_chars")


CITY_OUT = """ibge_id AS territory_id, city_name AS territory_name, uf AS state_code,
  CASE WHEN gazettes_urls <> '' THEN array_to_string(string_split(gazettes_urls, ','), '|') END AS urls,
  openness_level AS level, availability_date"""


def city_out(df):
    return df.withColumn("urls", F.array_join("publication_urls", "|")).drop("publication_urls")


@query("scan_cities_csv", f"SELECT {CITY_OUT} FROM cities", t.CITIES)
def scan_cities_csv(spark, sf):
    folder = writers.shared_folder(spark)
    t.cities(spark, sf).drop("seq").write.option("header", True).csv(folder)
    return city_out(cities.city_record(readers.scan_cities_csv(spark, folder)))


@query("scan_theme_catalogue", """SELECT name, "index", p_brand AS first_query,
  2 AS n_queries, 4 AS n_cases FROM themes""", t.THEMES)
def scan_theme_catalogue(spark, sf):
    folder = writers.shared_folder(spark)
    entry = F.struct("name", "index", "queries", "entities")
    writers.write_json(t.themes(spark, sf).select(F.array(entry).alias("themes")), folder)
    found = readers.scan_theme_catalogue(spark, folder, multi_line=False)
    return found.select(
        "name", "index", F.col("queries")[0]["title"].alias("first_query"),
        F.size("queries").alias("n_queries"), F.size("entities.cases").alias("n_cases"),
    )


@query("scan_relational", """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
  WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'""")
def scan_relational(spark, sf):
    rows = readers.select_rows(t.table(spark, sf, "orders"),
                               {"o_orderstatus": "F", "o_orderpriority": "5-LOW"})
    return rows.select("o_orderkey", "o_custkey", "o_totalprice")


@query("rebuild_dataset", """SELECT id, territory_id, state_code, CAST(date AS VARCHAR) AS date,
  file_checksum FROM gazettes""", t.GAZETTES)
def rebuild_dataset(spark, sf):
    folder = writers.shared_folder(spark)
    writers.rebuild_dataset(t.gazettes(spark, sf), folder, "id")
    return spark.read.parquet(folder).select(
        "id", "territory_id", "state_code", F.col("date").cast("string").alias("date"), "file_checksum"
    )


@query("to_response_json", """SELECT id,
  '{"state_code":"' || state_code || '"'
    || CASE WHEN edition_number IS NOT NULL THEN ',"edition_number":"' || edition_number || '"' ELSE '' END
    || CASE WHEN is_extra_edition IS NOT NULL THEN ',"is_extra_edition":' || is_extra_edition ELSE '' END
    || '}' AS json,
  '{"state_code":"' || state_code || '","edition_number":'
    || coalesce('"' || edition_number || '"', 'null') || ',"is_extra_edition":'
    || coalesce(CAST(is_extra_edition AS VARCHAR), 'null') || '}' AS json_full
  FROM gazettes""", t.GAZETTES)
def to_response_json(spark, sf):
    rows = t.gazettes(spark, sf).select("id", "state_code", "edition_number", "is_extra_edition")
    fields = rows.columns[1:]
    return writers.to_response_json(rows.withColumn("json_full", writers.json_text(fields, nulls=True)), ("id", "json_full"))


# ---- filters


@query("filter_terms", "SELECT id, territory_id FROM gazettes WHERE territory_id IN ('src1', 'src3')",
       t.GAZETTES)
def filter_terms(spark, sf):
    rows = filters.where(t.gazettes(spark, sf), filters.terms("territory_id", ["src1", "src3"]),
                         filters.terms("state_code", []))
    return rows.select("id", "territory_id")


@query("filter_terms_table", """SELECT id, territory_id FROM gazettes
  WHERE territory_id IN (SELECT id FROM territories)""", t.GAZETTES, t.TERRITORIES)
def filter_terms_table(spark, sf):
    narrow = t.gazettes(spark, sf).select("id", "territory_id")
    return filters.terms_from(narrow, "territory_id", t.territories(spark, sf), "id", ["id"])


@query("filter_array_any", """SELECT excerpt_id FROM excerpts
  WHERE list_has_any(excerpt_entities, ['e1', 'e5']) AND list_has_any(excerpt_subthemes, ['src1', 'q1'])""",
       t.EXCERPTS)
def filter_array_any(spark, sf):
    return filters.where(
        t.excerpts(spark, sf), filters.array_any("excerpt_entities", ["e1", "e5"]),
        filters.array_any("excerpt_subthemes", ["src1", "q1"]),
    ).select("excerpt_id")


@query("filter_date_range", """SELECT id, CAST(date AS VARCHAR) AS date FROM gazettes
  WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-02-20'""", t.GAZETTES)
def filter_date_range(spark, sf):
    span = filters.date_range("date", date(2024, 1, 10), date(2024, 2, 20))
    rows = filters.where(t.gazettes(spark, sf), span, filters.date_range("date"))
    return rows.select("id", F.col("date").cast("string").alias("date"))


@query("filter_scraped_range", """SELECT id FROM gazettes
  WHERE scraped_at >= TIMESTAMP '2024-01-01 01:00:00' AND scraped_at < TIMESTAMP '2024-01-01 11:00:01'""",
       t.GAZETTES)
def filter_scraped_range(spark, sf):
    span = filters.datetime_range("scraped_at", datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 11))
    return filters.where(t.gazettes(spark, sf), span).select("id")


@query("bool_compose", """SELECT id, 2.0 + CASE WHEN id % 2 = 0 THEN 0.5 ELSE 0 END
    + CASE WHEN is_extra_edition THEN 1.5 ELSE 0 END AS score
  FROM gazettes WHERE territory_id IN ('src1', 'src2', 'src3') AND state_code = 'en'
    AND NOT (coalesce(edition_number = '21', false))""", t.GAZETTES)
def bool_compose(spark, sf):
    return filters.bool_compose(
        t.gazettes(spark, sf),
        must=[(filters.terms("territory_id", ["src1", "src2", "src3"]), F.lit(2.0))],
        filter=[F.col("state_code") == "en"],
        should=[(F.col("power") == "executive", F.lit(0.5)), (F.col("is_extra_edition"), F.lit(1.5))],
        must_not=[F.col("edition_number") == "21"],
    ).select("id", "score")


@query("bool_should_alone", """SELECT id, CASE WHEN state_code = 'de' THEN 1.0 ELSE 0 END
    + CASE WHEN coalesce(is_extra_edition, false) THEN 2.0 ELSE 0 END AS score
  FROM gazettes WHERE state_code = 'de' OR coalesce(is_extra_edition, false)""", t.GAZETTES)
def bool_should_alone(spark, sf):
    return filters.bool_compose(
        t.gazettes(spark, sf),
        should=[(F.col("state_code") == "de", F.lit(1.0)), (F.col("is_extra_edition"), F.lit(2.0))],
    ).select("id", "score")


@query("match_none", "SELECT doc_id AS id FROM documents WHERE false")
def match_none(spark, sf):
    return filters.match_none(t.gazettes(spark, sf)).select("id")


@query("match_all", "SELECT excerpt_id, 1.0 AS score FROM excerpts WHERE theme = 'en'", t.EXCERPTS)
def match_all(spark, sf):
    rows = t.excerpts(spark, sf).where("theme = 'en'")
    return filters.match_all(rows).select("excerpt_id", "score")


@query("city_name_contains", f"SELECT {CITY_OUT} FROM cities WHERE contains(lower(city_name), 'são s')",
       t.CITIES)
def city_name_contains(spark, sf):
    return city_out(cities.find_cities(t.cities(spark, sf), "SÃO S"))


@query("city_level_in", f"SELECT {CITY_OUT} FROM cities WHERE openness_level IN ('', '1')", t.CITIES)
def city_level_in(spark, sf):
    return city_out(cities.find_cities(t.cities(spark, sf), levels=["", "1"]))


@query("file_catalogue_filter", "SELECT id FROM files WHERE state_code = 'F' AND territory_id IS NULL",
       t.FILES)
def file_catalogue_filter(spark, sf):
    return files.file_catalogue_filter(t.files(spark, sf), "f").select("id")


FILE_REQUESTS = """asked_files AS (SELECT c_custkey AS request_id,
  CASE c_custkey % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'o' ELSE 'p' END AS state_code,
  CASE WHEN c_custkey % 4 <> 0 THEN 'T' || (c_custkey % 50) END AS territory_id FROM customer)"""


def file_requests(spark, sf):
    return t.table(spark, sf, "customer").selectExpr(
        "c_custkey AS request_id",
        "CASE c_custkey % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'o' ELSE 'p' END AS state_code",
        "CASE WHEN c_custkey % 4 <> 0 THEN concat('T', c_custkey % 50) END AS territory_id",
    )


@query("file_catalogue_batch", """SELECT r.request_id, f.id, f.year FROM files f JOIN asked_files r
  ON f.state_code = upper(r.state_code) AND f.territory_id IS NOT DISTINCT FROM r.territory_id""",
       t.FILES, FILE_REQUESTS)
def file_catalogue_batch(spark, sf):
    found = files.file_catalogue_batch(t.files(spark, sf), file_requests(spark, sf))
    return found.select("request_id", "id", "year")


@query("interval_overlap", """SELECT spider_name, CAST(date_from AS VARCHAR) AS date_from FROM spiders
  WHERE enabled AND (date_to IS NULL OR date_to >= DATE '2000-01-01') AND date_from <= DATE '2001-12-31'""",
       t.SPIDERS)
def interval_overlap(spark, sf):
    rows = spiders.interval_overlap(t.spiders(spark, sf), date(2000, 1, 1), date(2001, 12, 31))
    return rows.select("spider_name", F.col("date_from").cast("string").alias("date_from"))


WINDOWS = """windows AS (SELECT c_custkey AS window_id,
  CASE WHEN c_custkey % 17 <> 0 THEN DATE '1994-01-01' + CAST(c_custkey % 4000 AS INT) END AS w_start,
  CASE WHEN c_custkey % 19 <> 0 THEN DATE '1994-01-01' + CAST(c_custkey % 4000 + c_custkey % 90 AS INT) END AS w_end
  FROM customer)"""


@query("overlap_windows", """SELECT window_id, spider_name FROM spiders, windows
  WHERE enabled AND (w_start IS NULL OR date_to IS NULL OR date_to >= w_start)
    AND (w_end IS NULL OR date_from <= w_end)""", t.SPIDERS, WINDOWS)
def overlap_windows(spark, sf):
    windows = t.table(spark, sf, "customer").selectExpr(
        "c_custkey AS window_id",
        "CASE WHEN c_custkey % 17 <> 0 THEN date_add(date'1994-01-01', CAST(c_custkey % 4000 AS int)) END AS start",
        "CASE WHEN c_custkey % 19 <> 0 THEN date_add(date'1994-01-01',"
        " CAST(c_custkey % 4000 + c_custkey % 90 AS int)) END AS end",
    )
    return spiders.overlap_windows(t.spiders(spark, sf), windows).select("window_id", "spider_name")


@query("job_stats_filter", """SELECT id, job_id FROM job_stats
  WHERE spider_name = 'click' AND created_at >= TIMESTAMP '2024-01-03 00:00:00'""", t.JOB_STATS)
def job_stats_filter(spark, sf):
    rows = jobstats.job_stats_filter(t.job_stats(spark, sf), "click", datetime(2024, 1, 3))
    return rows.select("id", "job_id")


@query("validate_ingest_rows", "SELECT arrival, errors FROM checked", t.INGEST_ROWS)
def validate_ingest_rows(spark, sf):
    from recordsearch.operators.ingest import validate_ingest_rows as validate

    rows = validate(t.ingest_rows(spark, sf))
    return rows.select("arrival", F.array_join("errors", ",").alias("errors"))


STATS_ROWS = """stats_rows AS (SELECT event_id AS arrival,
  CASE WHEN event_id % 13 <> 0 THEN event_type END AS spider_name,
  CASE event_id % 7 WHEN 0 THEN '[1, 2]' WHEN 1 THEN 'oops{' WHEN 2 THEN NULL ELSE props END AS stats,
  event_id % 7 > 2 AS good FROM events)"""


def stats_rows(spark, sf, events=None):
    events = t.table(spark, sf, "events") if events is None else events
    return events.selectExpr(
        "event_id AS arrival",
        "CASE WHEN event_id % 13 <> 0 THEN event_type END AS spider_name",
        "CAST(user_id AS string) AS job_id",
        "CASE event_id % 7 WHEN 0 THEN '[1, 2]' WHEN 1 THEN 'oops{' WHEN 2 THEN NULL ELSE props END AS stats",
    )


@query("validate_stats_rows", """SELECT arrival, concat_ws(',',
    CASE WHEN spider_name IS NULL THEN 'spider_name' END, CASE WHEN NOT good THEN 'stats' END) AS errors
  FROM stats_rows""", STATS_ROWS)
def validate_stats_rows(spark, sf):
    rows = jobstats.validate_stats_rows(stats_rows(spark, sf))
    return rows.select("arrival", F.array_join("errors", ",").alias("errors"))


@query("enum_check", """SELECT seq, openness_level IN ('0', '1', '2', '3') AS accepted FROM cities""", t.CITIES)
def enum_check(spark, sf):
    good, bad = filters.enum_check(t.cities(spark, sf), "openness_level")
    return good.select("seq", F.lit(True).alias("accepted")).unionByName(
        bad.select("seq", F.lit(False).alias("accepted")))


# ---- projections

NEW_URL = """CASE WHEN {0} LIKE 'https://old-cdn.example.net/%' THEN
      'https://files.example.org/' || substr({0}, length('https://old-cdn.example.net/') + 1)
    WHEN {0} LIKE 's3://legacy-bucket/%' THEN
      'https://files.example.org/' || substr({0}, length('s3://legacy-bucket/') + 1)
    WHEN {0} LIKE 'http%' THEN {0}
    ELSE 'https://files.example.org/' || ltrim({0}, '/') END"""


@query("gazette_result", f"""SELECT file_checksum, territory_id, CAST(date AS VARCHAR) AS date,
    {NEW_URL.format('url')} AS url, territory_name, state_code, '' AS excerpts,
    edition_number AS edition, is_extra_edition, CASE WHEN file_raw_txt <> '' THEN
    'https://files.example.org/' || file_raw_txt END AS txt_url,
    strftime(scraped_at, '%Y-%m-%d %H:%M:%S') AS scraped_at FROM gazettes""", t.GAZETTES)
def gazette_result(spark, sf):
    rows = results.gazette_result(t.gazettes(spark, sf), t.STORE)
    return rows.withColumns({
        "date": F.col("date").cast("string"), "excerpts": F.array_join("excerpts", "|"),
        "scraped_at": F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss"),
    })


@query("excerpt_result", """SELECT excerpt_id, theme, source_territory_id AS territory_id,
    CAST(source_date AS VARCHAR) AS date, 'https://files.example.org/' || source_url AS url,
    array_to_string(excerpt_subthemes, '|') AS subthemes,
    coalesce(array_to_string(excerpt_entities, '|'), '') AS entities, length(excerpt) AS n_chars,
    source_edition_number AS edition,
    'https://files.example.org/' || source_file_raw_txt AS txt_url FROM excerpts""", t.EXCERPTS)
def excerpt_result(spark, sf):
    rows = results.excerpt_result(t.excerpts(spark, sf), t.STORE)
    return rows.select(
        "excerpt_id", "theme", "territory_id", F.col("date").cast("string").alias("date"), "url",
        F.array_join("subthemes", "|").alias("subthemes"), F.array_join("entities", "|").alias("entities"),
        F.length("excerpt").cast("long").alias("n_chars"), "edition", "txt_url",
    )


@query("file_catalogue_record", """SELECT territory_id, state_code, 'store' || file_path AS file_path,
  year, CASE WHEN hash_info <> 'None' THEN hash_info END AS hash_info, file_size_mb, last_updated
  FROM files""", t.FILES)
def file_catalogue_record(spark, sf):
    return results.file_catalogue_record(t.files(spark, sf), "store")


@query("spider_record", """SELECT spider_name, CAST(date_from AS VARCHAR) AS date_from,
  CAST(date_to AS VARCHAR) AS date_to FROM spiders""", t.SPIDERS)
def spider_record(spark, sf):
    rows = spiders.spider_record(t.spiders(spark, sf))
    return rows.select("spider_name", *[F.col(c).cast("string").alias(c) for c in ("date_from", "date_to")])


@query("job_stats_record", """SELECT id, spider_name, job_id, stats,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM job_stats""", t.JOB_STATS)
def job_stats_record(spark, sf):
    return jobstats.job_stats_record(t.job_stats(spark, sf)).withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query("city_record", f"SELECT {CITY_OUT} FROM cities", t.CITIES)
def city_record(spark, sf):
    return city_out(cities.city_record(t.cities(spark, sf)))


# ---- order and pages


@query("sort_by_date", """SELECT id, CAST(row_number() OVER (ORDER BY date DESC, territory_id, file_checksum, id)
  AS BIGINT) AS place FROM gazettes QUALIFY place <= 200""", t.GAZETTES)
def sort_by_date(spark, sf):
    order = page.sort_columns("descending_date", ties=("territory_id", "file_checksum", "id"))
    rows = t.gazettes(spark, sf).select("id", "date", "territory_id", "file_checksum")
    return _numbered(page.paginate(rows, order, 0, 200), order)


def _numbered(top, order):
    """Place within the page (as many rows as the page has)."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(*order)).cast("long")
    return top.withColumn("place", place).select("id", "place")


@query("paginate", """SELECT id, CAST(row_number() OVER (ORDER BY date, territory_id, id) - 20 AS BIGINT) AS place
  FROM gazettes QUALIFY place BETWEEN 1 AND 15""", t.GAZETTES)
def paginate(spark, sf):
    order = page.sort_columns("ascending_date", ties=("territory_id", "id"))
    rows = t.gazettes(spark, sf).select("id", "date", "territory_id")
    return _numbered(page.paginate(rows, order, 20, 15), order)


@query("order_year_desc", """SELECT id, y AS year, row_number() OVER (ORDER BY y DESC NULLS FIRST, id) AS place
  FROM (SELECT id, CASE WHEN CAST(file_size_mb AS INT) % 3 <> 0 THEN year END AS y FROM files WHERE territory_id IS NULL)""",
       t.FILES)
def order_year_desc(spark, sf):
    year = F.expr("CASE WHEN CAST(file_size_mb AS int) % 3 <> 0 THEN year END")
    rows = t.files(spark, sf).where("territory_id IS NULL").withColumn("year", year)
    order = files.year_order(("id",))
    return page.placed(rows.select("id", "year"), order, writers.shared_folder(spark))


@query("find_files", """SELECT state_code, year, 'store' || file_path AS file_path,
  row_number() OVER (ORDER BY year DESC NULLS FIRST) AS place FROM files
  WHERE state_code = 'O' AND territory_id = 'T7'""", t.FILES)
def find_files(spark, sf):
    rows = files.find_files(t.files(spark, sf), "o", "T7", "store").select("state_code", "year", "file_path")
    return page.placed(rows, files.year_order(), writers.shared_folder(spark))


@query("order_spider_name", """SELECT spider_name, row_number() OVER (ORDER BY spider_name) AS place
  FROM spiders WHERE enabled""", t.SPIDERS)
def order_spider_name(spark, sf):
    live = spiders.interval_overlap(t.spiders(spark, sf))
    return page.placed(live.select("spider_name"), [F.col("spider_name")], writers.shared_folder(spark))


@query("page_deep", """SELECT id, CAST(row_number() OVER (ORDER BY date, territory_id, id) AS BIGINT) AS place
  FROM gazettes QUALIFY place BETWEEN 401 AND 460""", t.GAZETTES)
def page_deep(spark, sf):
    order = page.sort_columns("ascending_date", ties=("territory_id", "id"))
    rows = page.placed(t.gazettes(spark, sf).select("id", "date", "territory_id"), order, writers.shared_folder(spark))
    return page.page_of(rows, 400, 60).select("id", "place")


@query("page_after", """SELECT id, CAST(date AS VARCHAR) AS date FROM gazettes
  WHERE date > DATE '2024-02-03' OR (date = DATE '2024-02-03' AND (territory_id > 'src3' OR (territory_id = 'src3' AND id > 33)))
  ORDER BY gazettes.date, territory_id, id LIMIT 25""", t.GAZETTES)
def page_after(spark, sf):
    rows = t.gazettes(spark, sf).select("id", "date", "territory_id")
    last = {"date": date(2024, 2, 3), "territory_id": "src3", "id": 33}
    out = page.continue_after(rows, [("date", True), ("territory_id", True), ("id", True)], last, 25)
    return out.select("id", F.col("date").cast("string").alias("date"))


@query("latest_job_stats", """SELECT id, job_id FROM job_stats WHERE spider_name = 'view'
  ORDER BY created_at DESC, id DESC LIMIT 100""", t.JOB_STATS)
def latest_job_stats(spark, sf):
    rows = jobstats.job_stats_filter(t.job_stats(spark, sf), "view")
    return jobstats.latest_job_stats(rows).select("id", "job_id")


@query("page_counts", """SELECT least(count(*), 500) AS total_stats FROM job_stats
  WHERE spider_name = 'error'""", t.JOB_STATS)
def page_counts(spark, sf):
    rows = jobstats.job_stats_filter(t.job_stats(spark, sf), "error")
    return page.page_counts(jobstats.latest_job_stats(rows, 500), "total_stats")


# ---- catalogue


@query("themes_list", "SELECT seq, name AS theme FROM themes", t.THEMES)
def themes_list(spark, sf):
    return catalogue.themes_list(t.themes(spark, sf))


@query("subthemes_by_theme", "SELECT name AS theme, p_brand || '|' || p_type AS subthemes FROM themes", t.THEMES)
def subthemes_by_theme(spark, sf):
    return catalogue.subthemes_by_theme(t.themes(spark, sf)).select(
        "theme", F.array_join("subthemes", "|").alias("subthemes"))


@query("entities_by_category", """SELECT name AS theme,
    p_brand || ':' || 'b ' || p_size || ':' || string_split(p_name, ' ')[1] || '+' || string_split(p_name, ' ')[2]
    || '|' || p_type || ':type:' || p_name || '|EMPTY::' AS entities FROM themes""", t.THEMES)
def entities_by_category(spark, sf):
    nested = catalogue.entities_by_category(t.themes(spark, sf))
    return nested.select("theme", F.array_join(F.transform("entities", lambda e: F.concat(
        e["entity_type"], F.lit(":"), F.coalesce(e["entity_type_description"], F.lit("")), F.lit(":"),
        F.array_join(e["entities"], "+"))), "|").alias("entities"))


@query("entity_rows", """SELECT s.c_mktsegment AS entity_type, c.c_name AS entity
  FROM (SELECT DISTINCT c_mktsegment FROM customer UNION ALL SELECT 'NONE') s
  LEFT JOIN customer c ON s.c_mktsegment = c.c_mktsegment""")
def entity_rows(spark, sf):
    customer = t.table(spark, sf, "customer")
    names = customer.select(F.col("c_mktsegment").alias("name")).distinct()
    names = names.unionByName(spark.range(1).select(F.lit("NONE").alias("name")))
    cases = customer.select(
        F.col("c_name").alias("title"), F.col("c_mktsegment").alias("category"))
    rows = catalogue.entity_rows(names.withColumn("description", F.lit("segment")), cases)
    return rows.select("entity_type", "entity")


@query("theme_route", """SELECT excerpt_id, theme FROM excerpts WHERE theme = 'fr'""", t.EXCERPTS)
def theme_route(spark, sf):
    return catalogue.theme_route(t.excerpts(spark, sf), t.themes(spark, sf), "fr").select(
        "excerpt_id", "theme")


@query("route_excerpts", """SELECT request_id, theme, count(*) AS n FROM (SELECT n_nationkey AS request_id,
    CASE n_nationkey % 4 WHEN 0 THEN 'es' WHEN 1 THEN 'fr' WHEN 2 THEN 'xx' END AS theme FROM nation)
  JOIN excerpts USING (theme) GROUP BY ALL""", t.EXCERPTS)
def route_excerpts(spark, sf):
    folder = writers.shared_folder(spark)
    catalogue.write_excerpts(t.excerpts(spark, sf).select("excerpt_id", "theme", "source_date"), folder)
    asked = t.table(spark, sf, "nation").selectExpr(
        "n_nationkey AS request_id", "CASE n_nationkey % 4 WHEN 0 THEN 'es' WHEN 1 THEN 'fr' WHEN 2 THEN 'xx' END AS theme")
    out = catalogue.route_excerpts(asked, t.excerpt_themes(spark, sf), spark.read.parquet(folder), "request_id")
    return out.groupBy("request_id", "theme").agg(F.count("*").alias("n"))


@query("route_all", """SELECT o_orderkey AS request_id, 'theme ' || (o_custkey * 2) AS theme, f.index AS "index",
    CASE WHEN f.index IS NULL THEN 'not_found' ELSE 'found' END AS status
  FROM orders LEFT JOIN (SELECT name, arg_min("index", seq) AS index FROM themes GROUP BY name) f
    ON f.name = 'theme ' || (o_custkey * 2)""", t.THEMES)
def route_all(spark, sf):
    asked = t.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS request_id", "concat('theme ', o_custkey * 2) AS theme")
    return catalogue.route_all(asked, t.themes(spark, sf), "request_id")


# ---- scalar functions


@query("build_file_url", f"""SELECT id, {NEW_URL.format('url')} AS new_url,
    CASE id % 4 WHEN 0 THEN 'prefixed' WHEN 3 THEN 'left' ELSE 'migrated' END AS url_outcome
  FROM gazettes""", t.GAZETTES)
def build_file_url(spark, sf):
    rows = urls.rewrite_file_urls(t.gazettes(spark, sf).select("id", "url"), "url", t.STORE)
    return rows.drop("url")


@query("rewrite_page_urls", """SELECT page_id, CASE WHEN contains(url, '.example.net') AND
      regexp_full_match(url, 'https?://[^/]+/.+')
      AND NOT starts_with(regexp_replace(url, '^[^:]*://', ''), 'blog.')
    THEN 'http://blog./' || regexp_extract(url, '^https?://[^/]+/(.+)$', 1) ELSE url END AS new_url FROM pages""")
def rewrite_page_urls(spark, sf):
    store = urls.FileStore("http://blog./", True, (".example.net",))
    rows = t.table(spark, sf, "pages").select("page_id", "url")
    return urls.rewrite_file_urls(rows, "url", store).select("page_id", "new_url")


@query("url_outcome_counts", """SELECT CASE id % 4 WHEN 0 THEN 'prefixed' WHEN 3 THEN 'left'
  ELSE 'migrated' END AS url_outcome, count(*) AS n FROM gazettes GROUP BY 1""", t.GAZETTES)
def url_outcome_counts(spark, sf):
    rows = urls.rewrite_file_urls(t.gazettes(spark, sf).select("id", "url"), "url", t.STORE)
    return urls.outcome_counts(rows)


@query("url_protocol", """SELECT page_id, nullif(regexp_extract(url, '^(https?|s3)://', 1), '') AS protocol
  FROM pages""")
def url_protocol(spark, sf):
    return t.table(spark, sf, "pages").select("page_id", urls.url_protocol(F.col("url")).alias("protocol"))


@query("fold_curly_quotes", """SELECT doc_id, md5(replace(text, 'a', '"') || '"' || '''') AS digest
  FROM documents""")
def fold_curly_quotes(spark, sf):
    curly = F.concat(F.translate("text", "a", "”"), F.lit("“’"))
    docs = t.documents(spark, sf)
    return docs.select("doc_id", F.md5(text.fold_quotes(curly)).alias("digest"))


@query("clean_tax_ids", """SELECT request_id, d AS digits, ok AS is_valid, cnpj AS masked,
  d[1:8] AS base, d[9:12] AS branch, d[13:] AS "check",
  CASE WHEN ok THEN 'valid' ELSE 'wrong_check_digits' END AS outcome FROM requests""", t.REQUESTS)
def clean_tax_ids(spark, sf):
    return taxid.clean_tax_ids(t.requests(spark, sf), "cnpj").drop("cnpj")


SHORT_IDS = """short_ids AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN CAST(c_custkey AS VARCHAR)
  WHEN 1 THEN 'x' || c_custkey || '-' WHEN 2 THEN 'none' WHEN 3 THEN '1234567890123' || c_custkey
  ELSE '' END AS raw FROM customer),
digit_ids AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS ds FROM short_ids)"""


@query("cnpj_digits", """SELECT c_custkey, CASE WHEN ds = '' THEN '' WHEN length(ds) < 14
    THEN lpad(ds, 14, '0') ELSE ds END AS digits, CASE WHEN ds = '' THEN 'empty'
    WHEN length(ds) > 14 THEN 'too_long' END AS fault
  FROM digit_ids""", SHORT_IDS)
def cnpj_digits(spark, sf):
    raw = t.table(spark, sf, "customer").selectExpr(
        "c_custkey", """CASE c_custkey % 5 WHEN 0 THEN CAST(c_custkey AS string)
          WHEN 1 THEN concat('x', c_custkey, '-') WHEN 2 THEN 'none'
          WHEN 3 THEN concat('1234567890123', c_custkey) ELSE '' END AS raw""")
    rows = taxid.clean_tax_ids(raw, "raw")
    fault = F.when(F.col("outcome").isin("empty", "too_long"), F.col("outcome"))
    return rows.select("c_custkey", "digits", fault.alias("fault"))


@query("cnpj_check_digits", """SELECT request_id, CASE WHEN ok THEN d[13:14] = dd ELSE d[13:14] <> dd END AS agrees
  FROM (SELECT *, """ + t.check_digits_sql("d[1:12]") + """ AS dd FROM requests)""", t.REQUESTS)
def cnpj_check_digits(spark, sf):
    ids = t.requests(spark, sf).withColumn("d", taxid.only_digits(F.col("cnpj")))
    same = F.substring("d", 13, 2) == taxid.check_digits(F.substring("d", 1, 12))
    return ids.select("request_id", (same == taxid.is_valid(F.col("d"))).alias("agrees"))


@query("cnpj_is_valid", "SELECT request_id, ok AS is_valid FROM requests", t.REQUESTS)
def cnpj_is_valid(spark, sf):
    return t.requests(spark, sf).select("request_id", taxid.is_valid(F.col("cnpj")).alias("is_valid"))


@query("cnpj_format", "SELECT request_id, cnpj AS masked FROM requests", t.REQUESTS)
def cnpj_format(spark, sf):
    digits = taxid.only_digits(F.col("cnpj"))
    return t.requests(spark, sf).select("request_id", taxid.masked(digits).alias("masked"))


@query("cnpj_split", """SELECT request_id, d[1:8] AS base, d[9:12] AS branch, d[13:] AS "check"
  FROM requests""", t.REQUESTS)
def cnpj_split(spark, sf):
    return t.requests(spark, sf).select("request_id", taxid.parts(F.col("cnpj")).alias("p")).select(
        "request_id", "p.*")


@query("cnpj_join", """SELECT l_orderkey, l_linenumber, l_partkey,
    lpad(CAST(l_partkey AS VARCHAR), 8, '0') || lpad(CAST(l_suppkey AS VARCHAR), 4, '0')
    || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS joined FROM lineitem""")
def cnpj_join(spark, sf):
    rows = t.table(spark, sf, "lineitem")
    joined = taxid.joined(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", joined.alias("joined"))


@query("text_or_null", """SELECT b_key, CASE WHEN bairro NOT IN ('', 'None') THEN bairro END AS bairro,
  CASE WHEN pais NOT IN ('', 'None') THEN pais END AS pais, municipio,
  CASE WHEN cep NOT IN ('', 'None') THEN cep END AS cep FROM companies""", t.COMPANIES)
def text_or_null(spark, sf):
    rows = text.normalize_text_columns(
        t.companies(spark, sf), blank_to_null=("bairro", "pais", "municipio", "cep"))
    return rows.select(F.col("estabelecimento_cnpj_basico").alias("b_key"),
                       "bairro", "pais", "municipio", "cep")


@query("split_urls", """SELECT seq, CASE WHEN gazettes_urls <> '' THEN
  len(string_split(gazettes_urls, ',')) END AS n FROM cities""", t.CITIES)
def split_urls(spark, sf):
    split = text.split_list(F.concat(F.lit(" "), "gazettes_urls", F.lit(" \n")))
    rows = t.cities(spark, sf).select("seq", split.alias("u"))
    return rows.select("seq", F.when(F.col("u").isNotNull(), F.size("u")).cast("long").alias("n"))


@query("parse_date", """SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN
    CAST(DATE '2024-01-01' + CAST(doc_id % 366 AS INT) AS VARCHAR) END AS date,
  CASE WHEN doc_id % 3 <> 0 THEN '2024-05-06 07:08:09' END AS at FROM documents""")
def parse_date(spark, sf):
    raw = t.documents(spark, sf).selectExpr(
        "doc_id", """CASE WHEN doc_id % 20 = 0 THEN '2024-02-30' WHEN doc_id % 10 = 0 THEN 'x'
          ELSE CAST(date_add(date'2024-01-01', CAST(doc_id % 366 AS int)) AS string) END AS d""",
        "CASE WHEN doc_id % 3 = 0 THEN '2024-13-01T00:00:00' ELSE '2024-05-06T07:08:09' END AS s")
    at = dates.parse_iso_datetime(F.col("s"))
    return raw.select("doc_id", dates.parse_date(F.col("d")).cast("string").alias("date"),
                      F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("upper_state", "SELECT doc_id, upper(lang) AS lang FROM documents")
def upper_state(spark, sf):
    docs = t.documents(spark, sf).select("doc_id", "lang")
    return text.normalize_text_columns(docs, upper=("lang",))


@query("json_payload", """SELECT event_id, CAST(props->>'k' AS BIGINT) AS k,
  replace(props, ' ', '') AS json FROM events""")
def json_payload(spark, sf):
    rows = t.table(spark, sf, "events").select("event_id", F.parse_json("props").alias("v"))
    return rows.select("event_id", F.variant_get("v", "$.k", "bigint").alias("k"),
                       F.to_json("v").alias("json"))


@query("keyword_subfield", """SELECT doc_id, CASE WHEN length(text) <= 256 THEN text END AS word
  FROM documents""")
def keyword_subfield(spark, sf):
    return t.documents(spark, sf).select("doc_id", text.keyword(F.col("text")).alias("word"))
