"""Queries: joins, aggregations, table changes and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordsearch.operators import cities, companies, ingest, jobstats, rank, results, spiders
from recordsearch.sources import writers
from recordsearch.streaming import jobs
from testbed import tables as t
from testbed.registry import query
from testbed.rows import STATS_ROWS, stats_rows

# ---- tax ids against companies and partners

FIRST_COMPANY = "firsts AS (SELECT * FROM companies QUALIFY row_number() OVER (" + (
    "PARTITION BY b_key, o_key, d_key ORDER BY " + ", ".join(f"{c} NULLS FIRST" for c in t.COMPANY_ATTRIBUTES)) + ") = 1)"


@query("enrich_companies", """SELECT r.request_id, r.cnpj, CASE WHEN NOT ok THEN 'invalid'
    WHEN f.b_key IS NULL THEN 'not_found' ELSE 'found' END AS status,
  CASE WHEN ok THEN nome_fantasia END AS nome_fantasia, CASE WHEN ok THEN uf END AS uf,
  CASE WHEN ok THEN capital_social END AS capital_social, CASE WHEN ok THEN municipio END AS municipio,
  CASE WHEN ok AND f.b_key IS NOT NULL THEN cnpj END AS cnpj_completo
  FROM requests r LEFT JOIN firsts f ON f.b_key = d[1:8] AND o_key = d[9:12] AND d_key = d[13:14]""",
       t.COMPANIES, t.REQUESTS, FIRST_COMPANY)
def enrich_companies(spark, sf):
    out = companies.enrich_companies(t.requests(spark, sf), t.companies(spark, sf), "cnpj", "request_id")
    return out.select("request_id", "cnpj", "status", "nome_fantasia", "uf", "capital_social",
                      "municipio", "cnpj_completo")


COMPANY_COLUMNS = ", ".join(
    f"CASE WHEN {c} NOT IN ('', 'None') THEN {c} END AS {c}" for c in t.COMPANY_ATTRIBUTES
)


@query("company_record", f"""SELECT r.request_id, d[1:8] AS cnpj_basico, d[9:12] AS cnpj_ordem,
  d[13:14] AS cnpj_dv, cnpj AS cnpj_completo, d AS cnpj_completo_apenas_numeros, {COMPANY_COLUMNS}
  FROM requests r JOIN firsts f ON f.b_key = d[1:8] AND o_key = d[9:12] AND d_key = d[13:14] WHERE ok""",
       t.COMPANIES, t.REQUESTS, FIRST_COMPANY)
def company_record(spark, sf):
    out = companies.enrich_companies(t.requests(spark, sf), t.companies(spark, sf), "cnpj", "request_id")
    return out.where("status = 'found'").drop("status", "cnpj")


PARTNER_COLUMNS = ", ".join(
    f"CASE WHEN {c} NOT IN ('', 'None') THEN {c} END AS {c}" for c in t.PARTNER_ATTRIBUTES
)


@query("enrich_partners", f"""SELECT r.request_id, CASE WHEN NOT ok THEN 'invalid'
    WHEN p.basico IS NULL THEN 'empty' ELSE 'found' END AS status, {PARTNER_COLUMNS}
  FROM requests r LEFT JOIN partners p ON ok AND basico = d[1:8]""", t.REQUESTS, t.PARTNERS)
def enrich_partners(spark, sf):
    out = companies.enrich_partners(t.requests(spark, sf), t.partners(spark, sf), "cnpj", "request_id")
    return out.select("request_id", "status", *t.PARTNER_ATTRIBUTES)


@query("partner_record", f"""SELECT d[1:8] AS cnpj_basico, d[9:12] AS cnpj_ordem, d[13:14] AS cnpj_dv,
  cnpj AS cnpj_completo, d AS cnpj_completo_apenas_numeros, {PARTNER_COLUMNS}
  FROM requests r JOIN partners p ON basico = d[1:8] WHERE ok""", t.REQUESTS, t.PARTNERS)
def partner_record(spark, sf):
    out = companies.enrich_partners(t.requests(spark, sf), t.partners(spark, sf), "cnpj", "request_id")
    return out.where("status = 'found'").drop("status", "cnpj", "request_id")


@query("partner_counts", """SELECT request_id, count(basico) AS total_partners FROM requests r
  LEFT JOIN partners p ON basico = d[1:8] WHERE ok GROUP BY request_id""", t.REQUESTS, t.PARTNERS)
def partner_counts(spark, sf):
    out = companies.partner_counts(t.requests(spark, sf), t.partners(spark, sf), "cnpj", "request_id")
    return out.select("request_id", "total_partners")


# ---- other lookups


@query("lookup_city", """SELECT o_orderkey AS request_id, c.city_name AS territory_name, c.uf AS state_code,
    c.openness_level AS level, c.ibge_id IS NOT NULL AS found
  FROM orders LEFT JOIN (SELECT * FROM cities QUALIFY
      row_number() OVER (PARTITION BY ibge_id ORDER BY seq) = 1) c
    ON c.ibge_id = lpad(CAST(CASE WHEN o_orderkey % 3 = 0 THEN 8 ELSE o_custkey * 2 END AS VARCHAR), 7, '0')""",
       t.CITIES)
def lookup_city(spark, sf):
    asked = t.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS request_id",
        "lpad(CAST(CASE WHEN o_orderkey % 3 = 0 THEN 8 ELSE o_custkey * 2 END AS string), 7, '0') AS city_id")
    out = cities.lookup_city(asked, t.cities(spark, sf), "city_id", "request_id")
    return out.select("request_id", "territory_name", "state_code", "level", "found")


@query("fk_check", """SELECT arrival, territory_id IN (SELECT DISTINCT
  lpad(regexp_extract(source, '[0-9]+'), 7, '0') FROM documents WHERE source <> 'src19') AS known
  FROM raw_rows""", t.INGEST_ROWS)
def fk_check(spark, sf):
    rows = t.ingest_rows(spark, sf).select("arrival", "territory_id")
    known, unknown = ingest.fk_check(rows, t.ingest_territories(spark, sf), "arrival")
    return known.select("arrival", F.lit(True).alias("known")).unionByName(
        unknown.select("arrival", F.lit(False).alias("known")))


# ---- aggregations


@query("feature_pivot", """SELECT exp(avg(ln(excerpt_embedding_score))) AS pivot FROM excerpts""", t.EXCERPTS)
def feature_pivot(spark, sf):
    return rank.feature_pivot(t.excerpts(spark, sf), "excerpt_embedding_score").select(
        F.round("pivot", 9).alias("pivot"))


@query("distinct_results", """SELECT DISTINCT territory_id, state_code, power, file_checksum
  FROM gazettes""", t.GAZETTES)
def distinct_results(spark, sf):
    return results.distinct_results(t.gazettes(spark, sf),
                                    ["territory_id", "state_code", "power", "file_checksum"])


@query("distinct_result_sets", """SELECT DISTINCT theme,
    array_to_string(list_sort(list_distinct(list_concat(excerpt_subthemes, excerpt_subthemes))), '|') AS subthemes,
    array_to_string(list_sort(list_distinct(excerpt_entities)), '|') AS entities FROM excerpts""", t.EXCERPTS)
def distinct_result_sets(spark, sf):
    twice = F.concat("excerpt_subthemes", F.reverse("excerpt_subthemes"))
    rows = t.excerpts(spark, sf).select("theme", twice.alias("subthemes"),
                                        F.col("excerpt_entities").alias("entities"))
    out = results.distinct_results(rows, as_sets=("subthemes", "entities"))
    return out.select("theme", F.array_join("subthemes", "|").alias("subthemes"),
                      F.array_join("entities", "|").alias("entities"))


# ---- table changes


@query("bulk_load_latest", """SELECT id, file_checksum, edition_number FROM gazettes
  QUALIFY row_number() OVER (PARTITION BY file_checksum ORDER BY id % 2 DESC, id DESC) = 1""", t.GAZETTES)
def bulk_load_latest(spark, sf):
    rows = t.gazettes(spark, sf).select("id", "file_checksum", "edition_number")
    current = ingest.bulk_load_latest(None, rows.where("id % 2 = 0"), ["file_checksum"], "id")
    return ingest.bulk_load_latest(current, rows.where("id % 2 = 1"), ["file_checksum"], "id")


INGEST = t.INGEST_ROWS + """,
known AS (SELECT DISTINCT lpad(regexp_extract(source, '[0-9]+'), 7, '0') AS k FROM documents
  WHERE source <> 'src19'),
firsts AS (SELECT territory_id, date, file_checksum, min(arrival) AS arrival FROM checked
  WHERE errors = '' GROUP BY 1, 2, 3)"""

FRESH = """fresh AS (SELECT arrival, CAST(row_number() OVER (ORDER BY arrival) + {0} AS BIGINT) AS id
  FROM firsts f WHERE territory_id IN (SELECT k FROM known) {1})"""

JUDGED = """SELECT c.arrival, f.id AS gazette_id, CASE WHEN errors <> '' THEN 'invalid'
    WHEN territory_id NOT IN (SELECT k FROM known) THEN 'unknown_territory'
    WHEN f.id IS NOT NULL THEN 'created' ELSE 'duplicate' END AS status
  FROM checked c LEFT JOIN fresh f USING (arrival)"""

AGAINST = FRESH.format("(SELECT coalesce(max(id), 0) FROM target)", """AND NOT EXISTS (SELECT 1 FROM target g
    WHERE g.territory_id = f.territory_id AND g.date = f.date AND g.file_checksum = f.file_checksum)""")


def _ingested(spark, sf):
    rows = ingest.validate_ingest_rows(t.ingest_rows(spark, sf))
    return ingest.ingest_gazettes(t.ingest_target(spark, sf), rows, t.ingest_territories(spark, sf),
                                  "arrival", errors="errors")


@query("ingest_gazettes", JUDGED, INGEST, t.INGEST_TARGET, AGAINST)
def ingest_gazettes(spark, sf):
    return _ingested(spark, sf)[1]


@query("ingest_created", """SELECT f.id, c.territory_id, CAST(c.date AS VARCHAR) AS date, c.file_checksum,
  c.edition_number, false AS processed FROM fresh f JOIN checked c USING (arrival)""",
       INGEST, t.INGEST_TARGET, AGAINST)
def ingest_created(spark, sf):
    created, _ = _ingested(spark, sf)
    return created.select("id", "territory_id", F.col("date").cast("string").alias("date"),
                          "file_checksum", "edition_number", "processed")


SYNCED = t.SPIDERS + ",\n" + t.SPIDER_BATCH + """,
news AS (SELECT spider_name, arg_max(date_from, seq) AS new_from FROM batch GROUP BY 1),
synced AS (SELECT coalesce(s.spider_name, n.spider_name) AS spider_name,
  CASE WHEN s.spider_name IS NULL THEN new_from WHEN date_from <> new_from THEN new_from
    ELSE date_from END AS date_from,
  date_to, coalesce(enabled, false) AS enabled,
  CASE WHEN s.spider_name IS NULL THEN 'inserted' WHEN date_from <> new_from THEN 'updated'
    ELSE 'unchanged' END AS action
  FROM spiders s FULL OUTER JOIN news n ON s.spider_name = n.spider_name)"""


def _synced(spark, sf):
    return spiders.sync_spiders(t.spiders(spark, sf), t.spider_batch(spark, sf), "seq")


@query("sync_spiders", """SELECT spider_name, CAST(date_from AS VARCHAR) AS date_from,
  CAST(date_to AS VARCHAR) AS date_to, enabled, action FROM synced""", SYNCED)
def sync_spiders(spark, sf):
    return _synced(spark, sf).withColumns(
        {c: F.col(c).cast("string") for c in ("date_from", "date_to")})


@query("sync_summary", """SELECT action, count(*) AS n FROM synced GROUP BY action
  UNION ALL SELECT 'processed', count(*) FROM batch""", SYNCED)
def sync_summary(spark, sf):
    return spiders.sync_summary(t.spider_batch(spark, sf), _synced(spark, sf))


@query("sync_territory_map", """SELECT spider_name, territory_id FROM batch WHERE seq % 2 = 0
  UNION SELECT spider_name, territory_id FROM batch""", t.SPIDER_BATCH)
def sync_territory_map(spark, sf):
    batch = t.spider_batch(spark, sf)
    stored = batch.where("seq % 2 = 0").select("spider_name", "territory_id").distinct()
    return spiders.sync_territory_map(stored, batch)


@query("append_job_stats", """SELECT event_id AS arrival, event_type AS spider_name,
    CAST(row_number() OVER (ORDER BY event_id) + (SELECT max(event_id) FROM events WHERE event_id % 2 = 0)
      AS BIGINT) AS id
  FROM events WHERE event_id % 2 = 1""")
def append_job_stats(spark, sf):
    stats = t.job_stats(spark, sf)
    news = stats.where("id % 2 = 1").withColumnRenamed("id", "arrival")
    added = jobstats.append_job_stats(stats.where("id % 2 = 0"), news, "arrival")
    return added.select("arrival", "spider_name", "id")


@query("migrate_job_stats", """SELECT event_id AS id, event_type AS spider_name,
    CAST(NULL AS VARCHAR) AS job_id, replace(props, ' ', '') AS stats, epoch_us(ts) AS created_us
  FROM events WHERE event_id % 9 <> 0""")
def migrate_job_stats(spark, sf):
    legacy = t.table(spark, sf, "events").selectExpr(
        "event_id AS id", "CASE WHEN event_id % 9 <> 0 THEN event_type END AS spider",
        "props AS job_stats", "ts AS start_time")
    once, _ = jobstats.migrate_job_stats(legacy)
    again, _ = jobstats.migrate_job_stats(once)
    return again.select("id", "spider_name", "job_id", F.to_json("stats").alias("stats"),
                        F.unix_micros("created_at").alias("created_us"))


@query("migrate_job_stats_violations", """SELECT event_id AS id, replace(props, ' ', '') AS stats
  FROM events WHERE event_id % 9 = 0""")
def migrate_job_stats_violations(spark, sf):
    legacy = t.table(spark, sf, "events").selectExpr(
        "event_id AS id", "CASE WHEN event_id % 9 <> 0 THEN event_type END AS spider",
        "props AS job_stats", "ts AS start_time")
    _, faulty = jobstats.migrate_job_stats(legacy)
    return faulty.where("spider_name IS NULL").select("id", F.to_json("stats").alias("stats"))


# ---- streams


def _stream_of(spark, sf, name):
    """The table as a stream of its files: one file, or a folder of them (only a pattern may name either)."""
    schema = t.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


@query("stream_ingest_gazettes", JUDGED, INGEST, FRESH.format("0", ""))
def stream_ingest_gazettes(spark, sf):
    folder = writers.shared_folder(spark)
    rows = t.ingest_rows_from(_stream_of(spark, sf, "documents"))
    schema = ("id long, territory_id string, date date, scraped_at timestamp_ntz, created_at timestamp_ntz, "
              "edition_number string, file_checksum string, file_path string, file_url string, "
              "processed boolean")
    run = jobs.stream_ingest_gazettes(
        rows, t.ingest_territories(spark, sf), f"{folder}/gazettes", f"{folder}/statuses",
        f"{folder}/checkpoint", schema)
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/statuses").drop("batch")


@query("stream_job_stats", """SELECT arrival, CAST(row_number() OVER (ORDER BY arrival) AS BIGINT) AS id,
  replace(stats, ' ', '') AS stats FROM stats_rows WHERE good AND spider_name IS NOT NULL""", STATS_ROWS)
def stream_job_stats(spark, sf):
    folder = writers.shared_folder(spark)
    schema = "id long, spider_name string, job_id string, stats variant, created_at timestamp, arrival long"
    rows = stats_rows(None, None, _stream_of(spark, sf, "events"))
    jobs.stream_job_stats(rows, f"{folder}/stats", f"{folder}/checkpoint", schema).awaitTermination()
    stored = spark.read.schema(T.StructType.fromDDL(schema)).parquet(f"{folder}/stats")
    return stored.select("arrival", "id", F.to_json("stats").alias("stats"))


@query("stream_job_stats_refusals", """SELECT arrival, concat_ws(',',
    CASE WHEN spider_name IS NULL THEN 'spider_name' END, CASE WHEN NOT good THEN 'stats' END) AS errors
  FROM stats_rows WHERE spider_name IS NULL OR NOT good""", STATS_ROWS)
def stream_job_stats_refusals(spark, sf):
    folder = writers.shared_folder(spark)
    schema = "id long, spider_name string, job_id string, stats variant, created_at timestamp, arrival long"
    rows = stats_rows(None, None, _stream_of(spark, sf, "events"))
    jobs.stream_job_stats(rows, f"{folder}/stats", f"{folder}/checkpoint", schema,
                          refusals=f"{folder}/refusals").awaitTermination()
    refused = spark.read.parquet(f"{folder}/refusals")
    return refused.select("arrival", F.array_join("errors", ",").alias("errors"))
