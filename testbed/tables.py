"""Domain tables derived row by row from the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordsearch.functions import taxid
from recordsearch.functions.urls import FileStore
from recordsearch.plans.index import Index, write_index
from recordsearch.plans.search import Corpus
from recordsearch.schemas import COMPANY_ATTRIBUTES, PARTNER_ATTRIBUTES
from recordsearch.sources.readers import spread
from recordsearch.sources.writers import shared_folder

STORE = FileStore(
    endpoint="https://files.example.org",
    replace_old=True,
    old_markers=("old-cdn.example.net", "older-cdn.example.net", "legacy-bucket"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    tasks = spark.conf.get("spark.recordsearch.tasks", None)  # set by who runs one small file on many cores
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), tasks and int(tasks))


def gazettes(spark, sf_dir):
    return documents(spark, sf_dir).selectExpr(
        "doc_id AS id",
        "source AS territory_id",
        "concat('Town ', source) AS territory_name",
        "lang AS state_code",
        "date_add(date'2024-01-01', CAST(doc_id % 90 AS int)) AS date",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id % 100000 AS int),"
        " CAST(CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE 0 END AS decimal(18, 6))) AS scraped_at",
        "timestamp_ntz'2024-02-01 00:00:00' AS created_at",
        "CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id AS string) END AS edition_number",
        "CASE WHEN doc_id % 7 <> 0 THEN doc_id % 2 = 0 END AS is_extra_edition",
        "CASE WHEN doc_id % 2 = 0 THEN 'executive' ELSE 'legislative' END AS power",
        "md5(text) AS file_checksum",
        "concat(source, '/', doc_id, '.pdf') AS file_path",
        "concat('https://town.example.net/', doc_id) AS file_url",
        """CASE doc_id % 4
             WHEN 0 THEN concat('/', source, '/', doc_id, '.pdf')
             WHEN 1 THEN concat('https://old-cdn.example.net/', source, '/', doc_id, '.pdf')
             WHEN 2 THEN concat('s3://legacy-bucket/', source, '/', doc_id, '.pdf')
             ELSE concat('https://town.example.net/', doc_id) END AS url""",
        """CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 6 = 0 THEN ''
             ELSE concat(source, '/', doc_id, '.txt') END AS file_raw_txt""",
        "text AS source_text",
        "true AS processed",
    )


GAZETTES = """gazettes AS (SELECT doc_id AS id, source AS territory_id,
  'Town ' || source AS territory_name, lang AS state_code,
  DATE '2024-01-01' + CAST(doc_id % 90 AS INT) AS date,
  TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds((doc_id % 100000) * 60000
    + CASE WHEN doc_id % 3 = 0 THEN 500 ELSE 0 END) AS scraped_at,
  TIMESTAMP '2024-02-01 00:00:00' AS created_at,
  CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id AS VARCHAR) END AS edition_number,
  CASE WHEN doc_id % 7 <> 0 THEN doc_id % 2 = 0 END AS is_extra_edition,
  CASE WHEN doc_id % 2 = 0 THEN 'executive' ELSE 'legislative' END AS power,
  md5(text) AS file_checksum,
  source || '/' || doc_id || '.pdf' AS file_path,
  'https://town.example.net/' || doc_id AS file_url,
  CASE doc_id % 4
    WHEN 0 THEN '/' || source || '/' || doc_id || '.pdf'
    WHEN 1 THEN 'https://old-cdn.example.net/' || source || '/' || doc_id || '.pdf'
    WHEN 2 THEN 's3://legacy-bucket/' || source || '/' || doc_id || '.pdf'
    ELSE 'https://town.example.net/' || doc_id END AS url,
  CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 6 = 0 THEN ''
    ELSE source || '/' || doc_id || '.txt' END AS file_raw_txt,
  text AS source_text, true AS processed FROM documents)"""


def territories(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").select(F.col("source").alias("id"))
    return sources.where("id <> 'src19'").distinct()


TERRITORIES = "territories AS (SELECT DISTINCT source AS id FROM documents WHERE source <> 'src19')"


def excerpts(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return documents(spark, sf_dir).join(labels, "doc_id", "left").selectExpr(
        "lang AS theme",
        "concat('x', doc_id) AS excerpt_id",
        "text AS excerpt",
        "array(source, concat('q', coalesce(CAST(quality AS string), 'none'))) AS excerpt_subthemes",
        """CASE WHEN doc_id % 9 <> 0 THEN
             array(concat('e', doc_id % 4), concat('e', doc_id % 6)) END AS excerpt_entities""",
        "CAST(1 AS double) / (1 + doc_id % 10) AS excerpt_tfidf_score",
        "CAST(1 + doc_id % 7 AS double) / 8 AS excerpt_embedding_score",
        "source AS source_territory_id",
        "concat('Town ', source) AS source_territory_name",
        "lang AS source_state_code",
        "date_add(date'2024-01-01', CAST(doc_id % 90 AS int)) AS source_date",
        "timestamp_ntz'2024-01-01 00:00:00' AS source_scraped_at",
        "concat(source, '/', doc_id, '.pdf') AS source_url",
        "CASE WHEN doc_id % 6 <> 0 THEN concat(source, '/', doc_id, '.txt') END AS source_file_raw_txt",
        "CAST(doc_id AS string) AS source_edition_number",
        "doc_id % 2 = 0 AS source_is_extra_edition",
    )


EXCERPTS = """excerpts AS (SELECT lang AS theme, 'x' || doc_id AS excerpt_id, text AS excerpt,
  [source, 'q' || coalesce(CAST(quality AS VARCHAR), 'none')] AS excerpt_subthemes,
  CASE WHEN doc_id % 9 <> 0 THEN ['e' || (doc_id % 4), 'e' || (doc_id % 6)] END AS excerpt_entities,
  CAST(1 AS DOUBLE) / (1 + doc_id % 10) AS excerpt_tfidf_score,
  CAST(1 + doc_id % 7 AS DOUBLE) / 8 AS excerpt_embedding_score,
  source AS source_territory_id, 'Town ' || source AS source_territory_name,
  lang AS source_state_code, DATE '2024-01-01' + CAST(doc_id % 90 AS INT) AS source_date,
  TIMESTAMP '2024-01-01 00:00:00' AS source_scraped_at,
  source || '/' || doc_id || '.pdf' AS source_url,
  CASE WHEN doc_id % 6 <> 0 THEN source || '/' || doc_id || '.txt' END AS source_file_raw_txt,
  CAST(doc_id AS VARCHAR) AS source_edition_number, doc_id % 2 = 0 AS source_is_extra_edition
  FROM documents LEFT JOIN labels USING (doc_id))"""


def excerpt_themes(spark, sf_dir):
    """The catalogue of the excerpts' themes."""
    names = table(spark, sf_dir, "documents").select(F.col("lang").alias("name")).distinct()
    return names.select(F.xxhash64("name").alias("seq"), "name", F.concat(F.lit("index_"), "name").alias("index"))


def themes(spark, sf_dir):
    """One catalogue entry per part; every tenth name comes twice."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS seq",
        "concat('theme ', p_partkey - CASE WHEN p_partkey % 10 = 9 THEN 1 ELSE 0 END) AS name",
        "concat('index_', p_partkey) AS index",
        "array(named_struct('title', p_brand), named_struct('title', p_type)) AS queries",
        """named_struct(
             'categories', array(named_struct('name', p_brand, 'description', concat('b ', p_size)),
                                 named_struct('name', p_type, 'description', 'type'),
                                 named_struct('name', 'EMPTY', 'description', CAST(NULL AS string))),
             'cases', array(named_struct('title', element_at(split(p_name, ' '), 1), 'category', p_brand),
                            named_struct('title', p_name, 'category', p_type),
                            named_struct('title', element_at(split(p_name, ' '), 2), 'category', p_brand),
                            named_struct('title', 'lost', 'category', 'OTHER'))) AS entities""",
    )


THEMES = """themes AS (SELECT p_partkey AS seq,
  'theme ' || (p_partkey - CASE WHEN p_partkey % 10 = 9 THEN 1 ELSE 0 END) AS name,
  'index_' || p_partkey AS index, p_brand, p_type, p_name, p_size FROM part)"""


def cities(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "CASE WHEN p_partkey % 8 = 0 THEN concat('São ', p_name) ELSE initcap(p_name) END AS city_name",
        "lpad(CAST(p_partkey - CASE WHEN p_partkey % 10 = 9 THEN 1 ELSE 0 END AS string), 7, '0') AS ibge_id",
        "p_type AS uf",
        "CASE WHEN p_partkey % 97 = 5 THEN '7' ELSE CAST(p_size % 4 AS string) END AS openness_level",
        "CASE WHEN p_partkey % 6 = 0 THEN '' ELSE replace(p_name, ' ', ',') END AS gazettes_urls",
        "concat('2024-', p_size) AS availability_date",
        "p_partkey AS seq",
    )


CITIES = """cities AS (SELECT
  CASE WHEN p_partkey % 8 = 0 THEN 'São ' || p_name
    ELSE array_to_string(list_transform(string_split(p_name, ' '),
      lambda w: upper(w[1]) || w[2:]), ' ') END AS city_name,
  lpad(CAST(p_partkey - CASE WHEN p_partkey % 10 = 9 THEN 1 ELSE 0 END AS VARCHAR), 7, '0') AS ibge_id,
  p_type AS uf,
  CASE WHEN p_partkey % 97 = 5 THEN '7' ELSE CAST(p_size % 4 AS VARCHAR) END AS openness_level,
  CASE WHEN p_partkey % 6 = 0 THEN '' ELSE replace(p_name, ' ', ',') END AS gazettes_urls,
  '2024-' || p_size AS availability_date, p_partkey AS seq FROM part)"""

_FILLED = {
    "nome_fantasia": ("c_name", "c_name"),
    "uf": ("c_mktsegment", "c_mktsegment"),
    "capital_social": ("CAST(CAST(round(c_acctbal * 100) AS bigint) AS string)",
                       "CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR)"),
    "pais": ("'None'", "'None'"),
    "bairro": ("''", "''"),
    "municipio": ("concat('m', c_nationkey)", "'m' || c_nationkey"),
}

def _attributes(dialect: int) -> list[str]:
    out = []
    for i, name in enumerate(COMPANY_ATTRIBUTES):
        default = f"CASE WHEN (c_custkey + {i}) % 4 = 0 THEN '' ELSE concat('v{i}_', c_custkey) END"
        out.append(f"{_FILLED.get(name, (default, default))[dialect]} AS {name}")
    return out


def companies(spark, sf_dir):
    """One row per customer; every fiftieth has a second row with the same key."""
    customer = table(spark, sf_dir, "customer")
    twice = F.explode(F.when(F.col("c_custkey") % 50 == 0, F.array(F.lit(0), F.lit(1)))
                      .otherwise(F.array(F.lit(0))))
    rows = customer.withColumn("copy", twice).withColumn(
        "c_name", F.concat("c_name", F.when(F.col("copy") == 1, " B").otherwise(""))
    )
    base = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    branch = F.lpad((F.col("c_nationkey") + 1).cast("string"), 4, "0")
    return (
        rows.withColumns({"estabelecimento_cnpj_basico": base, "estabelecimento_cnpj_ordem": branch})
        .withColumn("estabelecimento_cnpj_dv", taxid.check_digits(
            F.concat("estabelecimento_cnpj_basico", "estabelecimento_cnpj_ordem")))
        .selectExpr("estabelecimento_cnpj_basico", "estabelecimento_cnpj_ordem",
                    "estabelecimento_cnpj_dv", *_attributes(0))
    )


def check_digits_sql(twelve: str) -> str:
    """Both check digits of a 12-digit SQL text."""
    def one(expr, weights):
        total = " + ".join(
            f"CAST(substr({expr}, {i}, 1) AS INT) * {w}" for i, w in enumerate(weights, 1)
        )
        rest = f"(({total}) % 11)"
        return f"(CASE WHEN {rest} < 2 THEN '0' ELSE CAST(11 - {rest} AS VARCHAR) END)"

    first = one(twelve, taxid.CHECK_WEIGHTS[1:])
    return f"({first} || {one(f'({twelve} || {first})', taxid.CHECK_WEIGHTS)})"


COMPANIES = f"""company_base AS (SELECT *, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS base,
    lpad(CAST(c_nationkey + 1 AS VARCHAR), 4, '0') AS branch FROM customer),
company_keys AS (SELECT *, {check_digits_sql('(base || branch)')} AS dv FROM company_base),
companies AS (
  SELECT base AS b_key, branch AS o_key, dv AS d_key, {', '.join(_attributes(1))} FROM company_keys
  UNION ALL
  SELECT base, branch, dv, {', '.join(_attributes(1))} FROM
    (SELECT * REPLACE (c_name || ' B' AS c_name) FROM company_keys WHERE c_custkey % 50 = 0))"""


def requests(spark, sf_dir):
    """Asked tax ids: masked text, some wrong or unknown, a third of them the same one."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    customer = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), tasks)  # one small file
    nation = F.when(F.col("c_custkey") % 3 == 0, F.lit(0)).otherwise(F.col("c_nationkey"))
    asked = F.when(F.col("c_custkey") % 3 == 0, F.lit(0)).when(
        F.col("c_custkey") % 11 == 0, F.col("c_custkey") + 50000000
    ).otherwise(F.col("c_custkey"))
    first = F.concat(F.lpad(asked.cast("string"), 8, "0"),
                     F.lpad((nation + 1).cast("string"), 4, "0"))
    rows = customer.select(F.col("c_custkey").alias("request_id"), first.alias("first"))
    rows = rows.withColumn("check", F.explode(F.array(taxid.check_digits(F.col("first")))))  # used three times, worked out once
    wrong = F.when(F.col("request_id") % 10 == 1,
                   ((F.substring("check", 2, 1).cast("int") + 1) % 10).cast("string")
                   ).otherwise(F.substring("check", 2, 1))
    full = F.concat("first", F.substring("check", 1, 1), wrong)
    return rows.select("request_id", taxid.masked(full).alias("cnpj"))


REQUESTS = f"""asked AS (SELECT c_custkey AS request_id,
    lpad(CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 11 = 0 THEN c_custkey + 50000000
      ELSE c_custkey END AS VARCHAR), 8, '0')
    || lpad(CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE c_nationkey + 1 END AS VARCHAR), 4, '0') AS fst
  FROM customer),
asked_dv AS (SELECT *, {check_digits_sql('fst')} AS dv FROM asked),
asked_full AS (SELECT request_id, fst || dv[1] || CASE WHEN request_id % 10 = 1
    THEN CAST((CAST(dv[2] AS INT) + 1) % 10 AS VARCHAR) ELSE dv[2] END AS d, request_id % 10 <> 1 AS ok
  FROM asked_dv),
requests AS (SELECT request_id, ok, d, d[1:2] || '.' || d[3:5] || '.' || d[6:8] || '/' || d[9:12]
    || '-' || d[13:14] AS cnpj FROM asked_full)"""

_PARTNER = {
    "identificador_socio": ("CAST(o_orderkey AS string)", "CAST(o_orderkey AS VARCHAR)"),
    "razao_social": ("o_orderpriority", "o_orderpriority"),
    "cnpj_cpf_socio": ("'None'", "'None'"),
    "data_entrada_sociedade": ("date_format(o_orderdate, 'yyyy-MM-dd')",
                               "strftime(o_orderdate, '%Y-%m-%d')"),
    "faixa_etaria": ("o_orderstatus", "o_orderstatus"),
}


def partners(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "lpad(CAST(o_custkey AS string), 8, '0') AS cnpj_basico",
        *[f"{_PARTNER.get(c, (chr(39) * 2,))[0]} AS {c}" for c in PARTNER_ATTRIBUTES],
    )


PARTNERS = "partners AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS basico, {} FROM orders)".format(
    ", ".join(f"{_PARTNER.get(c, ('', chr(39) * 2))[1]} AS {c}" for c in PARTNER_ATTRIBUTES)
)


def files(spark, sf_dir):
    """Yearly files: totals of a state, and one per territory."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("state_code"), F.year("o_orderdate").alias("year"),
        F.concat(F.lit("T"), (F.col("o_custkey") % 40).cast("string")).alias("territory_id"),
    )
    cells = orders.rollup("state_code", "year", "territory_id").agg(F.count("*").alias("n"))
    return cells.where(F.col("year").isNotNull() & F.col("state_code").isNotNull()).select(
        F.concat_ws("-", "state_code", "year", "territory_id").alias("id"),
        "territory_id", "state_code", F.col("year").cast("string").alias("year"),
        F.concat(F.lit("/agg/"), "state_code", F.lit("/"), F.coalesce("territory_id", F.lit("all")),
                 F.lit("/"), "year", F.lit(".zip")).alias("file_path"),
        F.col("n").cast("string").alias("file_size_mb"),
        F.when(F.col("n") % 2 == 0, "None").otherwise("h").alias("hash_info"),
        F.lit("2024-01-01").alias("last_updated"),
    )


FILES = """order_cells AS (SELECT o_orderstatus AS state_code, year(o_orderdate) AS y,
    'T' || (o_custkey % 40) AS territory_id FROM orders),
cells AS (
  SELECT state_code, y, territory_id, count(*) AS n FROM order_cells GROUP BY ALL
  UNION ALL
  SELECT state_code, y, NULL, count(*) FROM order_cells GROUP BY state_code, y),
files AS (SELECT concat_ws('-', state_code, y, territory_id) AS id, territory_id, state_code,
  CAST(y AS VARCHAR) AS year,
  '/agg/' || state_code || '/' || coalesce(territory_id, 'all') || '/' || y || '.zip' AS file_path,
  CAST(n AS VARCHAR) AS file_size_mb, CASE WHEN n % 2 = 0 THEN 'None' ELSE 'h' END AS hash_info,
  '2024-01-01' AS last_updated FROM cells)"""


def spiders(spark, sf_dir):
    dates = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.min("l_shipdate").cast("date").alias("first"), F.max("l_shipdate").cast("date").alias("last")
    )
    return dates.selectExpr(
        "concat('spider_', l_suppkey) AS spider_name",
        "CASE WHEN l_suppkey % 13 <> 0 THEN first END AS date_from",
        "CASE WHEN l_suppkey % 3 <> 0 THEN date_sub(last, CAST(l_suppkey % 7 * 200 AS int)) END AS date_to",
        "l_suppkey % 2 = 0 AS enabled",
    )


SPIDERS = """spiders AS (SELECT 'spider_' || l_suppkey AS spider_name,
  CASE WHEN l_suppkey % 13 <> 0 THEN CAST(min(l_shipdate) AS DATE) END AS date_from,
  CASE WHEN l_suppkey % 3 <> 0 THEN CAST(max(l_shipdate) AS DATE) - CAST(l_suppkey % 7 * 200 AS INT) END AS date_to,
  l_suppkey % 2 = 0 AS enabled FROM lineitem GROUP BY l_suppkey)"""


def spider_batch(spark, sf_dir):
    """Batch of the sync: by line items, old and new names, repeated names."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CASE WHEN l_suppkey % 5 = 0 THEN concat('new_', l_suppkey) ELSE concat('spider_', l_suppkey) END"
        " AS spider_name",
        "concat('t', l_partkey % 100) AS territory_id",
        "CAST(l_shipdate AS date) AS date_from",
        "l_orderkey * 8 + l_linenumber AS seq",
    )


SPIDER_BATCH = """batch AS (SELECT CASE WHEN l_suppkey % 5 = 0 THEN 'new_' || l_suppkey
    ELSE 'spider_' || l_suppkey END AS spider_name, 't' || (l_partkey % 100) AS territory_id,
  CAST(l_shipdate AS DATE) AS date_from,
  l_orderkey * 8 + l_linenumber AS seq FROM lineitem)"""


def job_stats(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "event_type AS spider_name", "CAST(user_id AS string) AS job_id",
        "props AS stats", "ts AS created_at",
    )


JOB_STATS = """job_stats AS (SELECT event_id AS id, event_type AS spider_name,
  CAST(user_id AS VARCHAR) AS job_id, props AS stats, ts AS created_at FROM events)"""


def ingest_rows(spark, sf_dir):
    """Scraped rows as text: copies, unknown territories, faulty rows."""
    return ingest_rows_from(documents(spark, sf_dir))


def ingest_rows_from(docs):
    number = "CAST(regexp_extract(source, '[0-9]+', 0) AS int)"
    return docs.selectExpr(
        "doc_id AS arrival",
        f"CASE WHEN doc_id % 41 = 0 THEN '12345' ELSE lpad(CAST({number} AS string), 7, '0') END AS territory_id",
        "CASE WHEN doc_id % 43 = 0 THEN 'someday' ELSE"
        " CAST(date_add(date'2024-01-01', CAST(length(text) % 5 AS int)) AS string) END AS date",
        "'2024-02-01T03:04:05' AS scraped_at",
        "concat('p/', doc_id) AS file_path",
        "'https://example.com/gazette.pdf' AS file_url",
        "CASE WHEN doc_id % 47 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'hot' ELSE md5(text) END AS file_checksum",
        "CAST(doc_id AS string) AS edition_number",
    )


INGEST_ROWS = """raw_rows AS (SELECT doc_id AS arrival,
  CASE WHEN doc_id % 41 = 0 THEN '12345'
    ELSE lpad(regexp_extract(source, '[0-9]+'), 7, '0') END AS territory_id,
  CASE WHEN doc_id % 43 <> 0 THEN DATE '2024-01-01' + CAST(length(text) % 5 AS INT) END AS date,
  'p/' || doc_id AS file_path,
  CASE WHEN doc_id % 47 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'hot' ELSE md5(text) END AS file_checksum,
  CAST(doc_id AS VARCHAR) AS edition_number FROM documents),
checked AS (SELECT *, concat_ws(',', CASE WHEN length(territory_id) <> 7 THEN 'territory_id' END,
  CASE WHEN date IS NULL THEN 'date' END, CASE WHEN file_checksum IS NULL THEN 'file_checksum' END) AS errors
  FROM raw_rows)"""


def ingest_territories(spark, sf_dir):
    """Known territories: all sources but src19."""
    return table(spark, sf_dir, "documents").selectExpr(
        "lpad(regexp_extract(source, '[0-9]+', 0), 7, '0') AS id"
    ).where("id <> '0000019'").distinct()


def ingest_target(spark, sf_dir):
    """Stored gazettes: those of every fourth document."""
    from recordsearch.operators.ingest import validate_ingest_rows

    rows = validate_ingest_rows(ingest_rows(spark, sf_dir).where("arrival % 4 = 0"))
    sound = rows.where("size(errors) = 0").groupBy("territory_id", "date", "file_checksum")
    return sound.agg(F.min("arrival").alias("id"))


INGEST_TARGET = """target AS (SELECT territory_id, date, file_checksum, min(arrival) AS id
  FROM checked WHERE arrival % 4 = 0 AND errors = '' GROUP BY 1, 2, 3)"""


def postings(spark, sf_dir):
    from recordsearch.operators.postings import token_rows

    return token_rows(documents(spark, sf_dir), "doc_id", "text")


_INDEXES: dict[tuple[str, str], Index] = {}


def index(spark, sf_dir) -> Index:
    """The stored index of the documents as gazettes; built once a session, as a corpus is indexed once and searched often."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _INDEXES:
        _INDEXES[known] = write_index(Corpus(gazettes(spark, sf_dir), key="id"), shared_folder(spark), buckets=16)
    return _INDEXES[known]


TOKENS = """token_lists AS (SELECT doc_id,
    regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS toks FROM documents),
postings AS (SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos
  FROM token_lists),
lengths AS (SELECT doc_id, CAST(len(toks) AS BIGINT) AS length FROM token_lists),
freqs AS (SELECT doc_id, token, count(*) AS tf FROM postings GROUP BY 1, 2)"""
