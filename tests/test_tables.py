"""Golden rows of everything but text search."""

import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from recordsearch.functions import dates, taxid, text, urls
from recordsearch.operators import catalogue, cities, companies, files, filters, ingest, jobstats, spiders
from recordsearch.operators.page import topk_per_group
from recordsearch.operators.skew import dense_ids, lookup, spread_join
from recordsearch.schemas import CITIES, COMPANIES, JOB_STATS, PARTNERS
from recordsearch.sources import readers, writers

E = "files.example.org"
OLD = ("old-cdn.example.net", "older-cdn.example.net", "legacy-bucket")
PATH = "3304557/2019/file.pdf"


@pytest.mark.parametrize(
    "url, endpoint, replace, out",
    [
        (PATH, "", False, PATH),
        (PATH, E, False, f"https://{E}/{PATH}"),
        (PATH, f"https://{E}", False, f"https://{E}/{PATH}"),
        (PATH, f"{E}/", False, f"https://{E}/{PATH}"),
        (f"/{PATH}", E, False, f"https://{E}/{PATH}"),
        (f"https://old-cdn.example.net/{PATH}", E, False, f"https://old-cdn.example.net/{PATH}"),
        (f"https://old-cdn.example.net/{PATH}", E, True, f"https://{E}/{PATH}"),
        (f"https://older-cdn.example.net/{PATH}", E, True, f"https://{E}/{PATH}"),
        (f"s3://legacy-bucket/{PATH}", E, True, f"https://{E}/{PATH}"),
        (f"s3://legacy-bucket/{PATH}", f"s3://{E}", True, f"s3://{E}/{PATH}"),
        (f"https://{E}/{PATH}", E, True, f"https://{E}/{PATH}"),
        ("https://town.example.net/4067", E, True, "https://town.example.net/4067"),
        (f"{E}/3304557/f.pdf", f"http://{E}", False, f"http://{E}/3304557/f.pdf"),
        (f"{E}X/f.pdf", E, False, f"https://{E}X/f.pdf"),
        ("https://old-cdn.example.net", E, True, "https://old-cdn.example.net"),
        ("tcp://old-cdn.example.net/a", E, True, f"https://{E}/tcp://old-cdn.example.net/a"),
    ],
)
def test_file_urls(spark, url, endpoint, replace, out):
    store = urls.FileStore(endpoint, replace, OLD)
    row = spark.createDataFrame([(url,)], "u string").select(urls.build_file_url(F.col("u"), store))
    assert row.first()[0] == out


def test_tax_ids(spark):
    rows = [
        ("00.000.000/0001-91", "00000000000191", True, "00.000.000/0001-91", "valid"),
        ("191", "00000000000191", True, "00.000.000/0001-91", "valid"),
        ("11222333000181", "11222333000181", True, "11.222.333/0001-81", "valid"),
        ("11222333000180", "11222333000180", False, "11.222.333/0001-80", "wrong_check_digits"),
        ("0", "00000000000000", True, "00.000.000/0000-00", "valid"),
        ("abc", "", False, "", "empty"),
        ("", "", False, "", "empty"),
        ("112223330001815", "112223330001815", False, "11.222.333/0001-815", "too_long"),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, raw string")
    got = taxid.clean_tax_ids(df, "raw").orderBy("i").collect()
    assert [(r.raw, r.digits, r.is_valid, r.masked, r.outcome) for r in got] == rows
    twelve = spark.createDataFrame([("000000010001",), ("335308640001",), ("000012340002",)], "b string")
    assert [r[0] for r in twelve.select(taxid.check_digits(F.col("b"))).collect()] == ["36", "74", "34"]
    joined = taxid.joined(F.lit(1), F.lit(1), F.lit(36))
    assert spark.range(1).select(joined).first()[0] == "00000001000136"


def test_one_wrong_digit_is_never_valid(spark):
    base = spark.range(300).select(F.lpad((F.col("id") * 7919 % 10**9).cast("string"), 12, "0").alias("b"))
    ids = base.select(F.concat("b", taxid.check_digits(F.col("b"))).alias("d"))
    assert ids.where(~taxid.is_valid(F.col("d"))).count() == 0
    wrong = ids.select(F.concat(
        F.substring("d", 1, 13), ((F.substring("d", 14, 1).cast("int") + 3) % 10).cast("string")
    ).alias("d"))
    assert wrong.where(taxid.is_valid(F.col("d"))).count() == 0


def test_scalar_text(spark):
    df = spark.createDataFrame([("",), ("None",), (None,), ("5",)], "c string")
    assert [r[0] for r in df.select(text.text_or_null(F.col("c"))).collect()] == [None, None, None, "5"]
    df = spark.createDataFrame([(" a , b ",), ("",), ("  ",), (",",)], "c string")
    assert [r[0] for r in df.select(text.split_list(F.col("c"))).collect()] == [["a ", " b"], None, None, ["", ""]]
    df = spark.createDataFrame([("“a” ‘b’",)], "c string")
    assert df.select(text.fold_quotes(F.col("c"))).first()[0] == "\"a\" 'b'"
    with pytest.raises(Exception):
        spark.range(1).select(dates.parse_date(F.lit("2024-02-30"), strict=True)).collect()


def test_arrays_with_null_elements(spark):
    df = spark.createDataFrame([(1, ["a", None]), (2, ["b"]), (3, None), (4, [])], "i int, xs array<string>")
    assert [r.i for r in filters.where(df, filters.array_any("xs", ["b"])).collect()] == [2]
    assert filters.array_any("xs", []) is None


def test_enum_check_strict(spark):
    df = spark.createDataFrame([("0",), ("9",)], "l string")
    with pytest.raises(Exception, match="not allowed"):
        filters.enum_check(df, "l", strict=True)[0].collect()
    with pytest.raises(ValueError):
        filters.check_sort_mode("random")


def test_cities(spark, tmp_path):
    (tmp_path / "c.csv").write_text(
        "city_name,ibge_id,uf,openness_level,gazettes_urls,availability_date\n"
        'Pirapora,3151206,MG,1,"https://a.org,https://b.org",2020\n'
        "São João,2611101,PE,0,,\n", encoding="utf-8")
    table = readers.scan_cities_csv(spark, str(tmp_path / "c.csv"))

    def names(**ask):
        return [r.territory_name for r in cities.find_cities(table, **ask).collect()]

    assert names(name="pira") == ["Pirapora"]
    assert names(name="sao") == []
    assert names(name="SÃO") == ["São João"]
    assert len(names(levels=[""])) == len(names(levels=[])) == len(names()) == 2
    assert names(levels=["", "1"]) == ["Pirapora"]
    found = {r.territory_id: r for r in cities.find_cities(table).collect()}
    assert found["3151206"].publication_urls == ["https://a.org", "https://b.org"]
    assert found["2611101"].publication_urls is None
    asked = spark.createDataFrame([(1, "3151206"), (2, "9999999")], "n int, id string")
    out = {r.n: r for r in cities.lookup_city(asked, table, "id", "n").collect()}
    assert out[1].territory_name == "Pirapora" and out[1].found
    assert out[2].territory_name is None and not out[2].found


def test_theme_catalogue(spark, tmp_path):
    (tmp_path / "t.json").write_text("""{"themes": [{"name": "T", "index": "t_index",
      "queries": [{"title": "q1"}, {"title": "q2"}],
      "entities": {"categories": [{"name": "A", "description": "a"}, {"name": "B", "description": "b"}],
        "cases": [{"title": "x", "category": "A"}, {"title": "y", "category": "A"},
                  {"title": "z", "category": "C"}]}}]}""")
    themes = readers.scan_theme_catalogue(spark, str(tmp_path / "t.json"))
    nested = catalogue.entities_by_category(themes).first().entities
    assert [(e.entity_type, e.entities) for e in nested] == [("A", ["x", "y"]), ("B", [])]
    assert catalogue.subthemes_by_theme(themes).first().subthemes == ["q1", "q2"]
    assert [r.subtheme for r in catalogue.subtheme_rows(themes).orderBy("pos").collect()] == ["q1", "q2"]
    assert catalogue.first_theme(themes, "none").count() == 0
    with pytest.raises(ValueError, match="Theme not found"):
        catalogue.theme_route(themes.withColumn("theme", F.lit("T")), themes, "none", check=True)


def test_company_outcomes(spark):
    blank = [""] * 36
    first, second = ["1", "Alpha", *blank[2:]], ["1", "Beta", *blank[2:]]
    rows = [("00000000", "0001", "91", *second), ("00000000", "0001", "91", *first)]
    table = spark.createDataFrame(rows, COMPANIES)
    asked = spark.createDataFrame(
        [(1, "191"), (2, "11222333000181"), (3, "11222333000180"), (4, "191")], "n int, id string")
    out = {r.n: r for r in companies.enrich_companies(asked, table, "id", "n").collect()}
    assert [out[n].status for n in (1, 2, 3, 4)] == ["found", "not_found", "invalid", "found"]
    assert out[1].nome_fantasia == out[4].nome_fantasia == "Alpha"
    assert out[1].cnpj_completo == "00.000.000/0001-91" and out[1].bairro is None
    assert out[2].cnpj_basico is None and len(out[1]) == 44


def test_partners_are_never_merged(spark):
    rows = [("00000000", "1", "Same", *[""] * 8)] * 2 + [("99999999", "1", "Other", *[""] * 8)]
    table = spark.createDataFrame(rows, PARTNERS)
    asked = spark.createDataFrame([(1, "191"), (2, "11222333000181"), (3, "x")], "n int, id string")
    out = companies.enrich_partners(asked, table, "id", "n").collect()
    assert sorted((r.n, r.status, r.razao_social) for r in out if r.n == 1) == [(1, "found", "Same")] * 2
    assert sorted((r.n, r.status) for r in out if r.n > 1) == [(2, "empty"), (3, "invalid")]
    counts = companies.partner_counts(asked, table, "id", "n").collect()
    assert sorted((r.n, r.total_partners) for r in counts) == [(1, 2), (2, 0)]


def test_asked_ids_are_checked_after_they_are_dealt_out(spark):
    rows = [(n, "191" if n % 2 else None if n % 4 else "11.222.333/0001-80") for n in range(200)]
    asked = companies.request_ids(spark.createDataFrame(rows, "n int, id string").coalesce(1), "id", "n")
    valid = asked.where("is_valid")
    plan = valid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Repartition")
    assert plan.count("[^0-9]") == 1
    assert valid.select(F.spark_partition_id()).distinct().count() > 1
    assert valid.count() == 100 and asked.count() == 200
    one = valid.select(*companies.ID_COLUMNS).distinct().collect()
    assert [tuple(r) for r in one] == [("00000000", "0001", "91", "00.000.000/0001-91", "00000000000191")]


def test_file_catalogue(spark):
    table = spark.createDataFrame(
        [("1", None, "SP", "2022", "/agg/sp/2022.zip", "1", "None", "d"),
         ("2", None, "SP", "2023", "/agg/sp/2023.zip", "1", "h", "d"),
         ("3", "3550308", "SP", "2023", "/agg/3550308/2023.zip", "1", "h", "d"),
         ("4", None, "SP", None, None, "1", "h", "d")],
        "id string, territory_id string, state_code string, year string, file_path string, "
        "file_size_mb string, hash_info string, last_updated string")
    state = files.find_files(table, "sp", endpoint="store").collect()
    assert [r.year for r in state] == [None, "2023", "2022"]
    assert [r.file_path for r in state] == [None, "store/agg/sp/2023.zip", "store/agg/sp/2022.zip"]
    assert state[2].hash_info is None
    assert [r.file_path for r in files.find_files(table, "sp", "3550308").collect()] == ["/agg/3550308/2023.zip"]


SPIDERS = [
    ("a", date(2015, 1, 1), None, True), ("b", date(2010, 1, 1), date(2023, 12, 31), True),
    ("c", date(2010, 1, 1), date(2024, 1, 1), True), ("d", date(2025, 1, 1), None, True),
    ("e", None, None, True), ("f", date(2015, 1, 1), None, False),
]
SPIDER_SCHEMA = "spider_name string, date_from date, date_to date, enabled boolean"


def test_spider_windows(spark):
    table = spark.createDataFrame(SPIDERS, SPIDER_SCHEMA)
    start, end = date(2024, 1, 1), date(2024, 12, 31)

    def names(df):
        return sorted(r.spider_name for r in df.collect())

    assert names(spiders.interval_overlap(table, start, end)) == ["a", "c"]
    assert names(spiders.interval_overlap(table, start)) == ["a", "c", "d", "e"]
    windows = [(1, start, end), (2, start, None), (3, None, end), (4, None, None), (5, end, start)]
    asked = spark.createDataFrame(windows, "window_id int, start date, end date")
    pairs = spiders.overlap_windows(table, asked)
    for number, first, last in windows[:4]:
        assert names(pairs.where(F.col("window_id") == number)) == names(
            spiders.interval_overlap(table, first, last))


def test_sync_spiders(spark):
    table = spark.createDataFrame(SPIDERS, SPIDER_SCHEMA)
    batch = spark.createDataFrame(
        [("a", "t1", date(2015, 1, 1), 1), ("c", "t1", date(2011, 1, 1), 2), ("e", "t1", date(2011, 1, 1), 3),
         ("new", "t1", date(2001, 1, 1), 4), ("new", "t2", date(2002, 1, 1), 5), ("c", "t1", date(2012, 1, 1), 6)],
        "spider_name string, territory_id string, date_from date, seq int")
    synced = spiders.sync_spiders(table, batch, "seq")
    out = {r.spider_name: (r.date_from, r.date_to, r.enabled, r.action) for r in synced.collect()}
    assert out["a"] == (date(2015, 1, 1), None, True, "unchanged")
    assert out["c"] == (date(2012, 1, 1), date(2024, 1, 1), True, "updated")
    assert out["e"] == (None, None, True, "unchanged")
    assert out["new"] == (date(2002, 1, 1), None, False, "inserted")
    again = spiders.sync_spiders(synced.drop("action"), batch, "seq")
    assert {r.action for r in again.collect()} == {"unchanged"}
    summary = {r.action: r.n for r in spiders.sync_summary(batch, synced).collect()}
    assert summary == {"processed": 6, "inserted": 1, "updated": 1, "unchanged": 5}
    stored = spark.createDataFrame([("c", "t1")], "spider_name string, territory_id string")
    pairs = spiders.sync_territory_map(stored, batch)
    assert sorted(map(tuple, pairs.collect())) == [
        ("a", "t1"), ("c", "t1"), ("e", "t1"), ("new", "t1"), ("new", "t2")]
    assert spiders.sync_territory_map(pairs, batch).count() == 5


def test_job_stats(spark):
    for limit in (0, 1001):
        with pytest.raises(ValueError):
            jobstats.check_limit(limit)
    legacy = spark.createDataFrame(
        [(1, "a", '{"n":1}', datetime(2024, 1, 1)), (2, None, "{}", datetime(2024, 1, 1))],
        "id long, spider string, job_stats string, start_time timestamp_ntz")
    once, refused = jobstats.migrate_job_stats(legacy)
    twice, _ = jobstats.migrate_job_stats(once)
    shown = [F.to_json("stats").alias("stats"), F.unix_seconds("created_at").alias("at")]
    for table in (once, twice):
        assert table.columns == ["id", "spider_name", "job_id", "stats", "created_at"]
        row = table.select("spider_name", *shown).first()
        assert tuple(row) == ("a", '{"n":1}', 1704067200)
    assert refused.count() == 1 and dict(once.dtypes)["created_at"] == "timestamp"
    empty = spark.createDataFrame([], JOB_STATS)
    rows = spark.createDataFrame([(7, "a", "j", "{}"), (3, "b", None, "{}")],
                                 "arrival long, spider_name string, job_id string, stats string")
    added = jobstats.append_job_stats(empty, rows, "arrival")
    assert sorted((r.id, r.spider_name) for r in added.collect()) == [(1, "b"), (2, "a")]


INGEST = ("arrival long, territory_id string, date string, scraped_at string, file_path string, "
          "file_url string, file_checksum string")


def ingest_row(arrival, territory="3550308", day="2024-06-01", checksum="abc123"):
    return (arrival, territory, day, "2024-06-02T03:04:05", "p", "https://example.com/g.pdf", checksum)


def test_ingest_outcomes(spark):
    rows = spark.createDataFrame(
        [ingest_row(1), ingest_row(2), ingest_row(3, territory="0000000"), ingest_row(4, territory="12345"),
         ingest_row(5, checksum=None), ingest_row(6, day="2024-06-02"), ingest_row(7, checksum="old"),
         ingest_row(8, day="2024-06-31")], INGEST)
    known = spark.createDataFrame([("3550308",)], "id string")
    target = spark.createDataFrame([(41, "3550308", date(2024, 6, 1), "old")],
                                   "id long, territory_id string, date date, file_checksum string")
    checked = ingest.validate_ingest_rows(rows)
    created, judged = ingest.ingest_gazettes(target, checked, known, "arrival", errors="errors")
    assert {r.arrival: (r.status, r.gazette_id) for r in judged.collect()} == {
        1: ("created", 42), 2: ("duplicate", None), 3: ("unknown_territory", None), 4: ("invalid", None),
        5: ("invalid", None), 6: ("created", 43), 7: ("duplicate", None), 8: ("invalid", None)}
    snapshot = target.unionByName(created.select(*target.columns))
    _, again = ingest.ingest_gazettes(snapshot, checked, known, "arrival", errors="errors")
    assert again.where("status = 'created'").count() == 0
    row = created.orderBy("id").first()
    assert row.processed is False and row.created_at is not None


def test_hot_keys_change_nothing(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("n"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("k"))
    table = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = rows.join(table, "k", "left").select("n", "k", "v")
    for joined, other in ((lookup(rows, table, ["k"], ["n"]), plain),
                          (spread_join(rows, table, ["k"]), plain.where("v is not null"))):
        out = joined.select("n", "k", "v")
        assert out.count() == other.count()
        assert out.exceptAll(other).count() == 0


def test_dense_ids_follow_the_order(spark):
    rows = spark.range(1000).select((F.col("id") * F.col("id") % 100003).alias("at"))
    out = dense_ids(rows, "at", F.lit(10), "id", slices=7).orderBy("at").collect()
    assert [r.id for r in out] == list(range(11, 1011))


def test_deep_pages_equal_shallow_ones(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("g"), "id", (F.col("id") * 37 % 1009).alias("v"))
    order = [F.col("v").desc(), F.col("id")]
    deep = topk_per_group(rows, ["g"], order, 900, 200, ["id"])
    plain = topk_per_group(rows, ["g"], order, 900, 200)
    assert deep.count() == 400 and deep.exceptAll(plain).count() == 0


def test_rebuild_keeps_rows_and_order(spark, toy, tmp_path):
    writers.rebuild_dataset(toy, str(tmp_path / "d"), "id")
    back = spark.read.parquet(str(tmp_path / "d"))
    assert back.count() == 13
    per_file = back.select("territory_id", "date", F.input_file_name().alias("f"),
                           F.monotonically_increasing_id().alias("m")).orderBy("f", "m").collect()
    for left, right in zip(per_file, per_file[1:]):
        if left.f == right.f:
            assert (left.territory_id, -left.date.toordinal()) <= (right.territory_id, -right.date.toordinal())


def test_missing_documents_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="does not exist"):
        readers.scan_documents(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="does not exist"):
        readers.scan_documents(spark, "", "no_such_table")


def test_response_json(spark):
    row = spark.createDataFrame([(1, None, "x")], "a int, b int, c string")
    assert writers.to_response_json(row).first()[0] == '{"a":1,"c":"x"}'
    assert writers.to_response_json(row, nulls=True).first()[0] == '{"a":1,"b":null,"c":"x"}'


def test_overlapping_spans_of_any_kind(spark):
    import random
    from datetime import date, timedelta

    rng = random.Random(3)
    first = date(2020, 1, 1)

    def day():
        return None if rng.random() < 0.15 else first + timedelta(days=rng.randrange(200))

    live = [(f"s{i}", day(), day(), rng.random() < 0.9) for i in range(120)]
    asked = [(i, day(), day()) for i in range(80)] + [(80, None, None), (81, first, first)]
    table = spark.createDataFrame(live, "spider_name string, date_from date, date_to date, enabled boolean")
    windows = spark.createDataFrame(asked, "window_id int, start date, end date")
    want = sorted((w, s) for w, start, end in asked for s, begin, last, on in live if on
                  and (start is None or last is None or last >= start)
                  and (end is None or (begin is not None and begin <= end)))
    got = sorted((r.window_id, r.spider_name) for r in spiders.overlap_windows(table, windows).collect())
    assert got == want
    nothing = spiders.overlap_windows(table.where("false"), windows)
    assert nothing.collect() == [] and nothing.columns == ["window_id", "spider_name", "date_from", "date_to"]


def test_windows_meet_spiders_in_many_tasks(spark):
    from datetime import date

    windows = spark.range(300).coalesce(1).selectExpr("id AS window_id", "date'2024-01-01' AS start", "date'2024-02-01' AS end")
    table = spark.range(40).coalesce(1).selectExpr(
        "concat('s', id) AS spider_name", "date'2023-12-01' AS date_from", "CAST(NULL AS date) AS date_to", "true AS enabled")
    pairs = spiders.overlap_windows(table, windows)
    shares = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == pairs.distinct().count() == 300 * 40
    assert max(shares) < 300 * 40 * 0.6
    late = spiders.overlap_windows(table, windows.where("window_id < 2").withColumn("end", F.lit(date(2023, 11, 1))))
    assert late.count() == 0



def test_pairs_of_windows_and_spiders_take_few_bytes(spark, tmp_path):
    """Most of the work's bytes are those of the pairs: ids in long runs and in stretches that come again."""
    windows = spark.range(40_000).selectExpr("id AS window_id", "date_add(date'2024-01-01', CAST(id % 5 AS int)) AS start",
                                             "date_add(date'2024-12-01', CAST(id % 7 AS int)) AS end")
    table = spark.range(50).selectExpr("concat('spider', id) AS spider_name", "date_add(date'2024-02-01', CAST(id % 60 AS int)) AS date_from",
                                       "CAST(NULL AS date) AS date_to", "true AS enabled")
    pairs = spiders.overlap_windows(table, windows).select("window_id", "spider_name")
    pairs.write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).distinct().count() == 40_000 * 50
    written = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert written < 40_000 * 50 * 2, written


def test_pages_by_place_and_by_key(spark, tmp_path):
    import random

    from recordsearch.operators import page

    rng = random.Random(1)
    rows = [(i, rng.choice([None, *range(6)]), rng.choice("abc")) for i in range(500)]
    table = spark.createDataFrame(rows, "id int, n int, s string").repartition(5)
    order = [F.col("n").desc_nulls_last(), F.col("s").asc_nulls_last(), F.col("id").asc_nulls_last()]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2], r[0]))
    placed = page.placed(table, order, str(tmp_path / "placed"))
    assert [tuple(r)[:3] for r in placed.orderBy("place").collect()] == want
    assert [r.place for r in placed.orderBy("place").collect()] == list(range(1, 501))
    assert [r.id for r in page.page_of(placed, 490, 20).collect()] == [r[0] for r in want[490:]]
    assert page.placed(table.where("false"), order, str(tmp_path / "none")).collect() == []
    by, at = [("n", False), ("s", True), ("id", True)], 0
    while at < len(want) - 1:
        last = dict(zip(("id", "n", "s"), want[at], strict=True))
        got = [tuple(r) for r in page.continue_after(table, by, last, 90).collect()]
        assert got == want[at + 1:at + 91]
        at += len(got)


def test_entity_rows_of_equal_and_unused_categories(spark):
    from recordsearch.operators import catalogue

    categories = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None), ("c", "z")], "name string, description string")
    cases = spark.createDataFrame([("1", "a"), ("2", "a"), ("2", "a"), ("3", "c"), ("4", "lost"), ("5", None)], "title string, category string")
    got = sorted(map(tuple, catalogue.entity_rows(categories, cases).collect()), key=repr)
    assert got == sorted([("a", d, e) for d in "xy" for e in "122"] + [("b", None, None), ("c", "z", "3")], key=repr)


def test_only_folders_of_asked_themes_are_read(spark, tmp_path):
    from recordsearch.operators import catalogue
    from recordsearch.plans.search import ThemeRequest, excerpt_corpus, search_excerpts
    from testbed import tables as t

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    themes = t.excerpt_themes(spark, folder)
    catalogue.write_excerpts(t.excerpts(spark, folder), str(tmp_path / "excerpts"))
    stored = spark.read.parquet(str(tmp_path / "excerpts"))
    asked = spark.createDataFrame([(1, "es"), (2, "unheard"), (3, None)], "request_id int, theme string")
    rows = catalogue.route_excerpts(asked, themes, stored, "request_id")
    assert {(r.request_id, r.theme) for r in rows.collect()} == {(1, "es")}
    scans = [x for x in rows._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines() if x.startswith("PartitionFilters")]
    assert any("ubquery" in x and "theme" in x for x in scans), scans
    assert rows.count() == t.excerpts(spark, folder).where("theme = 'es'").count()
    with pytest.raises(ValueError, match="Theme not found"):
        search_excerpts(excerpt_corpus(stored), ThemeRequest(theme="unheard"), themes=themes)
    page = search_excerpts(excerpt_corpus(stored), ThemeRequest(theme="es"), themes=themes).page
    assert "PartitionFilters: [isnotnull(theme" in page._jdf.queryExecution().toString()


def test_numbers_follow_loads(spark):
    from recordsearch.functions.text import Analysis
    from recordsearch.operators import ingest, numbers
    from recordsearch.operators.match import AnyOf, Fuzzy, Phrase, Word
    from recordsearch.plans.search import Corpus, corpus_stats, kept_stats

    plain = Analysis(stopwords=("the",), suffixes=("s",))
    first = spark.createDataFrame([(1, "k1", "the dogs"), (2, "k2", "a dog and a cat"), (3, "k3", None), (4, "k4", "")], "id int, k string, text string")
    load = spark.createDataFrame([(5, "k2", "cats"), (6, "k5", "dog dog"), (7, "k2", "birds the bird"), (8, "k4", None)], "id int, k string, text string")
    kept = numbers.count_numbers(first, "text", plain)
    kept = numbers.numbers_after_load(kept, first, load, ["k"], "id", "text", plain)
    after = ingest.bulk_load_latest(first, load, ["k"], "id")
    again = numbers.count_numbers(after, "text", plain)
    assert sorted(map(tuple, kept.words.collect())) == sorted(map(tuple, again.words.collect()))
    assert kept.sizes.collect() == again.sizes.collect()
    corpus = Corpus(after, key="k", text="text", plain=plain)
    clause = AnyOf((Word("dog"), Word("unheard"), Phrase("birds the"), Fuzzy("bord", 1)))
    one, other = kept_stats(kept, corpus, clause).first().asDict(), corpus_stats(corpus, clause).first().asDict()
    del other["any"]
    assert {c: one[c] for c in other} == other
    empty = numbers.count_numbers(first.where("false"), "text")
    assert empty.words.collect() == [] and empty.sizes.first()["n_docs"] == 0
