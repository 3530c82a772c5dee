"""Streams, also after a failure between two writes."""

import pytest

from recordsearch.streaming.jobs import stream_ingest_gazettes, stream_job_stats
from test_tables import INGEST, ingest_row
from testbed import changes

SCHEMA = ("id long, territory_id string, date date, scraped_at timestamp_ntz, created_at timestamp_ntz, "
          "file_checksum string, file_path string, file_url string, processed boolean")


def run(spark, tmp_path, checkpoint):
    known = spark.createDataFrame([("3550308",)], "id string")
    rows = spark.readStream.schema(INGEST).parquet(str(tmp_path / "in"))
    stream_ingest_gazettes(rows, known, str(tmp_path / "target"), str(tmp_path / "status"),
                           str(tmp_path / checkpoint), SCHEMA).awaitTermination()


def feed(spark, tmp_path, rows):
    spark.createDataFrame(rows, INGEST).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_stream_ingest(spark, tmp_path):
    feed(spark, tmp_path, [ingest_row(1), ingest_row(2), ingest_row(3, checksum="b"), ingest_row(4, "12345")])
    run(spark, tmp_path, "cp")
    feed(spark, tmp_path, [ingest_row(5), ingest_row(6, checksum="c"), ingest_row(7, "0000000")])
    run(spark, tmp_path, "cp")
    target = spark.read.parquet(str(tmp_path / "target"))
    assert sorted((r.id, r.file_checksum) for r in target.collect()) == [(1, "abc123"), (2, "b"), (3, "c")]
    statuses = {r.arrival: r.status for r in spark.read.parquet(str(tmp_path / "status")).collect()}
    assert statuses == {1: "created", 2: "duplicate", 3: "created", 4: "invalid", 5: "duplicate",
                        6: "created", 7: "unknown_territory"}


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    feed(spark, tmp_path, [ingest_row(1), ingest_row(2), ingest_row(3, checksum="b")])
    run(spark, tmp_path, "first")
    # A new checkpoint makes the same batch run again over its own results.
    run(spark, tmp_path, "second")
    assert spark.read.parquet(str(tmp_path / "target")).count() == 2
    statuses = {r.arrival: r.status for r in spark.read.parquet(str(tmp_path / "status")).collect()}
    assert statuses == {1: "created", 2: "duplicate", 3: "created"}


def test_stream_job_stats(spark, tmp_path):
    kind = "arrival long, spider_name string, job_id string, stats string"
    rows = [(1, "a", None, '{"n": 1}'), (2, None, "j", "{}"), (3, "b", "j", "oops"), (4, "b", "j", "{}")]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = "id long, spider_name string, job_id string, stats variant, created_at timestamp, arrival long"
    for checkpoint in ("first", "second"):
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        stream_job_stats(stream, str(tmp_path / "t"), str(tmp_path / checkpoint), schema).awaitTermination()
    stored = spark.read.schema(schema).parquet(str(tmp_path / "t"))
    assert sorted((r.id, r.arrival) for r in stored.collect()) == [(1, 1), (2, 4)]


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_streams_from_a_file_and_from_a_folder(spark, tmp_path, files):
    kind = "doc_id long, text string, lang string, source string"
    rows = [(1, "a b", "en", "src1"), (2, "a b", "en", "src1"), (3, "c", "pt", "src19"), (4, "d", "pt", "src2"), (43, "e", None, "src2")]
    whole = tmp_path / "documents.parquet" if files > 1 else tmp_path / "written"
    spark.createDataFrame(rows, kind).repartition(files).write.parquet(str(whole))
    if files == 1:
        (tmp_path / "documents.parquet").write_bytes(next(whole.glob("part-*")).read_bytes())
    found = changes.stream_ingest_gazettes(spark, str(tmp_path))
    assert {r.arrival: r.status for r in found.collect()} == {
        1: "created", 2: "duplicate", 3: "unknown_territory", 4: "created", 43: "invalid"}
