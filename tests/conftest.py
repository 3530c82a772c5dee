import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "America/Sao_Paulo")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def toy(spark):
    """Thirteen loaded rows; the last replaces the one before it."""
    from datetime import date, datetime, timedelta

    today = date(2024, 6, 15)
    base = "Our town plans harbour repair budget"
    lines = [
        (1, 0, "3304557", base),
        (2, -1, "4205902", base),
        (3, 1, "4205902", base),
        (4, -1, "3304557", base + ". otherlantern"),
        (5, 1, "4205902", base + ". lantern1"),
        (6, 0, "3304557", "Our town plans harbour repair with some lanterm near: 000.000.000-00"),
        (7, -8, "4205919", base + " after meeting 6"),
        (8, -7, "4205919", base + " after meeting 7"),
        (9, -6, "4205919", base + " after meeting 8"),
        (10, -8, "4205920", base + " after meeting 9"),
        (11, -7, "4205920", base + " after meeting 10"),
        (12, -6, "4205920", base + " after meeting 11"),
        (13, -6, "4205920", base + " after meeting 11"),
    ]
    seen = datetime(2020, 10, 30, 7, 4, 29, 796347)
    rows = []
    for n, shift, territory, text in lines:
        last = n == 13
        rows.append((
            n, territory, "Some Town", "RJ", today + timedelta(days=shift), seen, seen,
            None if last else "123.45", None if last else False, "executive",
            f"sum{min(n, 12):02d}", f"{territory}/file", "https://town.example.net/4067",
            "https://town.example.net/4067", f"{territory}/file.txt", text, True,
        ))
    from recordsearch.schemas import GAZETTES

    return spark.createDataFrame(rows, GAZETTES).coalesce(2)


@pytest.fixture(scope="session")
def toy_current(toy):
    from recordsearch.operators.ingest import bulk_load_latest

    return bulk_load_latest(None, toy, ["file_checksum"], "id")
