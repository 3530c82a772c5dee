"""Spider tables: who runs when, and the upkeep of names and territories."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordsearch.operators.filters import where


def interval_overlap(spiders: DataFrame, start: date | None = None, end: date | None = None):
    """Enabled spiders whose open-ended interval meets the window.

    With an end, spiders without a first date are left out.
    """
    return where(
        spiders,
        F.coalesce(F.col("enabled"), F.lit(False)),
        None if start is None else F.col("date_to").isNull() | (F.col("date_to") >= F.lit(start)),
        None if end is None else F.col("date_from") <= F.lit(end),
    )


def spider_record(df: DataFrame) -> DataFrame:
    return df.select("spider_name", "date_from", "date_to")


def order_spider_name(df: DataFrame) -> DataFrame:
    return df.orderBy("spider_name")


def _pieces(first, last):
    """The days first..last as (level, node): at most two aligned pieces of 2^level days for each level."""
    empty = F.array().cast("array<struct<level:int,node:bigint>>")

    def step(state, level):
        odd_low, odd_high = state["low"] % 2 == 1, state["high"] % 2 == 1
        some = state["low"] < state["high"]
        piece = lambda ok, node: F.when(ok, F.array(F.struct(level.alias("level"), node.alias("node")))).otherwise(empty)
        after = F.when(some & odd_low, state["low"] + 1).otherwise(state["low"])
        more = F.concat(piece(some & odd_low, state["low"]), piece((after < state["high"]) & odd_high, state["high"] - 1))
        return F.struct(F.shiftright(after, 1).alias("low"), F.shiftright(state["high"], 1).alias("high"),
                        F.concat(state["out"], more).alias("out"))

    start = F.struct(first.cast("long").alias("low"), (last + 1).cast("long").alias("high"), empty.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(_LEVELS)), start, step, lambda state: state["out"])


#: Levels of pieces; days count from the first day of the data.
_LEVELS = 24


#: Spans that meet the days of a piece together: few enough to come again many times in a page of a columnar file.
_BLOCK = 256


def _holding(day):
    """All pieces that a day lies in."""
    return F.transform(F.sequence(F.lit(0), F.lit(_LEVELS)), lambda level: F.struct(
        level.alias("level"), F.floor(day / F.pow(F.lit(2), level)).cast("long").alias("node")))


def overlap_windows(spiders: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, spider) pairs for a table of windows (window_id, start, end).

    Two spans meet when one's first day lies in the other.  A span is a few
    aligned pieces of days and a day lies in one piece of each size, so both
    cases are equi-joins on pieces; a day is in one piece of a span only, so a
    pair comes once.  An open end reaches to the end of the data.

    The result grows with windows times spiders, so it is dealt out by pairs: a
    piece with more of them than a task should make has its days spread over
    several parts and its spans repeated in each.  Both sides are many times
    larger than the tables they come from, so they are merged and never sent
    whole to the driver.

    Nearly all bytes are those of the pairs.  The spans of a piece meet its days
    in blocks of a few, and a block is done with all days before the next one:
    the id on one side stays the same for a whole block and the ids on the other
    come again for each day, so a columnar file holds many pairs in a byte.
    """
    tasks = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    live = spiders.where("enabled")
    ends = windows.select(F.col("start").alias("d")).unionByName(
        windows.select(F.col("end").alias("d"))
    ).unionByName(live.select(F.col("date_from").alias("d"))).unionByName(
        live.select(F.col("date_to").alias("d"))
    )
    span = ends.agg(F.coalesce(F.min("d"), F.lit("2000-01-01").cast("date")).alias("lo"),
                    F.coalesce(F.max("d"), F.lit("2000-01-01").cast("date")).alias("hi")).select(F.struct("*")).scalar()

    def spans(df, first, last, prefix):
        """First and last day, counted from the first of the data; reversed spans are turned, the last test decides on them."""
        with_span = df.withColumn("_span", span)
        begin = F.datediff(F.coalesce(F.col(first), F.col("_span.lo")), F.col("_span.lo"))
        end = F.datediff(F.coalesce(F.col(last), F.col("_span.hi")), F.col("_span.lo"))
        return with_span.withColumns({f"{prefix}a": F.least(begin, end), f"{prefix}b": F.greatest(begin, end)}).drop("_span")

    # a small file is one task, but each of its rows makes many pieces
    asked = spans(windows, "start", "end", "_w").repartition(tasks)
    listed = spans(live, "date_from", "date_to", "_s").repartition(tasks)

    def met(days, at, of, first, last):
        points = days.select("*", F.inline(_holding(F.col(at))))
        pieces = of.select("*", F.inline(_pieces(F.col(first), F.col(last))))
        held = days.groupBy(at).agg(F.count("*").alias("n")).select("n", F.inline(_holding(F.col(at))))
        whole = of.groupBy(first, last).agg(F.count("*").alias("m")).select("m", F.inline(_pieces(F.col(first), F.col(last))))
        # at most two rows for each day between the first and the last of the data
        pairs = held.groupBy("level", "node").agg(F.sum("n").alias("n")).join(
            whole.groupBy("level", "node").agg(F.sum("m").alias("m")).hint("merge"), ["level", "node"])
        share = F.col("n").cast("double") * F.col("m") / F.sum(F.col("n").cast("double") * F.col("m")).over(Window.partitionBy())
        dealt = pairs.select("level", "node", F.least(F.ceil(share * 4 * tasks), F.col("n")).cast("int").alias("_parts"))
        own = F.pmod(F.xxhash64(*days.columns), F.col("_parts")).cast("int")
        left = points.join(F.broadcast(dealt), ["level", "node"]).withColumn("_part", own)
        right = pieces.join(F.broadcast(dealt), ["level", "node"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        key = ["level", "node", "_part"]
        # blocks are cut in the task that joins them, so they need not be the same when it is run again
        listed = right.drop("_parts").repartition(tasks, *key).sortWithinPartitions(*key).withColumn(
            "_block", F.floor(F.monotonically_increasing_id() / _BLOCK))
        blocks = listed.groupBy(*key, "_block").agg(F.collect_list(F.struct(*of.columns)).alias("_spans")).drop("_block")
        both = blocks.join(left.drop("_parts").repartition(tasks, *key).hint("merge"), key)
        return both.select(*days.columns, F.inline("_spans"))

    began = met(listed, "_sa", asked, "_wa", "_wb")
    # the day itself belongs to the case above
    inside = met(asked, "_wa", listed.where("_sa < _sb").withColumn("_next", F.col("_sa") + 1), "_next", "_sb")
    meets = (
        (F.col("start").isNull() | F.col("date_to").isNull() | (F.col("date_to") >= F.col("start")))
        & (F.col("end").isNull() | (F.col("date_from") <= F.col("end")))
    )
    out = ("window_id", "spider_name", "date_from", "date_to")
    return began.where(meets).select(*out).unionByName(inside.where(meets).select(*out))


def sync_spiders(spiders: DataFrame, batch: DataFrame, seq: str) -> DataFrame:
    """Upsert by name; the result is the next snapshot with the ``action`` taken.

    New names start disabled and open-ended.  Of an existing spider only the
    first date changes, and only when it differs; a stored null stays.  The
    later row of a name wins.
    """
    news = batch.groupBy("spider_name").agg(F.max_by("date_from", seq).alias("_from"))
    joined = spiders.withColumn("_old", F.lit(True)).join(news, "spider_name", "full_outer")
    known = F.col("_old").isNotNull()
    differs = F.coalesce(F.col("date_from") != F.col("_from"), F.lit(False))
    return joined.select(
        "spider_name",
        F.when(~known | differs, F.col("_from")).otherwise(F.col("date_from")).alias("date_from"),
        "date_to",
        F.when(known, F.col("enabled")).otherwise(F.lit(False)).alias("enabled"),
        F.when(~known, "inserted").when(differs, "updated").otherwise("unchanged").alias("action"),
    )


def sync_territory_map(spider_map: DataFrame, batch: DataFrame) -> DataFrame:
    """Add the pairs that are not there yet."""
    pairs = batch.select("spider_name", "territory_id").distinct()
    fresh = pairs.join(spider_map, ["spider_name", "territory_id"], "left_anti")
    return spider_map.select("spider_name", "territory_id").unionByName(fresh)


def sync_summary(batch: DataFrame, synced: DataFrame) -> DataFrame:
    """Input rows of the batch, and how many spiders each action touched."""
    return synced.groupBy("action").agg(F.count("*").alias("n")).unionByName(
        batch.agg(F.count("*").alias("n")).withColumn("action", F.lit("processed"))
    )
