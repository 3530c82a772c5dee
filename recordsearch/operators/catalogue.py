"""Theme catalogue: nested documents and their flat form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordsearch.operators.skew import lookup, spread_join


def themes_list(themes: DataFrame, order: str = "seq") -> DataFrame:
    """Theme names in catalogue order."""
    return themes.select(order, F.col("name").alias("theme"))


def first_theme(themes: DataFrame, name: str, order: str = "seq") -> DataFrame:
    """The first entry of that name (no row when there is none)."""
    return themes.where(F.col("name") == name).orderBy(order).limit(1)


def subthemes_by_theme(themes: DataFrame) -> DataFrame:
    """One row per theme with the ordered titles of its queries."""
    return themes.select(
        F.col("name").alias("theme"),
        F.transform("queries", lambda q: q["title"]).alias("subthemes"),
    )


def subtheme_rows(themes: DataFrame) -> DataFrame:
    return themes.select(
        F.col("name").alias("theme"), F.posexplode("queries").alias("pos", "query")
    ).select("theme", "pos", F.col("query.title").alias("subtheme"))


def _titles_of(cases):
    """Titles of the cases of one category, in order."""
    def of(category):
        mine = F.filter(cases, lambda k: k["category"] == category["name"])
        return F.struct(
            category["name"].alias("entity_type"),
            category["description"].alias("entity_type_description"),
            F.transform(mine, lambda k: k["title"]).alias("entities"),
        )
    return of


def entities_by_category(themes: DataFrame) -> DataFrame:
    """Nested: every category with its cases, kept in order, empty lists kept.

    Works within one catalogue document and needs no shuffle.
    """
    cases = F.col("entities.cases")
    return themes.select(
        F.col("name").alias("theme"),
        F.transform("entities.categories", _titles_of(cases)).alias("entities"),
    )


def entity_rows(categories: DataFrame, cases: DataFrame) -> DataFrame:
    """Flat tables: categories (name, description) left joined to cases.

    The cases stay rows and those of a very frequent category are spread; a
    category of any size is never gathered.
    """
    titles = cases.select(F.col("category").alias("name"), "title")
    used = spread_join(titles, categories, ["name"], row_id=["title"])
    unused = categories.join(titles.select("name").distinct(), "name", "left_anti").withColumn("title", F.lit(None).cast("string"))
    out = [F.col("name").alias("entity_type"), F.col("description").alias("entity_type_description"), F.col("title").alias("entity")]
    return used.select(*out).unionByName(unused.select(*out))


def write_excerpts(excerpts: DataFrame, path: str) -> None:
    """Store excerpts with a folder for each theme.

    Rows are dealt by key, so a large theme is written by many tasks; a task
    writes at most one file a theme.
    """
    excerpts.repartition(F.xxhash64("excerpt_id")).write.mode("overwrite").partitionBy("theme").parquet(path)


def theme_route(excerpts: DataFrame, themes: DataFrame, name: str, check: bool = False):
    """Excerpts of a theme, by the partition column.

    ``check`` looks the name up at once and raises when the catalogue lacks it.
    """
    if check and not first_theme(themes, name, themes.columns[0]).take(1):
        raise ValueError("Theme not found.")
    return excerpts.where(F.col("theme") == name)


def route_excerpts(requests: DataFrame, themes: DataFrame, excerpts: DataFrame, row_id: str) -> DataFrame:
    """The excerpts of every requested theme that the catalogue has.

    Of stored excerpts only the folders of these themes are read: the themes
    found (no more than the catalogue has) are a filter on the partition
    column that is worked out before the scan lists its files.
    """
    found = route_all(requests, themes, row_id).where("status = 'found'").select(row_id, "theme")
    asked = found.agg(F.collect_set("theme")).scalar()
    return excerpts.where(F.array_contains(asked, F.col("theme"))).join(found, "theme")


def route_all(requests: DataFrame, themes: DataFrame, row_id: str) -> DataFrame:
    """Index of every requested theme; ``status`` tells found from unknown."""
    first = themes.groupBy(F.col("name").alias("theme")).agg(F.min_by("index", "seq").alias("index"))
    return lookup(requests, first, ["theme"], [row_id]).withColumn(
        "status", F.when(F.col("index").isNull(), "not_found").otherwise("found")
    )
