"""Enrich tables of tax ids with company and partner data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordsearch.functions import taxid
from recordsearch.functions.text import text_or_null
from recordsearch.operators.skew import lookup, shuffle_tasks, spread_join
from recordsearch.schemas import COMPANY_ATTRIBUTES, COMPANY_KEYS, PARTNER_ATTRIBUTES
from recordsearch.sources.readers import spread

ID_COLUMNS = ("cnpj_basico", "cnpj_ordem", "cnpj_dv", "cnpj_completo",
              "cnpj_completo_apenas_numeros")


def request_ids(requests: DataFrame, column: str, row_id: str) -> DataFrame:
    """The id columns of a record; they come from the requested id.

    Requests are dealt out, as a small file of them is read by one task.  The
    digits leave a generator: a filter on valid ids stays behind it and behind
    the dealing, and the cleaning of the text is not repeated in each column.
    """
    dealt = spread(requests.select(row_id, column), shuffle_tasks(requests))
    once = F.explode(F.array(taxid.only_digits(F.col(column))))
    asked = dealt.select(row_id, column, once.alias("cnpj_completo_apenas_numeros"))
    raw = F.col("cnpj_completo_apenas_numeros")
    return asked.withColumns({
        "is_valid": taxid.are_valid(raw), "cnpj_basico": F.substring(raw, 1, 8), "cnpj_ordem": F.substring(raw, 9, 4),
        "cnpj_dv": F.substring(raw, 13, 1 << 20), "cnpj_completo": taxid.mask(raw),
    })


def company_record(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """5 id columns and 36 attributes, blanks as nulls, in the published order."""
    return df.select(*keep, *ID_COLUMNS,
                     *[text_or_null(F.col(c)).alias(c) for c in COMPANY_ATTRIBUTES])


def partner_record(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, *ID_COLUMNS,
                     *[text_or_null(F.col(c)).alias(c) for c in PARTNER_ATTRIBUTES])


def enrich_companies(requests: DataFrame, companies: DataFrame, column: str, row_id: str):
    """One row per requested id: status invalid, not_found or found, and the record.

    Only companies that are asked for go on past the join; of several rows
    with one key the first by all attributes is taken.
    """
    asked = request_ids(requests, column, row_id)
    key = ["cnpj_basico", "cnpj_ordem", "cnpj_dv"]
    # Invalid ids lose their key here, so they cannot meet a company.
    asked = asked.withColumn("cnpj_basico", F.when(F.col("is_valid"), F.col("cnpj_basico")))
    wanted = asked.where("is_valid").select(*key).distinct()
    named = companies.select(
        *[F.col(c).alias(k) for c, k in zip(COMPANY_KEYS, key)],
        F.struct(*COMPANY_ATTRIBUTES).alias("c"),
    )
    hits = named.join(wanted, key, "left_semi").groupBy(*key).agg(F.min("c").alias("c"))
    joined = lookup(asked, hits, key, [row_id])
    found = F.col("c").isNotNull()
    status = F.when(~F.col("is_valid"), "invalid").when(found, "found").otherwise("not_found")
    return joined.select(
        row_id, column, status.alias("status"),
        *[F.when(found, F.col(c)).alias(c) for c in ID_COLUMNS],
        *[text_or_null(F.col(f"c.{c}")).alias(c) for c in COMPANY_ATTRIBUTES],
    )


def enrich_partners(requests: DataFrame, partners: DataFrame, column: str, row_id: str):
    """One row per requested id and partner; partners are never merged.

    Ids without partners (or not valid) keep one row, told by ``status``:
    found, empty or invalid.
    """
    asked = request_ids(requests, column, row_id)
    valid = asked.where("is_valid")
    named = partners.select("cnpj_basico", *PARTNER_ATTRIBUTES)
    wanted = valid.select("cnpj_basico").distinct()
    mine = named.join(wanted, "cnpj_basico", "left_semi")
    pairs = spread_join(valid, mine, ["cnpj_basico"], row_id=[row_id]).withColumn("status", F.lit("found"))
    known = partners.select("cnpj_basico").join(wanted, "cnpj_basico", "left_semi").distinct()
    alone = (
        lookup(asked.select(row_id, column, "is_valid", *ID_COLUMNS),
               known.withColumn("_known", F.lit(True)), ["cnpj_basico"], [row_id])
        .where(~F.col("is_valid") | F.col("_known").isNull())
        .withColumn("status", F.when(F.col("is_valid"), "empty").otherwise("invalid"))
        .withColumns({c: F.lit(None).cast("string") for c in PARTNER_ATTRIBUTES})
    )
    shape = (row_id, column, "status")
    return partner_record(pairs, shape).unionByName(partner_record(alone, shape))


def partner_counts(requests: DataFrame, partners: DataFrame, column: str, row_id: str):
    """Number of partners of every valid requested id, 0 included."""
    valid = request_ids(requests, column, row_id).where("is_valid")
    counts = partners.groupBy("cnpj_basico").agg(F.count("*").alias("total_partners"))
    joined = lookup(valid.select(row_id, column, "cnpj_basico"), counts, ["cnpj_basico"], [row_id])
    return joined.select(row_id, column, F.coalesce("total_partners", F.lit(0)).alias("total_partners"))
