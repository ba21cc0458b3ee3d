"""Merging store numbers into a merchant directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import search

FIELDS = {"keywords": "place_name", "address": "address", "city": "locality", "state": "region", "zip5": "postcode"}


def match_stores(stores: DataFrame, merchants: DataFrame, key: str = "store_row", merchant_key: str = "factual_id", size: int = 45, least_gap: float = 0.95) -> DataFrame:
    """(store, n_hits, gap, merchant, matched): each store is sought with one clause per field; the best
    hit counts if its name holds the store's keywords and the gap is wide enough."""
    rows = stores.withColumn("zip5", F.substring("zip_code", 1, 5))
    clauses = None
    for column, field in FIELDS.items():
        part = search.clause(rows, key, column, {field: 1.0})
        clauses = part if clauses is None else clauses.unionByName(part)
    fields = list(FIELDS.values())
    hits = search.best_hits(clauses, search.index(merchants, merchant_key, fields), size, first=1)
    facts = hits.gaps()
    top = hits.first(1).select("query", F.col("doc").alias(merchant_key)).join(merchants.select(merchant_key, "place_name"), merchant_key)
    out = rows.select(key, "keywords").join(facts.withColumnRenamed("query", key), key, "left").join(top.withColumnRenamed("query", key), key, "left")
    holds = F.coalesce(F.contains(F.lower("place_name"), F.lower("keywords")), F.lit(False))
    matched = holds & F.coalesce(F.col("gap") > least_gap, F.lit(False))
    return out.select(key, "keywords", F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"), "gap", F.when(matched, F.col(merchant_key)).alias(merchant_key), matched.alias("matched"))


def update_directory(merchants: DataFrame, matches: DataFrame, stores: DataFrame, key: str = "store_row", merchant_key: str = "factual_id", number: str = "aggdata_store_number") -> DataFrame:
    """A new snapshot of the directory with store numbers filled in; of several stores matched to one
    merchant the last one that has a number counts."""
    numbers = matches.filter("matched").join(stores.select(key, F.col(number).alias("_number")).filter("_number is not null"), key)
    newest = numbers.groupBy(merchant_key).agg(F.max_by("_number", key).alias("_number"))
    return merchants.join(newest, merchant_key, "left").withColumn("internal_store_number", F.coalesce("_number", F.lit(""))).drop("_number")


def merged_percent(matches: DataFrame, by: str = "keywords") -> DataFrame:
    n = F.count(F.lit(1))
    hit = F.sum(F.col("matched").cast("long"))
    return matches.groupBy(by).agg(n.alias("n_stores"), hit.alias("n_matched"), F.round(hit * 100.0 / n, 6).alias("percent_merged"))
