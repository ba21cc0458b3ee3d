"""The enrichment plan: location, directory search with acceptance and fallbacks, and output shape, as
one logical plan over transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut, sized_broadcast
from . import search
from .locate import locate
from .prep import needs_search

#: Boosts of the directory's fields in the main clause.
# Fixed values, as are the least gap 2.857 and the least score 1.0.
BOOSTS = {"place_name": 2.781, "address": 0.541, "address_extended": 1.282, "category_labels": 1.319, "chain_name": 0.999, "locality": 1.367, "region": 1.685, "postcode": 0.914, "tel": 0.597}
RESULT_SIZE = 45
#: Field of the directory -> attribute of the result.
OUTPUT = {"place_name": "merchant", "category_labels": "category_labels", "address": "street", "locality": "city", "country": "country", "region": "state", "postcode": "postal_code", "website": "website", "tel": "phone_number", "chain_name": "chain_name"}


def search_text(description: Column) -> Column:
    """What is sought: cleaned, synonyms replaced, cleaned again; NULL where it is too short."""
    sought = lambda clean: F.when(needs_search(clean), tx.clean_query(tx.replace_synonyms(clean)))
    return F.get(F.transform(F.array(tx.clean_query(description)), sought), 0)  # cleaned once


def noise_free_text(description: Column) -> Column:
    """The variant that also drops meaningless words before the synonyms."""
    clean = tx.clean_query(description)
    return F.when(needs_search(clean), tx.clean_query(tx.replace_synonyms(tx.strip_noise(clean))))


def clauses(queries: DataFrame, key: str, description: str, city: str | None = None, state: str | None = None, good: str | None = None, boosts: dict[str, float] | None = None) -> DataFrame:
    """The main clause over all boosted fields, a clause for town and state where they are known, and
    one for the name where a good description is given."""
    asked = queries.select(key, F.col(description).alias("_d"), *dict.fromkeys(c for c in (city, state, good) if c))
    base = cut(asked.withColumn("_q", search_text(F.col("_d"))).filter("_q is not null"))  # read for every clause, twice
    return _clauses(base, key, "_q", city, state, good, boosts)


def _clauses(base: DataFrame, key: str, text: str, city: str | None, state: str | None, good: str | None = None, boosts: dict[str, float] | None = None) -> DataFrame:
    out = search.clause(base, key, text, boosts or BOOSTS)
    for column, field, boost in ((city, "locality", 1.0), (state, "region", 1.0), (good, "place_name", 2.0)):
        if column:
            out = out.unionByName(search.clause(base.filter(F.col(column).isNotNull()), key, column, {field: boost}))
    return out


def _sought(rows: DataFrame, key: str, text: str, city: str, state: str, index: search.Index) -> DataFrame:
    """(key, sought, words, city, state) of the rows that have a text: `words` are those of its words that any
    document holds, `sought` is what tells queries apart. Texts that differ in other words only, as in
    numbers of payments, are one query."""
    known = sized_broadcast(index.docs.select(F.explode("cells.ts").alias("ts")).select(F.explode("ts").alias("term")).distinct())
    held = rows.select(key, F.explode(F.array_distinct(search.terms(F.col(text)))).alias("term")).join(known, "term", "left_semi")
    held = held.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("words"))
    asked = rows.filter(F.col(text).isNotNull()).select(key, F.coalesce(city, F.lit("")).alias(city), F.coalesce(state, F.lit("")).alias(state)).join(held, key, "left")
    return asked.withColumn("words", F.coalesce("words", F.lit(""))).withColumn("sought", F.concat_ws("\x1f", "words", city, state))


def with_everything(docs: DataFrame, fields: list[str], out: str = "everything") -> DataFrame:
    """Adds one field that holds the text of all fields, for queries that name none."""
    return docs.withColumn(out, F.concat_ws(" ", *[F.col(f).cast("string") for f in fields]))


def free_text_clauses(queries: DataFrame, key: str, text: str, name: str, address: str, everything: str = "everything") -> DataFrame:
    """The text in all fields together, a name given besides with four times the weight, and an address in
    the fields of the address with twice."""
    out = search.clause(queries.withColumn("_q", tx.clean_query(F.col(text))), key, "_q", {everything: 1.0})
    out = out.unionByName(search.clause(queries, key, name, {"place_name": 4.0}))
    return out.unionByName(search.clause(queries, key, address, dict.fromkeys(("address", "locality", "region", "postcode"), 2.0)))


def address_clauses(queries: DataFrame, key: str, columns: dict[str, str], more: list[tuple[str, list[str], float]] = ()) -> DataFrame:
    """A clause for each column in the field it stands for, the name with twice the weight, and further
    (column, fields, boost) clauses."""
    out = None
    for column, field in columns.items():
        part = search.clause(queries, key, column, {field: 2.0 if field == "place_name" else 1.0})
        out = part if out is None else out.unionByName(part)
    for column, fields, boost in more:
        out = out.unionByName(search.clause(queries, key, column, dict.fromkeys(fields, boost)))
    return out


def find_merchants(transactions: DataFrame, key: str, description: str, merchants: DataFrame, cities: DataFrame, merchant_key: str = "factual_id", least_gap: float = 2.857, least_score: float = 1.0, known_places: DataFrame | None = None) -> DataFrame:
    """One row per transaction with location, the best hits' facts, the decision and the enriched
    attributes. Rows that are too short to search, or have fewer than two hits, or whose best hit is
    a town, come out without a result."""
    places = locate(transactions, description, cities) if known_places is None else known_places
    located = transactions.join(places.withColumnRenamed("city", "_city").withColumnRenamed("state", "_state"), description, "left")
    rows = cut(located.withColumn("_q", search_text(F.col(description))))
    directory = search.index(merchants, merchant_key, list(BOOSTS))
    asked = cut(_sought(rows, key, "_q", "_city", "_state", directory))
    queries = cut(asked.drop(key).distinct())  # read for every clause, twice
    hits = search.best_hits(_clauses(queries, "sought", "words", "_city", "_state"), directory, RESULT_SIZE, first=2)
    best = cut(hits.first(2))
    two = search.top_two(best, merchants, merchant_key, ["place_name", "locality", "region"])
    top = best.filter("rank = 1").select("query", F.col("doc").alias(merchant_key)).join(merchants.select(merchant_key, *[f for f in OUTPUT], "longitude", "latitude"), merchant_key)
    names = sized_broadcast(cities.select(F.lower("canonical_city").alias("_town")).distinct())
    facts = hits.gaps().join(two, "query", "left").join(top, "query", "left").join(names, F.lower("place_name_1") == F.col("_town"), "left")
    joined = rows.join(asked.select(key, F.col("sought").alias("query")), key, "left").join(facts, "query", "left")
    found = (F.coalesce("n_hits", F.lit(0)) >= 2) & F.col("_town").isNull()
    match = found & search.accepted(F.col("gap"), F.col("top_score"), least_gap, least_score)
    blank = F.lit("")
    same_name = found & ~match & (F.col("place_name_1") == F.col("place_name_2"))
    city_named = found & ~match & F.coalesce(tx.contains_folded(F.col(description), F.col("locality_1")), F.lit(False))
    state_named = found & ~match & F.coalesce((F.col("region_1") == F.col("region_2")) & tx.contains_folded(F.col(description), F.col("region_1")), F.lit(False))
    taken = {n: F.when(match, F.coalesce(F.col(f).cast("string"), blank)).otherwise(blank) for f, n in OUTPUT.items()}
    taken["merchant"] = tx.capwords_if_upper(F.when(match, F.coalesce("place_name", blank)).when(F.coalesce(same_name, F.lit(False)), F.col("place_name_1")).otherwise(blank))
    taken["city"] = F.coalesce("_city", F.when(match, F.coalesce("locality", blank)).when(city_named, F.col("locality_1")).otherwise(blank))
    taken["state"] = F.coalesce("_state", F.when(match, F.coalesce("region", blank)).when(state_named, F.col("region_1")).otherwise(blank))
    taken["country"] = F.when(match & (F.coalesce("country", blank) != ""), F.col("country")).otherwise("US")
    point = {c: F.when(match, F.coalesce(tx.coordinate(F.col(c)), blank)).otherwise(blank).alias(c) for c in ("longitude", "latitude")}
    return joined.select(
        F.col(key), F.col(description), F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"), "top_score", "gap", F.coalesce(match, F.lit(False)).alias("match_found"),
        F.when(match, F.col(merchant_key)).alias("source_merchant_id"), *[c.alias(n) for n, c in taken.items()], *point.values(), F.when(match | ~found, "FACTUAL").otherwise("OTHER").alias("source"),
    )
