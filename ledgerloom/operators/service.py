"""The service plan: which stages run for a request, the physical split before the search, label models by
ledger side, and the shape of what is returned."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import enrich, models
from .locate import locate

# The names of the services and the combinations that may be asked for.
SERVICES = ("bloom_filter", "search", "cnn_subtype", "cnn_category", "cnn_merchant")
COMBINATIONS = (
    ("cnn_merchant",),
    ("cnn_merchant", "bloom_filter"),
    ("cnn_merchant", "bloom_filter", "search"),
    ("cnn_subtype",),
    ("cnn_merchant", "cnn_subtype"),
    ("cnn_merchant", "cnn_subtype", "bloom_filter"),
)
#: Fields that physical rows have, '' where nothing is known.
PHYSICAL_FIELDS = ("chain_name", "confidence_score", "country", "fax_number", "latitude", "longitude", "neighbourhood", "phone_number", "postal_code", "source_merchant_id", "store_id", "street", "website")


def asked_for(services: Column, *names: str) -> Column:
    """Whether any of the named stages runs: all do where no service is listed."""
    listed = F.coalesce(services, F.array().cast("array<string>"))
    return (F.size(listed) == 0) | F.arrays_overlap(listed, F.array(*[F.lit(n) for n in names]))


def allowed_combination(services: Column) -> Column:
    """No service, or one of the combinations in any order."""
    listed = F.array_sort(F.array_distinct(F.coalesce(services, F.array().cast("array<string>"))))
    return (F.size(listed) == 0) | F.concat_ws(",", listed).isin([",".join(sorted(c)) for c in COMBINATIONS])


def stages(services: Column, skip_search: bool = False) -> dict[str, Column]:
    """The stages that run. A search that is asked for by name runs even where searching is switched off."""
    by_name = F.array_contains(F.coalesce(services, F.array().cast("array<string>")), "search")
    return {
        "runs_location": asked_for(services, "bloom_filter"),
        "runs_search": by_name if skip_search else asked_for(services, "search"),
        "runs_subtype": asked_for(services, "cnn_subtype"),
        "runs_category": asked_for(services, "cnn_category", "cnn_subtype"),
        "runs_merchant": asked_for(services, "cnn_merchant"),
    }


def routed_predict(members: dict[str, PipelineModel], df: DataFrame, route: Column, text: str, out: str, when: Column | None = None) -> DataFrame:
    """Adds the label and score of the model that the row is routed to; '' and NULL for rows that have no
    model or whose stage does not run. The rows are split by route, so that a model scores its own only."""
    kinds = {out: "string", f"{out}_score": "double"}
    routed = df.withColumn("_route", F.when(when if when is not None else F.lit(True), route))
    blank = [F.lit("").alias(out), F.lit(None).cast("double").alias(f"{out}_score")]
    done = routed.filter(~F.coalesce(F.col("_route").isin(list(members)), F.lit(False))).select(*df.columns, *blank)
    for name, model in members.items():
        scored = models.predict(model, routed.filter(F.col("_route") == name), text, out).withColumnRenamed("score", f"{out}_score")
        done = done.unionByName(scored.select(*df.columns, *kinds))
    return done


def classify(rows: DataFrame, key: str, registry: dict[str, dict[str, PipelineModel]], merchants: DataFrame, cities: DataFrame, least_gap: float = 2.857, skip_search: bool = False) -> DataFrame:
    """The whole plan over rows (key, description, ledger_entry, container, services_list): one row each
    with what output() shapes.

    `registry` has models by stage and route: physical by container, subtype and category by
    'container_ledger', merchant by container; a stage or route without a model labels nothing. Only
    physical rows for which the search runs are searched. Rows without a description come out unlabelled.
    """
    base = cut(rows.withColumns(stages(F.col("services_list"), skip_search)).withColumn("description", F.coalesce("description", F.lit(""))))
    side = F.concat_ws("_", F.col("container"), F.lower("ledger_entry"))
    labelled = routed_predict(registry.get("physical", {}), base, F.col("container"), "description", "physical")
    labelled = routed_predict(registry.get("subtype", {}), labelled, side, "description", "subtype", F.col("runs_subtype"))
    labelled = routed_predict(registry.get("category", {}), labelled, side, "description", "category", F.col("runs_category"))
    labelled = cut(routed_predict(registry.get("merchant", {}), labelled, F.col("container"), "description", "merchant_label", F.col("runs_merchant")).withColumn("is_physical_merchant", F.col("physical") == "1"))
    places = cut(locate(labelled.filter("runs_location"), "description", cities))
    sought = labelled.filter("is_physical_merchant and runs_search").select(key, "description", "runs_location")
    known = places.select("description", F.col("city"), F.col("state"))
    found = enrich.find_merchants(sought.select(key, "description"), key, "description", merchants, cities, least_gap=least_gap, known_places=known)
    return assemble(labelled, key, places, found)


def assemble(labelled: DataFrame, key: str, places: DataFrame, found: DataFrame) -> DataFrame:
    """Joins labels, locations and search results into the fields of the output.

    Physical rows have the fields of PHYSICAL_FIELDS, blank unless the search found them; others lack them.
    Physical rows that were not searched come from 'OTHER' and match nothing. City and state are those
    of the location stage, blank without one; a located physical row is in the US. A merchant label
    overrides the name that the search found.
    """
    here = places.select("description", F.col("city").alias("_city"), F.col("state").alias("_state"), F.lit(True).alias("_located"))
    have = [c for c in found.columns if c in PHYSICAL_FIELDS]
    hits = found.select(key, F.lit(True).alias("_sought"), F.col("merchant").alias("_merchant"), "match_found", "source", F.col("category_labels").alias("_categories"), *[F.col(c).alias(f"_{c}") for c in have])
    joined = labelled.join(here, "description", "left").join(hits, key, "left")
    physical, located = F.col("is_physical_merchant"), F.coalesce(F.col("_located") & F.col("runs_location"), F.lit(False))
    blank = F.lit("")
    fields = {c: F.when(physical, F.coalesce(F.col(f"_{c}").cast("string") if c in have else blank, blank)) for c in PHYSICAL_FIELDS}
    fields["country"] = F.when(physical, F.when(located, "US").otherwise(F.coalesce("_country" if "country" in have else blank, blank)))
    split = F.split("subtype", " - ")
    return joined.select(
        key,
        "is_physical_merchant",
        F.when(located, F.col("_city")).otherwise("").alias("city"),
        F.when(located, F.col("_state")).otherwise("").alias("state"),
        F.when(F.col("merchant_label") != "", F.col("merchant_label")).otherwise(F.coalesce("_merchant", blank)).alias("merchant_name"),
        F.when(F.col("runs_subtype"), F.coalesce(F.get(split, 0), blank)).otherwise("").alias("txn_type"),
        F.when(F.col("runs_subtype"), F.coalesce(F.get(split, 1), blank)).otherwise("").alias("txn_sub_type"),
        F.when(F.col("category") != "", F.array("category")).otherwise(F.array().cast("array<string>")).alias("category_labels"),
        F.when(physical, F.coalesce("match_found", F.lit(False))).alias("match_found"),
        F.when(physical, F.coalesce("source", F.lit("OTHER"))).alias("source"),
        *[c.alias(n) for n, c in fields.items()],
        F.coalesce("merchant_label", blank).alias("_cnn_merchant"),
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(f"_{c}") for c in ("merchant_label_score", "subtype_score", "category_score")],
        F.coalesce("_merchant", blank).alias("_search_name"),
    )


def output(assembled: DataFrame, key: str, debug: bool = False) -> DataFrame:
    """(key, json): the record that is returned; NULL fields are left out. With debug the nested structs of
    search (physical rows only), location and label models are in it."""
    body = [c for c in assembled.columns if not c.startswith("_")]
    extra = []
    if debug:
        sought = ["street", "city", "country", "state", "postal_code", "source_merchant_id", "store_id", "latitude", "longitude", "website", "phone_number", "fax_number", "chain_name", "neighbourhood"]
        extra = [
            F.when(F.col("is_physical_merchant"), F.struct(F.col("_search_name").alias("merchant_name"), *sought)).alias("search"),
            F.struct("city", "state").alias("bloom_filter"),
            F.struct("txn_type", "txn_sub_type", F.col("_cnn_merchant").alias("merchant_name"), "category_labels", F.col("_merchant_label_score").alias("merchant_score"), F.col("_subtype_score").alias("subtype_score"), F.col("_category_score").alias("category_score")).alias("cnn"),
        ]
    return assembled.select(key, F.to_json(F.struct(*body, *extra)).alias("json"))


def response_faults(shaped: DataFrame, key: str) -> DataFrame:
    """(key, reason) of records that break the output schema: what every record must have, and what
    physical ones must have besides."""
    read = F.from_json("json", "is_physical_merchant boolean, city string, state string, merchant_name string, txn_type string, txn_sub_type string, match_found boolean, source string, " + ", ".join(f"{c} string" for c in PHYSICAL_FIELDS))
    r = lambda c: F.col(f"_r.{c}")
    always = [r(c).isNotNull() for c in ("is_physical_merchant", "city", "state", "merchant_name", "txn_type", "txn_sub_type")]
    physical = [r(c).isNotNull() for c in ("match_found", "source", *PHYSICAL_FIELDS)]
    every = lambda tests: F.array_min(F.array(*[t.cast("int") for t in tests])) == 1
    reason = F.when(F.col(key).isNull(), f"{key} is missing").when(~every(always), "a field of every record is missing").when(r("is_physical_merchant") & ~every(physical), "a field of physical records is missing")
    return shaped.withColumn("_r", read).withColumn("reason", reason).filter("reason is not null").select(key, "reason")
