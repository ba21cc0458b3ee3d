"""Gates that data must pass before it is used for training."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class QualityError(ValueError):
    """Data or configuration that fails a gate."""


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def small_classes(counts: DataFrame, least: int) -> DataFrame:
    return counts.filter(F.col("n") < least)


def duplicate_names(df: DataFrame, name: str, key: str) -> DataFrame:
    """Names that several keys have, with their number and the smallest and largest key (a list of all
    keys would not be bounded)."""
    return df.groupBy(F.col(name).alias("name")).agg(F.count_distinct(key).alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key")).filter("n > 1")


def label_differences(data: DataFrame, listed: DataFrame, label: str) -> DataFrame:
    """Labels of the data that the list lacks, and listed labels without data."""
    a, b = data.select(label).filter(F.col(label).isNotNull()).distinct(), listed.select(label).filter(F.col(label).isNotNull()).distinct()
    missing = a.join(b, label, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(b.join(a, label, "left_anti").withColumn("side", F.lit("extra")))


def size_gate(df: DataFrame, recorded: int, null_class: str | None = None, recorded_null: int | None = None) -> DataFrame:
    """How far the size of a data set (and of its class of unlabelled rows) is from the recorded one:
    ok below 1 percent, warn below 5, critical from there."""
    empty = F.sum((F.coalesce(F.col(null_class), F.lit("")) == "").cast("long")) if null_class else F.lit(0).cast("long")
    out = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(empty, F.lit(0)).alias("n_null"))
    change = lambda c, r: F.abs(F.col(c) - r) / F.lit(float(r)) if r else F.lit(0.0)
    worst = F.greatest(change("n", recorded), change("n_null", recorded_null or 0))
    return out.withColumn("change", F.round(worst, 6)).withColumn("verdict", F.when(worst >= 0.05, "critical").when(worst >= 0.01, "warn").otherwise("ok"))


def check_header(df: DataFrame, expected: list[str]) -> None:
    if set(df.columns) != set(expected):
        raise QualityError(f"columns missing: {sorted(set(expected) - set(df.columns))}, not expected: {sorted(set(df.columns) - set(expected))}")


def _no_duplicates(pairs: list[tuple]) -> dict:
    out: dict = {}
    for key, value in pairs:
        if key in out:
            raise QualityError(f"duplicate key {key!r}")
        out[key] = value
    return out


def strict_json(path: str) -> dict:
    """A JSON object none of whose keys is given twice."""
    return json.loads(Path(path).read_text(encoding="utf-8"), object_pairs_hook=_no_duplicates)


def validate_config(config: dict, schema: dict[str, dict]) -> dict:
    """Checks an object against {name: {type, required, allowed, least, most, items}} and returns it; names that the
    schema lacks are refused. Raises QualityError naming every fault."""
    faults = [f"{name} is not expected" for name in config if name not in schema]
    for name, rule in schema.items():
        if name not in config:
            faults += [f"{name} is missing"] if rule.get("required", True) else []
            continue
        value = config[name]
        if "type" in rule and (not isinstance(value, rule["type"]) or isinstance(value, bool) and rule["type"] is not bool):
            faults.append(f"{name} has the wrong type")
            continue
        if "allowed" in rule and value not in rule["allowed"]:
            faults.append(f"{name} must be one of {sorted(map(str, rule['allowed']))}")
        if "least" in rule and value < rule["least"] or "most" in rule and value > rule["most"]:
            faults.append(f"{name} is out of range")
        if "items" in rule and not all(isinstance(v, rule["items"]) for v in value):
            faults.append(f"{name} has an item of the wrong type")
    if faults:
        raise QualityError("; ".join(faults))
    return config


def label_map_table(spark, labels: dict) -> DataFrame:
    """(label_num, label, category_all, category_by_ledger, cost, threshold) of a numbered label map
    whose values are names or objects."""
    if sorted(map(int, labels)) != list(range(1, len(labels) + 1)):
        raise QualityError("label numbers must run from 1 without gaps")
    rows = []
    for number, value in labels.items():
        value = value if isinstance(value, dict) else {"label": value}
        category = value.get("category")
        by_ledger = category if isinstance(category, dict) else None
        rows.append((int(number), value.get("label"), None if by_ledger else category, by_ledger, float(value.get("cost", 1.0)), None if value.get("threshold") is None else float(value["threshold"])))
    return spark.createDataFrame(rows, "label_num int, label string, category_all string, category_by_ledger map<string,string>, cost double, threshold double")


def category_of(ledger: str = "ledger_entry"):
    """The category of a label: by the ledger side where it differs, else the one for all."""
    return F.coalesce(F.try_element_at(F.col("category_by_ledger"), F.lower(F.col(ledger))), F.col("category_all"))
