"""Preparing labelled rows: filling, dropping, splitting, mapping and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import sized_broadcast


def fill_primary(df: DataFrame, primary: str, secondary: str) -> DataFrame:
    """The primary description, or the secondary one where it is empty; NULL counts as empty."""
    a, b = F.coalesce(F.col(primary), F.lit("")), F.coalesce(F.col(secondary), F.lit(""))
    return df.withColumn(primary, F.when(a == "", b).otherwise(a))


def both_empty(primary: str, secondary: str) -> Column:
    return (F.coalesce(F.col(primary), F.lit("")) == "") & (F.coalesce(F.col(secondary), F.lit("")) == "")


def drop_empty(df: DataFrame, primary: str, secondary: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a description, rows without)."""
    return df.filter(~both_empty(primary, secondary)), df.filter(both_empty(primary, secondary))


def by_ledger(df: DataFrame, ledger: str) -> dict[str, DataFrame]:
    return {side: df.filter(F.lower(F.col(ledger)) == side) for side in ("credit", "debit")}


def row_numbers(df: DataFrame, order: list[str], buckets: int = 64, out: str = "row_no") -> DataFrame:
    """Numbers rows from 0 by `order` without gathering them in one task: rows are range partitioned,
    numbered inside each partition, and shifted by the sizes of the partitions before (one small
    row per partition)."""
    spread = df.repartitionByRange(buckets, *order).withColumn("_p", F.spark_partition_id())
    inside = spread.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = spread.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    shifts = sizes.withColumn("_s", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_s")
    return inside.join(F.broadcast(shifts), "_p").withColumn(out, F.col("_n") + F.col("_s") - 1).drop("_p", "_n", "_s")


def map_labels(df: DataFrame, labels: DataFrame, on: str, label: str = "label") -> DataFrame:
    """Inner join with a label map (label, label_num, ...): rows whose label the map lacks are dropped."""
    return df.join(sized_broadcast(labels.withColumnRenamed(label, on)), on)


def reverse_map(labels: DataFrame, number: str, label: str) -> DataFrame:
    """label -> number; of several numbers with one label the last wins."""
    return labels.groupBy(label).agg(F.max(number).alias(number))


def hash_share(key: Column) -> Column:
    """A number in [0, 1) by the md5 of the key: the same on every run and in every engine."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def hash_split(df: DataFrame, key: str, train: float = 0.9, out: str = "part") -> DataFrame:
    return df.withColumn(out, F.when(hash_share(F.col(key)) <= train, "train").otherwise("test"))


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """The chance of each row in a batch drawn half uniformly and half by first drawing a class. Class
    sizes come from one aggregation and are joined by label; there are as many as classes."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    classes = df.agg(F.count_distinct(label)).scalar()
    # NULL labels are no class and keep the uniform half
    return df.join(sized_broadcast(sizes), label, "left").withColumn(out, F.lit(0.5) / total + F.coalesce(F.lit(0.5) / (classes * F.col("_n")), F.lit(0.0))).drop("_n")


def batch_of(number: Column, size: int) -> Column:
    """The batch a row number falls into; sizes below 1 count as 1."""
    return F.floor(number / F.lit(max(1, size))).cast("long")


def exact_sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows without replacement (a top-k of seeded random numbers)."""
    return df.withColumn("_r", F.rand(seed)).orderBy("_r").limit(n).drop("_r")


def shuffled(df: DataFrame, seed: int, out: str = "position") -> DataFrame:
    """A random order of all rows: their positions from 0 by seeded random numbers, numbered in parts."""
    return row_numbers(df.withColumn("_r", F.rand(seed)), ["_r"], out=out).drop("_r")


def numeric_order(text: Column) -> Column:
    """What text of digits is sorted by: as numbers of any length, other text behind, by itself."""
    digits = text.rlike("^[0-9]+$")
    bare = F.regexp_replace(text, "^0+", "")
    return F.struct((~digits).cast("int"), F.when(digits, F.length(bare)).otherwise(0), F.when(digits, bare).otherwise(text))


def with_fields(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renames attributes by a field -> label map; other columns are left out."""
    return df.select([F.col(f).alias(n) for f, n in names.items()])


def needs_search(query: Column) -> Column:
    """Queries of one or two word characters are not searched."""
    return ~((F.length(query) <= 2) & query.rlike("^[a-zA-Z0-9_]+$"))
