"""Documents of the directory made of delivered rows: blank cells, points, regions, composite and dispersed
fields."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import coordinate


def without_blanks(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Empty cells become NULL, so that the document lacks the field. Cells of blanks only are kept."""
    names = columns or [c for c, t in df.dtypes if t == "string"]
    return df.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in names})


def sparse_json(df: DataFrame, columns: list[str], out: str = "document") -> DataFrame:
    """Adds the document as JSON with the fields that the row has."""
    return df.withColumn(out, F.to_json(F.struct(*[F.when(F.col(c).cast("string") != "", F.col(c)).alias(c) for c in columns])))


def with_point(df: DataFrame, longitude: str = "longitude", latitude: str = "latitude", out: str = "pin") -> DataFrame:
    """One point of two coordinates, which are dropped; NULL where either is missing or blank."""
    text = lambda c: coordinate(F.col(c)) if dict(df.dtypes)[c] == "double" else F.trim(F.col(c))
    lon, lat = text(longitude), text(latitude)
    both = (F.coalesce(lon, F.lit("")) != "") & (F.coalesce(lat, F.lit("")) != "")
    return df.withColumn(out, F.when(both, F.struct(F.lit("point").alias("type"), F.array(lon, lat).alias("coordinates")))).drop(longitude, latitude)


def with_region(df: DataFrame, region: str = "region", default: str = "XX") -> DataFrame:
    return df.withColumn(region, F.coalesce(F.nullif(F.trim(region), F.lit("")), F.lit(default)))


def composite(template: str, components: list[str]) -> Column:
    """A text made of columns by a template with places {0}, {1}, ... or {}; missing columns are '' and the
    result is trimmed."""
    order: list[int] = []

    def place(m: re.Match) -> str:
        order.append(int(m.group(1)) if m.group(1) else len(order))
        return "%s"

    pattern = re.sub(r"\{(\d*)\}", place, template.replace("%", "%%"))
    return F.trim(F.format_string(pattern, *[F.coalesce(F.col(components[i]).cast("string"), F.lit("")) for i in order]))


def dispersed(df: DataFrame, field: str, pattern: str) -> DataFrame:
    """Adds a column for each named group of a pattern, (?P<name>...), taken out of a field that matches
    it as a whole; NULL where it does not."""
    groups = re.compile(pattern).groupindex
    plain = re.sub(r"\(\?P<\w+>", "(", pattern)
    whole = rf"\A(?:{plain})\z"
    return df.withColumns({name: F.when(F.col(field).rlike(whole), F.regexp_extract(field, whole, i)) for name, i in groups.items()})


def children_of(children: DataFrame, parents: DataFrame, key: str, condition: Column) -> DataFrame:
    """The children of the parents that meet a condition; each once, whatever number of parents."""
    return children.join(parents.filter(condition).select(key).distinct(), key, "left_semi")


def adapted_requests(df: DataFrame, names: dict[str, str], order: list[str], ledger: str = "credit", buckets: int = 64) -> DataFrame:
    """Rows as a request wants them: numbered from 1 by `order`, fields renamed, one ledger side for all."""
    from .prep import row_numbers

    numbered = row_numbers(df, order, buckets)
    return numbered.select((F.col("row_no") + 1).alias("request_pos"), *[F.col(f).alias(n) for f, n in names.items()], F.lit(ledger).alias("ledger_entry"))
