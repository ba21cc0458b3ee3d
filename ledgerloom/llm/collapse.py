"""Duplicates hidden by formatting (problem 7), found by progressive partition refinement.

Rows are first divided by what is cheap: the columns that must be equal and the number of letters and
digits of the text. Only classes with several records go on to a second division by the histogram of
letters and digits, and only what then still has company is brought into its costly normal form.
Classes are counted with map-side aggregation over fixed-size keys, so that a class of a third of all
rows is no more work for one task than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

PARTS = r"~~|\||;"
_NOISE = r"[^\p{L}\p{N}]"


def stripped(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(text, _NOISE, ""))


def histogram(text: Column) -> Column:
    """How often each of a-z and 0-9 occurs in stripped text, and how long the rest of it is: does not
    depend on the order of the parts."""
    counts = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in "etaoinsrhldcum0123456789"]
    return F.concat_ws(",", *[c.cast("string") for c in counts])


def normal_form(text: Column, parts: str = PARTS) -> Column:
    """The parts of the text, each reduced to lower-case letters and digits, sorted; empty parts do not
    count."""
    return F.array_join(F.array_sort(F.filter(F.transform(F.split(text, parts), stripped), lambda p: p != "")), "~")


def _several(rows: DataFrame, keys: list[str], record: str, repeats: bool = False) -> DataFrame:
    """The keys that more than one record has, or with repeats more than one row."""
    if repeats:
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys)
    return rows.groupBy(*keys).agg(F.min(record).alias("_lo"), F.max(record).alias("_hi")).filter("_lo < _hi").select(*keys)


def classes(rows: DataFrame, record: str, text: str, equal: list[str], required: list[str], repeats: bool = False) -> DataFrame:
    """(record, _form, _e0...) of the rows that survive the refinement: those that may have a partner,
    with the normal form of their text and the columns that must be equal. With repeats another row of
    the same record is a partner too."""
    names = [f"_e{i}" for i in range(len(equal))]
    base = rows.select(F.col(record).alias("_r"), F.col(text).cast("string").alias("_t"), *[(F.col(c) + F.lit(0.0) if t in ("double", "float") else F.col(c)).alias(n) for c, n, t in zip(equal, names, [dict(rows.dtypes)[c] for c in equal])])
    for c in required:
        base = base.filter(F.col(names[equal.index(c)]).isNotNull())
    base = base.filter(F.col("_r").isNotNull() & F.col("_t").rlike(r"[\p{L}\p{N}]"))
    first = base.withColumn("_k1", F.xxhash64(*names, F.length(stripped(F.col("_t")))))
    # few rows are left after the first division: cut, so that the later ones do not read the records again
    kept = cut(first.join(_several(first, ["_k1"], "_r", repeats), "_k1", "left_semi"))
    second = kept.withColumn("_k2", F.xxhash64("_k1", histogram(stripped(F.col("_t")))))
    kept = second.join(_several(second, ["_k2"], "_r", repeats), "_k2", "left_semi")
    return kept.select("_r", *names, normal_form(F.col("_t")).alias("_form"))


def copies(rows: DataFrame, record: str = "transaction_id", text: str = "description_unmasked", equal: tuple[str, ...] = ("unique_mem_id", "amount", "transaction_date", "ledger_entry"), required: tuple[str, ...] = ("unique_mem_id",)) -> DataFrame:
    """(first, record, n_rows): for each record of a group of two or more, the smallest record of its
    group and the number of rows that carry it. The smallest itself is among them.

    Rows are of one group if the `equal` columns agree and the texts have the same parts, in whatever
    order and writing. NULL in a required column, a NULL text and a text without letters or digits put
    a row in no group; NULLs in other equal columns agree with each other. Repeated rows of one
    record count as rows of it. The last comparison is of the whole normal form, however long, so that
    a collision of hashes cannot join what differs. An empty table gives no rows; columns other than
    the named ones are not read.
    """
    kept = classes(rows, record, text, list(equal), list(required))
    keys = [c for c in kept.columns if c != "_r"]
    counted = cut(kept.groupBy(*keys, "_r").agg(F.count(F.lit(1)).alias("n_rows")))
    groups = counted.groupBy(*keys).agg(F.min("_r").alias("_first"), F.max("_r").alias("_last")).filter("_first < _last").drop("_last")
    on = None
    for c in keys:
        same = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        on = same if on is None else on & same
    return counted.alias("a").join(groups.alias("b"), on).select(F.col("_first").alias("first"), F.col("_r").alias(record), "n_rows").distinct()


def copy_pairs(rows: DataFrame, record: str = "transaction_id", **how) -> DataFrame:
    """(first_<record>, record) for each record of a group but its smallest."""
    return copies(rows, record, **how).filter(F.col("first") < F.col(record)).select(F.col("first").alias(f"first_{record}"), record).distinct()


def collapsed(rows: DataFrame, record: str = "transaction_id", text: str = "description_unmasked", equal: tuple[str, ...] = ("unique_mem_id", "amount", "transaction_date", "ledger_entry"), required: tuple[str, ...] = ("unique_mem_id",)) -> DataFrame:
    """(record, n_records, n_rows) of the collapsed table: for each group of rows, as copies() groups them, its
    smallest record, how many records it has and how many rows carry them. Rows of one record that was
    delivered again are copies as well. A row without copies, or that copies() puts in no group, is
    a group of its own. Groups with the same smallest record are added up. Rows without a record are
    left out."""
    kept = classes(rows, record, text, list(equal), list(required), repeats=True)
    keys = [c for c in kept.columns if c != "_r"]
    counted = cut(kept.groupBy(*keys, "_r").agg(F.count(F.lit(1)).alias("_n")))
    groups = counted.groupBy(*keys).agg(F.min("_r").alias("_r"), F.count(F.lit(1)).alias("_k"), F.sum("_n").alias("_n")).filter("_n > 1").select(*keys, "_r", "_k", "_n")
    on = None
    for c in keys:
        same = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        on = same if on is None else on & same
    inside = counted.alias("a").join(groups.select(*keys).alias("b"), on, "left_semi").groupBy("_r").agg((-F.sum("_n")).alias("_n"))
    # a row that is in no group of two or more stands for itself
    alone = rows.filter(F.col(record).isNotNull()).groupBy(F.col(record).alias("_r")).agg(F.count(F.lit(1)).alias("_n")).unionByName(inside).groupBy("_r").agg(F.sum("_n").alias("_n")).filter("_n > 0")
    every = groups.select("_r", "_k", "_n").unionByName(alone.select("_r", F.col("_n").alias("_k"), "_n"))
    return every.groupBy(F.col("_r").alias(record)).agg(F.sum("_k").alias("n_records"), F.sum("_n").alias("n_rows"))
