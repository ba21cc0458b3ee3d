"""Looking records up by id, comparing two snapshots of a directory, and user context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DETAILS = ["place_name", "address", "locality", "region", "postcode"]


def known_id(ident: Column) -> Column:
    """Ids that can match: 'NULL' and blank never do."""
    return F.coalesce(ident, F.lit("")).isin("", "NULL") == F.lit(False)


def lookup(rows: DataFrame, directory: DataFrame, ident: str, columns: list[str]) -> DataFrame:
    """Left lookup by id with a found flag; columns of rows without a match are ''."""
    right = directory.filter(known_id(F.col(ident))).select(F.col(ident).alias("_id"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"found_{c}") for c in columns])
    out = rows.join(right, F.col(ident) == F.col("_id"), "left")
    blanks = {f"found_{c}": F.coalesce(F.col(f"found_{c}").cast("string"), F.lit("")) for c in columns}
    return out.withColumns(blanks).withColumn("merchant_found", F.coalesce("_hit", F.lit(False))).drop("_id", "_hit")


def blanked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.lit("") for c in columns})


def snapshot_difference(rows: DataFrame, ident: str, old: DataFrame, new: DataFrame, relinked: str | None = None) -> DataFrame:
    """Adds bucket: relinked, unlinked, null, id_changed, details_changed or unchanged, the first that
    applies. A record is id_changed if the new snapshot lacks its id."""
    side = lambda df, p: df.filter(known_id(F.col(ident))).select(F.col(ident).alias(f"{p}id"), F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in DETAILS]).alias(f"{p}d"))
    joined = rows.join(side(old, "_o"), F.col(ident) == F.col("_oid"), "left").join(side(new, "_n"), F.col(ident) == F.col("_nid"), "left")
    mark = F.col(relinked) if relinked else F.lit("")
    bucket = (
        F.when(F.coalesce(mark, F.lit("")) != "", "relinked")
        .when(F.coalesce(F.col(ident), F.lit("")) == "", "unlinked")
        .when(F.col(ident) == "NULL", "null")
        .when(F.col("_nid").isNull(), "id_changed")
        .when(~F.col("_od").eqNullSafe(F.col("_nd")), "details_changed")
        .otherwise("unchanged")
    )
    return joined.withColumn("bucket", bucket).drop("_oid", "_nid", "_od", "_nd")


def apply_decisions(rows: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Applies reviewed answers (key, answer, new_id): an id relinks, 'null' makes the row NULL, 'rm'
    removes it, 'skip' leaves it."""
    joined = rows.join(decisions, key, "left").filter(F.coalesce("answer", F.lit("")) != "rm")
    out = F.when(F.col("answer") == "null", "NULL").when(F.col("answer") == "link", F.col("new_id")).otherwise(F.lit(""))
    return joined.withColumn("relinked_id", out).drop("answer", "new_id")


def user_context(rows: DataFrame, user: str, value: str, position: list[str]) -> DataFrame:
    """(user, n_values, values): distinct values of a user in the order they first appeared. Repeats go
    before anything is gathered: a list is as long as a user's distinct values, not rows."""
    first = rows.filter(F.col(user).isNotNull() & (F.coalesce(F.col(value), F.lit("")) != "")).groupBy(user, value).agg(F.min(F.struct(*position)).alias("_p"))
    lists = first.groupBy(user).agg(F.array_sort(F.collect_list(F.struct("_p", F.col(value).alias("v")))).alias("_l"))
    return lists.select(user, F.size("_l").cast("long").alias("n_values"), F.array_join(F.transform("_l", lambda x: x["v"]), "; ").alias("values"))


def user_buckets(rows: DataFrame, user: str, key: str, size: int = 1000) -> DataFrame:
    """(user, bucket, n, ids_sum): rows of a user in buckets of about `size`, by hash, so that no user's
    rows have to come together in one place."""
    per_user = rows.filter(F.col(user).isNotNull()).groupBy(user).agg(F.count(F.lit(1)).alias("_n"))
    placed = rows.join(per_user, user).withColumn("bucket", F.pmod(F.xxhash64(key), F.greatest(F.ceil(F.col("_n") / F.lit(size)), F.lit(1))))
    return placed.groupBy(user, "bucket").agg(F.count(F.lit(1)).alias("n"))
