"""Same postal address written differently (problem 6).

Each record is read into number, direction, street, type, unit and town, in the words as they were
written. Records with the same reading form one class, which stands for all of them from then on.
Candidates are pairs of classes of one town and number that share a MinHash band over the street's token
and q-gram shingles; a candidate is verified by affine-gap alignment of its tokens, where a word
costs little for another form of it in the dictionaries of abbreviations, misspelt words of the street cost by
weighted edits, parts left out a gap, and parts that differ more than any match may cost. The cost of the
whole alignment decides. Only then are the classes expanded to the records.

A town is told by city and state through the gazetteer; where the city is missing or stands in two
states, by what most records of the same postcode say, counted over all records and over further tables
where they are given. Where none says anything the postcode itself stands for the town.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bounded_rows, cut
from .canonical import Entry, Towns
from .places import SAME, Place, read_place, same_location, street_bands, town_key, zip5

PARTS = ["number", "direction", "street", "kind", "unit"]
#: Towns that a gazetteer may have; it goes to every worker.
MOST_TOWNS = 100_000


def gazetteer(cities: DataFrame, ident: str = "city_id", name: str = "canonical_city", state: str = "state") -> list[Entry]:
    rows = bounded_rows(cities.select(F.col(ident).alias("i"), F.col(name).alias("n"), F.col(state).alias("s")).filter("i is not null and n is not null"), MOST_TOWNS, "the gazetteer")
    return sorted((Entry(int(r.i), r.n, r.s) for r in rows), key=lambda e: e.ref_id)


@lru_cache(maxsize=1)
def _towns(entries: tuple[Entry, ...]) -> Towns:
    """The dictionary of the gazetteer with the towns found so far, which a worker keeps from task to task."""
    return Towns(list(entries))


def read_places(df: DataFrame, key: str, address: str, city: str, state: str, postcode: str, entries: list[Entry], keep: tuple[str, ...] = (), tidy: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """(_k, number, direction, street, kind, unit, town, zip5, _keep0...) of every record. town is
    '' where only the postcode may tell it. `tidy` is applied to the rows in the same pass."""
    kinds = dict(df.dtypes)
    kept = [f"_keep{i}" for i in range(len(keep))]
    slim = df.select(F.col(key).alias("_k"), *[F.col(c).cast("string").alias(a) for c, a in zip((address, city, state, postcode), ("_a", "_c", "_s", "_z"))], *[F.col(c).alias(n) for c, n in zip(keep, kept)])
    names = [*PARTS, "town", "zip5"]
    schema = f"`_k` {kinds[key]}, " + ", ".join(f"{n} string" for n in names) + "".join(f", {n} {kinds[c]}" for n, c in zip(kept, keep))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        towns = _towns(tuple(entries))
        for frame in frames:
            got = [read_place(a, c, s, z, towns) for a, c, s, z in zip(*(frame[x].where(frame[x].notna(), None) for x in ("_a", "_c", "_s", "_z")))]
            out = pd.DataFrame([(p.number, p.direction, p.street, p.kind, p.unit, p.town, p.zip5) for p in got], columns=names, index=frame.index)
            rows = pd.concat([frame[["_k"]], out, frame[kept]], axis=1)
            yield tidy(rows) if tidy else rows

    return slim.mapInPandas(read, schema)


def told_towns(df: DataFrame, city: str, state: str, postcode: str, entries: list[Entry]) -> DataFrame:
    """(zip5, town) of the records of a further table that give both, read from their distinct values."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        towns = _towns(tuple(entries))
        for f in frames:
            told = [(zip5(z), town_key(c, (s or "").strip().lower(), towns) if c else "", n) for c, s, z, n in zip(*(f[x].where(f[x].notna(), None) for x in ("_c", "_s", "_z")), f["_n"])]
            yield pd.DataFrame(told, columns=["zip5", "town", "n"])

    slim = df.groupBy(*[F.col(c).cast("string").alias(a) for c, a in zip((city, state, postcode), ("_c", "_s", "_z"))]).agg(F.count(F.lit(1)).alias("_n"))
    return slim.mapInPandas(read, "zip5 string, town string, n bigint")


def zip_towns(read: DataFrame, further: DataFrame | None = None) -> DataFrame:
    """(zip5, zip_town): the town that most records of a postcode name."""
    counted = read.groupBy("zip5", "town").agg(F.count(F.lit(1)).alias("n"))
    if further is not None:
        counted = counted.unionByName(further)
    told = counted.filter("zip5 <> '' and town like 't:%'").groupBy("zip5", "town").agg(F.sum("n").alias("n"))
    return told.groupBy("zip5").agg(F.max_by("town", F.struct("n", "town")).alias("zip_town"))


def with_towns(read: DataFrame, by_zip: DataFrame) -> DataFrame:
    """Fills the towns that city and state leave open."""
    by_code = F.when(F.col("zip5") != "", F.concat(F.lit("z:"), "zip5")).otherwise("")
    return read.join(by_zip, "zip5", "left").withColumn("town", F.when(F.col("town") != "", F.col("town")).otherwise(F.coalesce("zip_town", by_code))).drop("zip_town")


def reading():
    """The reading of a record as one string; parts hold no '|'."""
    return F.concat_ws("|", "town", *PARTS)


def _place(loc: str) -> Place:
    town, number, direction, street, kind, unit = loc.split("|")
    return Place(number, direction, street, kind, unit, town)


@F.pandas_udf(T.BooleanType())
def verified(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_location(_place(x), _place(y)) for x, y in zip(a, b)], dtype=bool)


@F.pandas_udf(T.ArrayType(T.LongType()))
def bands(streets: pd.Series) -> pd.Series:
    return pd.Series([list(street_bands(x)) for x in streets])


def location_candidates(locs: DataFrame) -> DataFrame:
    """(la, lb) of the distinct readings (loc, side) that may denote the same place: each pair once, or
    where `side` is not NULL every la of side 0 with every lb of side 1, equal readings included.

    Readings without another one of their town and number have no partner and get no bands. Candidates
    share a band within town and number; a band key that many readings share is an address written in
    as many ways. Streets whose lengths differ by more than the alignment allows are no candidates.
    """
    part = lambda i: F.split("loc", "[|]")[i]
    keyed = locs.withColumn("block", F.xxhash64(part(0), part(1)))
    company = keyed.groupBy("block").agg(F.count(F.lit(1)).alias("_n"), F.min("side").alias("_lo"), F.max("side").alias("_hi")).filter("_n > 1 and (_lo is null or _lo < _hi)").select("block")
    held = cut(keyed.join(company, "block", "left_semi").withColumn("id", F.monotonically_increasing_id()))
    hashed = held.select("id", "side", "block", F.posexplode(bands(part(3))).alias("_i", "_h")).select("id", "side", F.xxhash64("block", "_i", "_h").alias("band_key"))
    one, other = hashed.select(F.col("id").alias("i"), F.col("side").alias("si"), "band_key"), hashed.select(F.col("id").alias("j"), F.col("side").alias("sj"), "band_key")
    facing = (F.col("si") < F.col("sj")) | (F.col("si").isNull() & F.col("sj").isNull() & (F.col("i") < F.col("j")))
    pairs = one.join(other, "band_key").filter(facing).select("i", "j").distinct()
    texts = pairs.join(held.select(F.col("id").alias("i"), F.col("loc").alias("a")), "i").join(held.select(F.col("id").alias("j"), F.col("loc").alias("b")), "j")
    street = lambda c: F.length(F.replace(F.split(c, "[|]")[3], F.lit(" "), F.lit("")))
    # an edit that changes the length costs 0.6 at least
    return texts.filter(F.abs(street("a") - street("b")) * 0.6 <= SAME).select(F.col("a").alias("la"), F.col("b").alias("lb"))


def location_links(locs: DataFrame) -> DataFrame:
    """(la, lb) of the distinct readings (loc) that denote the same place, each pair once."""
    return location_candidates(locs.select("loc", F.lit(None).cast("int").alias("side"))).filter(verified("la", "lb"))


def located_rows(df: DataFrame, cities: DataFrame, key: str = "store_row", address: str = "address", city: str = "city", state: str = "state", postcode: str = "zip_code", further: DataFrame | None = None) -> DataFrame:
    """(_k, loc) of the records whose location can be told. `further` has (city, state, postcode) of records
    of other tables, which help to tell the town of a postcode."""
    entries = gazetteer(cities)
    read = cut(read_places(df, key, address, city, state, postcode, entries))
    more = None if further is None else told_towns(further, *further.columns[:3], entries)
    return with_towns(read, zip_towns(read, more)).filter("town <> '' and number <> '' and street <> ''").select("_k", reading().alias("loc"))


def same_address_pairs(df: DataFrame, cities: DataFrame, key: str = "store_row", **columns) -> DataFrame:
    """(<key>_a, <key>_b), a < b, of all records at the same building number, street and town.

    Parts left out of one record do not matter; numbers, directions, street types and units that both
    give and that differ do. A record without number, street or town (told by city, state, postcode or
    the end of the address) matches nothing, and so does a NULL or blank address. Repeated keys are
    paired once and never with themselves. An empty table gives no rows; other columns are not read.
    The result has as many rows as there are pairs; address_classes() is the form whose size follows
    the records.
    """
    rows = cut(located_rows(df, cities, key, **columns).distinct())
    links = location_links(rows.select("loc").distinct())
    both = links.select(F.col("la").alias("a"), F.col("lb").alias("b")).union(rows.select(F.col("loc").alias("a"), F.col("loc").alias("b")).distinct())
    left, right = rows.select(F.col("_k").alias("_ka"), F.col("loc").alias("a")), rows.select(F.col("_k").alias("_kb"), F.col("loc").alias("b"))
    pairs = left.join(both, "a").join(right, "b").filter((F.col("a") != F.col("b")) | (F.col("_ka") < F.col("_kb"))).filter(F.col("_ka") != F.col("_kb"))
    return pairs.select(F.least("_ka", "_kb").alias(f"{key}_a"), F.greatest("_ka", "_kb").alias(f"{key}_b")).distinct()


def address_classes(df: DataFrame, cities: DataFrame, key: str = "store_row", **columns) -> DataFrame:
    """(key, location, n_copies, n_links): one row per record with its reading, the number of records
    of the same reading and the number of other readings of the same place; copies are not paired."""
    rows = cut(located_rows(df, cities, key, **columns).distinct())
    links = location_links(rows.select("loc").distinct())
    degree = links.select(F.col("la").alias("loc")).union(links.select(F.col("lb").alias("loc"))).groupBy("loc").agg(F.count(F.lit(1)).alias("n_links"))
    copies = rows.groupBy("loc").agg(F.count(F.lit(1)).alias("n_copies"))
    return rows.join(copies, "loc").join(degree, "loc", "left").select(F.col("_k").alias(key), F.col("loc").alias("location"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
