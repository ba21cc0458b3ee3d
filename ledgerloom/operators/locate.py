"""City and state out of a description, without word boundaries to rely on.

The text is squeezed to capitals without blanks and punctuation. Every place where a state's letters
stand may end a location; of what stands before it the lengths of those towns of the state that end in
the same three letters are looked up in the gazetteer. The rightmost state wins, then the longest town.
If none fits exactly, a state at the end of the text or before a token may follow a town whose last
one to four letters were cut off, if eight letters of it are left.

Candidates are exploded and joined with the gazetteer's keys; the winner is an aggregation per text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bare_upper, city_short_forms, token_starts
from ..session import cut, sized_broadcast

# The codes that count as states.
STATES = tuple(
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split()
)
# Words that begin with a state's letters and are no state.
NOT_STATES = (
    "CARD", "CAR", "MDEBIT", "MINEDEBIT", "CTDI", "RIVER", "WILD", "WINGS", "MONTHLY", "MONTH", "MOUNTAIN", "INN", "PAR", "PARDEBIT",
    "PARK", "PACIFIC", "PAYMENT", "PAY", "MAIL", "IAS", "DEBIT", "COMPANY", "COUNTY",
)
LEAST_CITY, LEAST_CUT, MOST_CUT = 3, 8, 4


def gazetteer_keys(cities: DataFrame, city: str, state: str) -> DataFrame:
    """(key, kind, city, state): kind 1 for whole names in every short form, 2 for names cut by one to
    four letters. Of several towns with one key the shortest name, then the first, stands."""
    forms = cities.filter(F.upper(F.col(state)).isin(*STATES)).select(F.upper(F.col(state)).alias("st"), F.col(city).alias("city"), F.explode(city_short_forms(F.col(city))).alias("form"))
    squeezed = forms.withColumn("form", bare_upper(F.col("form"))).filter(F.length("form") >= LEAST_CITY)
    whole = squeezed.select(F.concat("st", "form").alias("key"), F.lit(1).alias("kind"), "city", "st", F.length("form").alias("n"), "form")
    cut = squeezed.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(MOST_CUT)))).filter(F.length("form") - F.col("c") >= LEAST_CUT)
    cut = cut.select(F.concat("st", F.substr("form", F.lit(1), F.length("form") - F.col("c"))).alias("key"), F.lit(2).alias("kind"), "city", "st", F.length("form").alias("n"), "form")
    return whole.unionByName(cut).groupBy("key", "kind").agg(F.min_by(F.struct("city", "st"), F.struct("n", "form", "city")).alias("v")).select("key", "kind", "v.city", F.col("v.st").alias("state"))


def endings(keys: DataFrame) -> DataFrame:
    """(ending, lengths): the state and last letters of the gazetteer's keys, with the lengths of the towns
    that end so."""
    return keys.groupBy(F.concat(F.substring("key", 1, 2), F.substring("key", -LEAST_CITY, LEAST_CITY)).alias("ending")).agg(F.collect_set(F.length("key") - 2).alias("lengths"))


def candidates(df: DataFrame, text: str, ends: DataFrame) -> DataFrame:
    """(text, i, j, key, free, closed, begins) for every state position i and start j of a town that ends as
    one of the gazetteer's."""
    # a fixed number of partitions: what is exploded below is more than what adaptive execution sees
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = df.select(F.col(text).alias("text")).filter(F.col("text").isNotNull()).repartition(n, "text").distinct()
    plain = F.regexp_replace("text", "(?i) co id:", "")
    base = base.select("text", bare_upper(plain).alias("t"), token_starts(plain).alias("b"))
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.length("t") - 2, F.lit(0))), lambda i: F.substr("t", i + 1, F.lit(2)).isin(*STATES))
    rows = base.filter(F.length("t") >= LEAST_CITY + 2).select("text", "t", "b", F.explode(at).alias("i"))
    following = F.array_min(F.filter("b", lambda p: p > F.col("i")))
    word = F.expr("substring(t, i + 1, nxt - i)")
    rows = rows.withColumn("nxt", following).withColumn("free", ~F.array_contains("b", F.col("i") + 1) & ~F.coalesce(word.isin(*NOT_STATES), F.lit(False)))
    rows = rows.withColumn("closed", (F.col("i") == F.length("t") - 2) | F.array_contains("b", F.col("i") + 2)).filter((F.col("free") | F.col("closed")) & (F.col("i") >= LEAST_CITY))
    rows = rows.withColumn("ending", F.expr(f"concat(substring(t, i + 1, 2), substring(t, i - {LEAST_CITY - 1}, {LEAST_CITY}))")).join(ends, "ending")
    rows = rows.withColumn("j", F.explode(F.transform("lengths", lambda n: F.col("i") - n))).filter("j >= 0")
    return rows.select("text", "i", "j", F.expr("concat(substring(t, i + 1, 2), substring(t, j + 1, i - j))").alias("key"), "free", "closed", F.array_contains("b", F.col("j")).alias("begins"))


def locate(df: DataFrame, text: str, cities: DataFrame, city: str = "canonical_city", state: str = "state") -> DataFrame:
    """(text, city, state), one row per distinct text that names a town. NULL and short texts name none."""
    keys = cut(gazetteer_keys(cities, city, state))  # read five times
    ends = sized_broadcast(endings(keys))
    keys = sized_broadcast(keys)
    exact = keys.filter("kind = 1").select(F.col("key").alias("alt"), F.struct("city", "state").alias("alt_place"))
    hits = candidates(df, text, ends).join(keys, "key").filter(((F.col("kind") == 1) & F.col("free")) | ((F.col("kind") == 2) & F.col("closed") & (F.length("key") >= LEAST_CUT + 2)))
    # a first letter that is a direction but no word of its own may belong to the word before
    stray = F.substring("key", 3, 1).isin("E", "W", "S", "N") & ~F.col("begins") & (F.col("kind") == 1)
    hits = hits.withColumn("alt", F.when(stray, F.concat(F.substring("key", 1, 2), F.substr("key", F.lit(4)))))
    hits = hits.join(sized_broadcast(exact), "alt", "left").withColumn("place", F.coalesce("alt_place", F.struct("city", "state")))
    best = hits.groupBy("text").agg(F.min_by("place", F.struct("kind", -F.col("i"), "j")).alias("p"))
    return best.select(F.col("text").alias(text), "p.city", "p.state")
