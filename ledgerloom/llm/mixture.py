"""Mixing sources to target weights (problem 9).

Tokens are counted once and summed per source. With sizes S and shares p, a mixture of T tokens repeats
source s at the rate p_s T / S_s. T is what is asked for, or else the largest total for which no rate
exceeds its cap; where T is asked for and is larger, the sources at their caps fall short of their share.
A document is emitted floor(rate) times and once more with the probability of the rest, drawn from a
seeded hash of its id: the draw is the same on every run and every partitioning, does not depend on
other documents and needs no shuffle. As documents differ in length a draw misses its share, most where
a few long texts hold much of a source; what is reached is reported. With `draws` above 1 the draw of
every source is the nearest of so many seeds instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_rows, cut
from .tokens import DEFAULT_VOCABULARY, with_counts

#: Sources that a mixture may have; their rates are broadcast.
MOST_SOURCES = 10_000


def source_sizes(counted: DataFrame, source: str = "source") -> DataFrame:
    """(source, n_docs, tokens) of a table with n_tokens."""
    return counted.groupBy(source).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens"))


def repetition_rates(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """The rate of each source for a mixture of `total` tokens, or of as many as the caps allow without
    missing a share. No rate exceeds its cap. Sources that have a target but no tokens cannot be repeated into one:
    their share is left open and the others keep their proportions among themselves. Sources without a
    positive target or cap are left out (rate 0)."""
    usable = {s: (p, c) for s, (p, c) in targets.items() if p and p > 0 and c and c > 0 and sizes.get(s, 0) > 0}
    if not usable:
        return {}
    whole = sum(p for p, _ in usable.values())
    total = min(c * sizes[s] / p for s, (p, c) in usable.items()) if total is None else total / whole
    return {s: min(float(c), p * total / sizes[s]) for s, (p, c) in usable.items()}


def copies_column(key: Column, rate: Column, seed: Column) -> Column:
    """floor(rate) plus one with the probability of the fraction, by a hash of (seed, key)."""
    draw = F.pmod(F.xxhash64(seed, key), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def _targets(targets: DataFrame, source: str, share: str, cap: str) -> dict[str, tuple[float, int]]:
    """A source listed twice counts with the sum of its shares and its smallest cap."""
    grouped = targets.filter(F.col(source).isNotNull()).groupBy(source).agg(F.sum(share).alias("p"), F.min(cap).alias("c"))
    return {r[0]: (r.p, r.c) for r in bounded_rows(grouped, MOST_SOURCES, "the targets")}


def rate_table(counted: DataFrame, targets: DataFrame, key: str, source: str, share: str, cap: str, total: float | None, seed: int, draws: int) -> DataFrame:
    """(source, _rate, _seed) of each source that has a target; at most MOST_SOURCES rows."""
    goal = _targets(targets, source, share, cap)
    wanted = counted.filter(F.col(source).isin(list(goal)))
    sizes = {r[source]: r.tokens for r in bounded_rows(source_sizes(wanted, source), MOST_SOURCES, "the sources")}
    rates = repetition_rates(sizes, goal, total)
    spark = counted.sparkSession
    nearest = dict.fromkeys(rates, 0)
    if draws > 1:
        plain = F.broadcast(spark.createDataFrame(list(rates.items()), f"`{source}` string, _rate double"))
        sums = [F.sum(F.col("n_tokens") * copies_column(F.col(key), F.col("_rate"), F.lit(seed + i))).alias(f"s{i}") for i in range(draws)]
        for r in bounded_rows(wanted.join(plain, source).groupBy(source).agg(*sums), MOST_SOURCES, "the sources"):
            nearest[r[source]] = min(range(draws), key=lambda i, r=r: abs(r[f"s{i}"] - rates[r[source]] * sizes[r[source]]))
    return spark.createDataFrame([(s, q, seed + nearest[s]) for s, q in rates.items()], f"`{source}` string, _rate double, _seed int")


def _slim(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    return docs.select(F.col(key), F.col(source), F.col(text)).filter(F.col(text).isNotNull() & (F.col(text) != ""))


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = DEFAULT_VOCABULARY, seed: int = 13, share: str = "target_share", cap: str = "max_repeats", total: float | None = None, draws: int = 1) -> DataFrame:
    """The mixture: (key, source, copy_no, text), one row per copy, copies numbered from 1.

    NULL and empty texts have no tokens and are never emitted; rows without source or with a source that
    has no target are left out; no text is used more often than its source's cap. An empty table or
    empty targets give no rows. Other columns are not read. Repeated keys are drawn alike. Texts are
    tokenized once, for the sizes; the emission needs the id only.
    """
    slim = _slim(docs, key, text, source)
    counted = with_counts(slim, text, vocabulary=vocabulary).select(key, source, "n_tokens")
    rates = rate_table(cut(counted) if draws > 1 else counted, targets, key, source, share, cap, total, seed, draws)
    copies = slim.join(F.broadcast(rates), source).withColumn("_copies", copies_column(F.col(key), F.col("_rate"), F.col("_seed")))
    return copies.filter("_copies > 0").select(key, source, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy_no"), text)


def shares(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = DEFAULT_VOCABULARY, seed: int = 13, share: str = "target_share", cap: str = "max_repeats", total: float | None = None, draws: int = 1) -> DataFrame:
    """What the mixture reaches: (source, target_share, rate, n_docs, n_emitted, max_copies, tokens,
    mixed_tokens, share), one row per source with a target."""
    counted = cut(with_counts(_slim(docs, key, text, source), text, vocabulary=vocabulary).drop(text))
    rates = rate_table(counted, targets, key, source, share, cap, total, seed, draws)
    planned = counted.join(F.broadcast(rates), source).withColumn("_copies", copies_column(F.col(key), F.col("_rate"), F.col("_seed")))
    by_source = planned.groupBy(source).agg(
        F.first("_rate").alias("rate"),
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("_copies").alias("n_emitted"),
        F.max("_copies").alias("max_copies"),
        F.sum("n_tokens").alias("tokens"),
        F.sum(F.col("n_tokens") * F.col("_copies")).alias("mixed_tokens"),
    )
    mixed = by_source.agg(F.sum("mixed_tokens").alias("t")).scalar()
    goal = targets.groupBy(source).agg(F.sum(share).alias("target_share"))
    return goal.join(by_source, source, "left").withColumn("share", F.col("mixed_tokens") / mixed)
