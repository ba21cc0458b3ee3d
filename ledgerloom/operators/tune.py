"""Search over boost settings: many trials scored in one job, as the score is linear in the boosts."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import Index, trial_hits

# Parameters of a setting that are no boosts.
NOT_BOOSTS = ("es_result_size", "z_score_threshold", "good_description")


def split_parameters(parameters: dict) -> tuple[dict, dict]:
    """(boosts, others)."""
    return {k: v for k, v in parameters.items() if k not in NOT_BOOSTS}, {k: v for k, v in parameters.items() if k in NOT_BOOSTS}


def perturbed(parameters: dict[str, float], rate: float, rng: random.Random) -> dict[str, float]:
    """Each value moved by at most `rate`, within [0, 3], to three digits; the score-gap threshold rises
    by half of that at most."""
    out = {}
    for name, value in parameters.items():
        up = rate / 2 if name == "z_score_threshold" else rate
        out[name] = round(min(3.0, max(0.0, float(value) + rng.uniform(-rate, up))), 3)
    return out


def bounded_step(values: list[float], step: float, low: float, high: float, rng: random.Random, tries: int = 1_000) -> list[float]:
    """Values moved at random by at most `step`, all within [low, high]; moves that leave it are drawn
    anew, and after too many tries cut off."""
    for _ in range(tries):
        moved = [v + rng.uniform(-step, step) for v in values]
        if all(low <= v <= high for v in moved):
            return moved
    return [min(high, max(low, v)) for v in moved]


def trial_table(spark: SparkSession, settings: list[dict[str, float]]) -> DataFrame:
    rows = [(i, f, float(b)) for i, s in enumerate(settings) for f, b in split_parameters(s)[0].items() if b]
    return spark.createDataFrame(rows, "trial int, field string, factor double")


def evaluate(clauses: DataFrame, idx: Index, trials: DataFrame, truth: DataFrame, least_gap: float = 0.0) -> DataFrame:
    """(trial, n, accuracy, percent_labelled) of every trial against truth (query, doc), in one job."""
    top = trial_hits(clauses, idx, trials, 45)
    facts = top.groupBy("trial", "query").agg(F.max(F.when(F.col("rank") == 1, F.col("doc"))).alias("doc"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"), F.stddev_pop("score").alias("sd"))
    gap = F.try_divide(F.col("s1") - F.col("s2"), F.when(F.col("sd") > 1e-9, F.col("sd")))
    labelled = F.coalesce(gap > least_gap, F.lit(False))
    joined = facts.join(truth.withColumnRenamed("doc", "true_doc"), "query")
    hit = F.sum((labelled & (F.col("doc") == F.col("true_doc"))).cast("long"))
    n_labelled = F.sum(labelled.cast("long"))
    return joined.groupBy("trial").agg(F.count(F.lit(1)).alias("n"), F.round(F.try_divide(hit * 100.0, n_labelled), 2).alias("accuracy"), F.round(n_labelled * 100.0 / F.count(F.lit(1)), 2).alias("percent_labelled"))


def best_trial(results: DataFrame, least_labelled: float = 31.0, most_accuracy: float = 97.5):
    """The most accurate trial that labels enough and is not above the accuracy taken for overfitting."""
    return results.filter((F.col("percent_labelled") >= least_labelled) & (F.col("accuracy") <= most_accuracy)).orderBy(F.col("accuracy").desc(), F.col("percent_labelled").desc(), "trial").first()
