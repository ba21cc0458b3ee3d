"""Comparing machine labels with human ones: accuracy, confusion and per-class reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import sized_broadcast


def last_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key. An aggregation, not a window: a heavy key combines on the map side."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def accuracy_status(machine: DataFrame, human: DataFrame, key: str, label: str, human_label: str) -> DataFrame:
    """Each machine row as unlabeled, needs_hand, correct or mislabeled, in this order of precedence.
    Labels are compared in lower case; human must have one row per key."""
    truth = human.select(key, F.col(human_label).alias("_h"))
    joined = machine.join(truth, key, "left")
    m, h = F.lower(F.coalesce(F.col(label), F.lit(""))), F.lower(F.coalesce(F.col("_h"), F.lit("")))
    status = F.when(m == "", "unlabeled").when(h == "", "needs_hand").when(m == h, "correct").otherwise("mislabeled")
    return joined.withColumn("status", status).drop("_h")


def accuracy_metrics(status: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counters and the percentages that follow from them."""
    n = lambda s: F.sum((F.col("status") == s).cast("long"))
    out = status.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total"), n("unlabeled").alias("unlabeled"), n("needs_hand").alias("needs_hand"), n("correct").alias("correct"), n("mislabeled").alias("mislabeled"))
    labeled = F.col("total") - F.col("unlabeled")
    verified = labeled - F.col("needs_hand")
    percent = lambda c: F.round(F.try_divide(c * 100.0, F.col("total")), 6)
    return (
        out.withColumn("labeled_percent", percent(labeled))
        .withColumn("verified_percent", percent(verified))
        .withColumn("predictive_accuracy", F.round(F.col("correct") * 100.0 / F.greatest(verified, F.lit(1)), 6))
    )


def physical_percents(df: DataFrame, flag: str) -> DataFrame:
    """Shares of physical and other rows over all rows."""
    physical = F.sum((F.col(flag) == "1").cast("long"))
    total = F.count(F.lit(1))
    return df.agg(F.round(physical * 100.0 / total, 6).alias("physical_percent"), F.round((total - physical) * 100.0 / total, 6).alias("other_percent"))


def flagged_once(rows: DataFrame, human: DataFrame, on: str, flag: str, value: str) -> DataFrame:
    """Rows whose description has at least one human row with the flag (each once)."""
    return rows.join(human.filter(F.col(flag) == value).select(on).distinct(), on, "left_semi")


def flagged_each(rows: DataFrame, human: DataFrame, on: str, flag: str, value: str) -> DataFrame:
    """Rows once per human row of their description that has the flag. Human rows are counted per
    description first, so that the join itself stays small; the rows are then repeated."""
    counts = human.filter(F.col(flag) == value).groupBy(on).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    return rows.join(counts, on).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n", "_i")


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_grid(long: DataFrame, classes: list) -> DataFrame:
    """All cells of the matrix over a known list of classes, with zeros for what did not occur."""
    spark = long.sparkSession
    cells = spark.createDataFrame([(a, p) for a in classes for p in classes], long.select("actual", "predicted").schema)
    return cells.join(long, ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def confusion_wide(long: DataFrame, classes: list) -> DataFrame:
    """One column per predicted class."""
    return long.groupBy("actual").pivot("predicted", classes).agg(F.sum("n")).na.fill(0)


def class_report(long: DataFrame) -> DataFrame:
    """Per class TP, FP, FN, TN and the ratios of them; a ratio over nothing is NULL. Row and column
    sums are of one row per class, so that the joins are small whatever the data."""
    rows = long.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("row_n"))
    cols = long.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("col_n"))
    hits = long.filter("actual = predicted").select(F.col("actual").alias("label"), F.col("n").alias("tp"))
    total = long.agg(F.sum("n")).scalar()
    t = rows.join(cols, "label", "full").join(hits, "label", "left").na.fill(0)
    out = t.select("label", F.col("tp").cast("long").alias("tp"), (F.col("col_n") - F.col("tp")).cast("long").alias("fp"), (F.col("row_n") - F.col("tp")).cast("long").alias("fn"))
    out = out.withColumn("tn", (total - F.col("tp") - F.col("fp") - F.col("fn")).cast("long"))
    ratio = lambda a, b: F.round(F.try_divide(a * 1.0, b), 6)
    p, r = F.try_divide(F.col("tp") * 1.0, F.col("tp") + F.col("fp")), F.try_divide(F.col("tp") * 1.0, F.col("tp") + F.col("fn"))
    return out.select("*", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"), F.round(F.try_divide(2 * p * r, p + r), 6).alias("f_measure"))


def overall_accuracy(long: DataFrame) -> DataFrame:
    return long.agg(F.round(F.try_divide(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)) * 1.0, F.sum("n")), 6).alias("accuracy"))


def chi_square(df: DataFrame, group: str) -> DataFrame:
    """(n, groups, chi_square, degrees): how far the sizes of groups are from being equal."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("k"))
    n, groups = F.sum("k"), F.count(F.lit(1))
    return sizes.agg(n.alias("n"), groups.alias("groups"), F.round(F.sum(F.col("k") * F.col("k")) * groups / n - n, 6).alias("chi_square"), (groups - 1).alias("degrees"))


def throughput(total: Column, seconds: Column) -> tuple[Column, Column]:
    """(seconds per row, rows per minute); a run counts as one second at least."""
    run = F.greatest(seconds, F.lit(1))
    return F.try_divide(run, total), total * 60.0 / run


def best_candidate(df: DataFrame, group: str, score: str, stamp: str, pinned: DataFrame | None = None) -> DataFrame:
    """The best candidate of each group: a pinned one, else the highest score, ties to the earliest."""
    if pinned is not None:
        df = df.join(sized_broadcast(pinned.select(group, F.col(stamp).alias("_pin"))), group, "left").withColumn("_p", F.coalesce((F.col(stamp) == F.col("_pin")).cast("int"), F.lit(0))).drop("_pin")
    else:
        df = df.withColumn("_p", F.lit(0))
    w = Window.partitionBy(group).orderBy(F.col("_p").desc(), F.col(score).desc(), F.col(stamp).asc())
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_p")


def running_best(df: DataFrame, group: str, step: str, score: str, patience: int) -> DataFrame:
    """Adds the best score so far, the steps since it was reached and whether training stops here."""
    so_far = Window.partitionBy(group).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(score).over(so_far)
    out = df.withColumn("best", best).withColumn("_new", F.col(score) >= F.coalesce(F.max(score).over(Window.partitionBy(group).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)), F.col(score)))
    out = out.withColumn("_at", F.max(F.when(F.col("_new"), F.col(step))).over(so_far))
    return out.withColumn("since_best", (F.col(step) - F.col("_at")).cast("long")).withColumn("stop", F.col("since_best") >= patience).drop("_new", "_at")
