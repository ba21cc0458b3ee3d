"""Label models behind one interface: a pyspark.ml pipeline over character n-grams stands in for the
neural classifiers, for which no runtime is assumed. Scores are probability vectors."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import first_argmax, mean_vectors

#: Most labelled rows that a model is fitted to (a seeded sample of more); scoring covers all rows.
FIT_ROWS = 200_000


def fit(df: DataFrame, text: str, label: str, features: int = 1 << 14, rounds: int = 12, seed: int = 1, weight: str | None = None, most: int = FIT_ROWS) -> PipelineModel:
    """A logistic model over character 3-grams, fitted to at most `most` labelled rows."""
    rows = df.select(F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"), F.col(label).alias("_label"), *([F.col(weight).alias("_w")] if weight else [])).filter("_label is not null and length(_text) > 2")
    n = rows.count()
    if n > most:
        rows = rows.sample(False, most / n, seed)
    steps = [
        RegexTokenizer(inputCol="_text", outputCol="_chars", pattern=".", gaps=False),
        NGram(n=3, inputCol="_chars", outputCol="_grams"),
        HashingTF(inputCol="_grams", outputCol="_f", numFeatures=features, binary=True),
        StringIndexer(inputCol="_label", outputCol="_y", handleInvalid="error", stringOrderType="alphabetAsc"),
        LogisticRegression(featuresCol="_f", labelCol="_y", maxIter=rounds, regParam=0.01, **({"weightCol": "_w"} if weight else {})),
    ]
    return Pipeline(stages=steps).fit(rows)


# The kinds of models that a registry holds.
KINDS = tuple(f"{container}_{kind}" for container in ("bank", "card") for kind in ("sws", "merchant", "debit_subtype", "credit_subtype", "debit_category", "credit_category"))


def save(model: PipelineModel, folder: str, kind: str, stamp: str) -> str:
    """Stores a version of a model of a kind; `stamp` is digits, as version_stamp() gives."""
    if kind not in KINDS or not stamp.isdigit():
        raise ValueError(f"{kind} is no kind of model, or {stamp} no stamp")
    path = f"{folder.rstrip('/')}/{kind}/{stamp}"
    model.write().overwrite().save(path)
    return path


def load(spark, folder: str, kind: str, stamp: str | None = None) -> PipelineModel:
    """A version of a model, by default the newest."""
    from ..sources.readers import newest_version

    return PipelineModel.load(f"{folder.rstrip('/')}/{kind}/{stamp or newest_version(spark, f'{folder.rstrip('/')}/{kind}')}")


def labels_of(model: PipelineModel) -> list[str]:
    return list(model.stages[3].labels)


def scores(model: PipelineModel, df: DataFrame, text: str, out: str = "scores") -> DataFrame:
    """Adds the probability vector of every row."""
    done = PipelineModel(model.stages[:3] + model.stages[4:]).transform(df.withColumn("_text", F.lower(F.coalesce(F.col(text), F.lit("")))))
    return done.select(*df.columns, F.slice(vector_to_array("probability"), 1, len(labels_of(model))).alias(out))


def predict(model: PipelineModel, df: DataFrame, text: str, out: str = "predicted", least: float = 0.0) -> DataFrame:
    """Adds the label of the highest score, or the first label where that score is below `least`."""
    names = F.array(*[F.lit(x) for x in labels_of(model)])
    scored = scores(model, df, text, "_s")
    best = F.when(F.array_max("_s") < least, F.lit(1).cast("long")).otherwise(first_argmax(F.col("_s")))
    return scored.withColumn(out, F.element_at(names, best.cast("int"))).withColumn("score", F.round(F.array_max("_s"), 6)).drop("_s")


def ensemble_scores(models: list[PipelineModel], df: DataFrame, text: str, out: str = "scores") -> DataFrame:
    """The mean of the members' vectors: soft targets for a distilled model."""
    for i, m in enumerate(models):
        df = scores(m, df, text, f"_s{i}")
    parts = [F.col(f"_s{i}") for i in range(len(models))]
    return df.withColumn(out, mean_vectors(parts)).drop(*[f"_s{i}" for i in range(len(models))])


def distil(df: DataFrame, text: str, soft: str, names: list[str], rounds: int = 12) -> PipelineModel:
    """A model fitted to soft targets: each row once per class with the class's probability as weight
    (classes below one percent carry nothing and are left out)."""
    spread = df.select(text, F.posexplode(soft).alias("_i", "_p")).filter("_p >= 0.01")
    labelled = spread.withColumn("_name", F.element_at(F.array(*[F.lit(x) for x in names]), F.col("_i") + 1))
    return fit(labelled, text, "_name", rounds=rounds, weight="_p")
