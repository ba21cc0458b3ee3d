"""Tagging the merchant's words of a description: vocabularies, padded indices, a trained tagger behind the
interface of the other label models, and its report."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import _alphabet
from ..functions.text import merchant_tags
from .models import FIT_ROWS
from .prep import row_numbers

# Reserved ids of characters (padding, begin and end of a word) and the id of unknown words.
PAD, BEGIN, END, FIRST_CHARACTER, UNKNOWN = 0, 1, 2, 3, 0


def vocabulary(words: DataFrame, word: str, order: list[str], buckets: int = 64) -> DataFrame:
    """(word, word_index) of distinct words in the order in which they first appear, from 1; 0 stands
    for unknown ones."""
    first = words.filter(F.col(word).isNotNull()).groupBy(F.col(word).alias("word")).agg(F.min(F.struct(*order)).alias("_at"))
    return row_numbers(first, ["_at"], buckets).select("word", (F.col("row_no") + 1).alias("word_index"))


def vocabulary_union(training: DataFrame, known: DataFrame, word: str = "word") -> DataFrame:
    """(word, in_training, in_known) of the words of either."""
    side = lambda df, flag: df.select(word).distinct().withColumn(flag, F.lit(True))
    out = side(training, "in_training").join(side(known, "in_known"), word, "full")
    return out.select(word, F.coalesce("in_training", F.lit(False)).alias("in_training"), F.coalesce("in_known", F.lit(False)).alias("in_known"))


def padded(values: Column, length: int, filler: int = PAD) -> Column:
    """The first `length` values, filled up behind."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(filler), length)), 1, length)


def character_indices(token: Column, alphabet: str, length: int) -> Column:
    """Ids of a word's characters between the marks of its begin and end, cut and padded to `length`.
    Characters outside the alphabet have the id after its last."""
    table, unknown = _alphabet(alphabet), FIRST_CHARACTER + len(dict.fromkeys(alphabet))
    chars = F.filter(F.split(F.lower(token), ""), lambda c: c != "")
    ids = F.transform(F.slice(chars, 1, length - 2), lambda c: F.coalesce(F.try_element_at(table, c) + F.lit(FIRST_CHARACTER - 1), F.lit(unknown)))
    return padded(F.concat(F.array(F.lit(BEGIN)), ids, F.array(F.lit(END))), length)


def word_indices(df: DataFrame, key: str, tokens: str, words: DataFrame, length: int) -> DataFrame:
    """(key, word_indices) of the first `length` tokens of a row by a vocabulary; a shuffle by word, since a
    vocabulary may be long. Words are compared in lower case."""
    cells = df.select(key, F.posexplode(F.slice(tokens, 1, length)).alias("_p", "_t")).withColumn("word", F.lower("_t"))
    known = cells.join(words.select("word", "word_index"), "word", "left").select(key, "_p", F.coalesce("word_index", F.lit(UNKNOWN)).cast("int").alias("_i"))
    rows = known.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_p", "_i"))).alias("_l"))  # `length` at most
    return rows.select(key, padded(F.transform("_l", lambda x: x["_i"]), length).alias("word_indices"))


def token_rows(df: DataFrame, key: str, text: str, merchant: str | None = None) -> DataFrame:
    """(key, pos, token, features, tag): one row per token with the words around it; the tag is that of the
    labelled merchant, or NULL where none is given."""
    tags = merchant_tags(F.col(text), F.coalesce(F.col(merchant), F.lit("")) if merchant else F.lit(""))
    rows = df.select(key, F.posexplode(tags).alias("pos", "_t"), F.transform(tags, lambda t: F.lower(t["token"])).alias("_all"))
    near = lambda k: F.concat(F.lit(f"{k}:"), F.coalesce(F.get("_all", F.col("pos") + k), F.lit("<none>")))
    shape = F.concat(F.lit("s:"), F.regexp_replace(F.regexp_replace("_t.token", "[0-9]", "9"), "[A-Za-z]", "a"))
    features = F.array(near(-1), near(0), near(1), shape, F.concat(F.lit("p:"), F.least("pos", F.lit(8)).cast("string")), F.concat(F.lit("h:"), F.substring("_t.token", 1, 3)))
    return rows.select(key, "pos", F.col("_t.token").alias("token"), features.alias("features"), F.col("_t.tag").alias("tag") if merchant else F.lit(None).cast("string").alias("tag"))


def fit(df: DataFrame, key: str, text: str, merchant: str, features: int = 1 << 16, rounds: int = 20, seed: int = 1, most: int = FIT_ROWS) -> PipelineModel:
    """A model of the tag of every token given the words around it, fitted to the tokens of at most `most`
    labelled rows (a seeded sample of more)."""
    rows = df.filter((F.coalesce(F.col(merchant), F.lit("")) != "") & F.col(text).isNotNull())
    n = rows.count()
    rows = rows.sample(False, most / n, seed) if n > most else rows
    tokens = token_rows(rows, key, text, merchant).withColumn("_y", (F.col("tag") != "background").cast("double"))
    return Pipeline(stages=[HashingTF(inputCol="features", outputCol="_f", numFeatures=features, binary=True), LogisticRegression(featuresCol="_f", labelCol="_y", maxIter=rounds, regParam=1e-4)]).fit(tokens)


def tag(model: PipelineModel, df: DataFrame, key: str, text: str, least: float = 0.5) -> DataFrame:
    """(key, pos, token, predicted, score) of every token of every row."""
    done = model.transform(token_rows(df, key, text))
    score = F.get(vector_to_array("probability"), 1)
    return done.select(key, "pos", "token", F.when(score >= least, "merchant").otherwise("background").alias("predicted"), F.round(score, 6).alias("score"))


def merchants_of(tagged: DataFrame, key: str) -> DataFrame:
    """(key, merchant): the words tagged as the merchant's, in their order; '' where there are none."""
    words = tagged.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("predicted") == "merchant", F.struct("pos", "token")))).alias("_l"))
    return words.select(key, F.array_join(F.transform("_l", lambda x: x["token"]), " ").alias("merchant"))


def tag_report(tags: DataFrame, key: str) -> DataFrame:
    """(n_tokens, n_rows, accuracy, rows_correct, merchant_ratio) of (key, actual, predicted): the share of
    tokens that are right, of rows all of whose tokens are, and of merchant tags that were found."""
    right = (F.col("actual") == F.col("predicted")).cast("long")
    per_row = tags.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(right).alias("ok"), F.count_if(F.col("actual") == "merchant").alias("m"), F.count_if((F.col("actual") == "merchant") & (F.col("predicted") == "merchant")).alias("hit"))
    ratio = lambda a, b: F.round(F.try_divide(a * 1.0, b), 6)
    return per_row.agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_rows"), ratio(F.sum("ok"), F.sum("n")).alias("accuracy"), F.count_if(F.col("n") == F.col("ok")).alias("rows_correct"), ratio(F.sum("hit"), F.sum("m")).alias("merchant_ratio"))
