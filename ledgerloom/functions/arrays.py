"""Scores, label vectors and index sequences, as Column -> Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least probability whose logarithm is taken.
LEAST = 1e-10


def first_argmax(scores: Column) -> Column:
    """1-based position of the first largest score."""
    return F.array_position(scores, F.array_max(scores))


def softmax(scores: Column, temperature: float = 1.0) -> Column:
    """Softmax of one row with a temperature; shifted by the largest score, which changes nothing but
    keeps the exponentials finite."""
    top = F.array_max(scores)
    raised = F.transform(scores, lambda x: F.exp((x - top) / F.lit(float(temperature))))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, v: a + v))


def clipped_log(values: Column) -> Column:
    return F.transform(values, lambda x: F.log(F.greatest(F.least(x, F.lit(1.0)), F.lit(LEAST))))


def threshold_relu(value: Column, least: float = 1e-6) -> Column:
    return F.when(value >= least, value).otherwise(F.lit(0.0))


def label_or_default(label: Column, score: Column, threshold: Column, default: int = 1) -> Column:
    """The label, or the default class where the log score is below the log of the threshold. NULL
    thresholds accept every score."""
    return F.when(threshold.isNotNull() & (score < F.log(threshold)), F.lit(default)).otherwise(label)


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(classes)), lambda x: (x == label).cast("int"))


def char_indices(text: Column, alphabet: str, length: int) -> Column:
    """Positions (1-based, 0 for characters outside the alphabet) of the first `length` characters in
    lower case, last character first."""
    chars = F.filter(F.split(F.substring(F.lower(text), 1, length), ""), lambda c: c != "")
    return F.reverse(F.transform(chars, lambda c: F.coalesce(F.element_at(_alphabet(alphabet), c), F.lit(0))))


def _alphabet(alphabet: str) -> Column:
    return F.create_map(*[x for i, c in enumerate(dict.fromkeys(alphabet), 1) for x in (F.lit(c), F.lit(i))])


def char_one_hot(text: Column, alphabet: str, length: int) -> Column:
    """One row of `length` columns per character of the alphabet; unused columns stay 0."""
    at = char_indices(text, alphabet, length)
    row = lambda i: F.transform(F.sequence(F.lit(1), F.lit(length)), lambda j: F.coalesce(F.get(at, j - 1) == F.lit(i), F.lit(False)).cast("int"))
    return F.array(*[row(i) for i in range(1, len(dict.fromkeys(alphabet)) + 1)])


def mean_vectors(vectors: list[Column]) -> Column:
    """Element-wise mean of score vectors of equal length."""
    total = vectors[0]
    for v in vectors[1:]:
        total = F.zip_with(total, v, lambda a, b: a + b)
    return F.transform(total, lambda x: x / F.lit(float(len(vectors))))


def first_of_list(values: Column) -> Column:
    """The first element; NULL for an empty list."""
    return F.get(values, 0)


def score_matrix(classes: int, prefix: str = "class_") -> Column:
    """The columns class_1, class_2, ... of a file of soft targets as one vector."""
    return F.array(*[F.col(f"{prefix}{i}").cast("double") for i in range(1, classes + 1)])


def flat_distinct(nested: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(nested)))


def category_list(text: Column) -> Column:
    """The labels of a JSON list, of a JSON list of lists, or of plain text; blank text has none."""
    plain = F.from_json(text, "array<string>")
    nested = F.from_json(text, "array<array<string>>")
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.array().cast("array<string>")).when(text.startswith("[["), flat_distinct(nested)).when(text.startswith("["), plain).otherwise(F.array(text))
