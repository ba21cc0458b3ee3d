"""Queries of label models, tuning and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import models, prep, tune
from ..session import shared_folder, table
from ..streaming import classify
from . import q_search
from .registry import registry

QUERIES, SQL, query = registry()

LT = "labeled_transactions"


def _split(s, d):
    return prep.hash_split(table(s, d, LT).select("transaction_id", "description_unmasked", "ledger_entry", "is_physical_transaction"), "transaction_id", 0.8)


def _model(rows):
    return models.fit(rows.filter("part = 'train'"), "description_unmasked", "is_physical_transaction")


@query()
def physical_model_report(s, d):
    """Held-out report of the physical / non-physical model."""
    rows = _split(s, d)
    tested = models.predict(_model(rows), rows.filter("part = 'test'"), "description_unmasked")
    return ev.class_report(ev.confusion(tested, "is_physical_transaction", "predicted"))


@query()
def ensemble_report(s, d):
    """Two members fitted to one half of the training rows each, their mean, and a model distilled from it."""
    rows = _split(s, d)
    train = rows.filter("part = 'train'")
    members = [models.fit(train.filter(F.pmod(F.xxhash64("transaction_id"), F.lit(2)) == i), "description_unmasked", "is_physical_transaction", seed=i) for i in (0, 1)]
    soft = models.ensemble_scores(members, train, "description_unmasked", "soft")
    student = models.distil(soft, "description_unmasked", "soft", models.labels_of(members[0]))
    tested = models.predict(student, rows.filter("part = 'test'"), "description_unmasked")
    return ev.overall_accuracy(ev.confusion(tested, "is_physical_transaction", "predicted"))


@query()
def trial_accuracy(s, d):
    """Accuracy of several boost settings against the ids the transactions carry."""
    asked = table(s, d, LT).filter("transaction_id % 50 = 0 and factual_id not in ('', 'NULL')").groupBy(F.col("transaction_id").alias("query")).agg(F.min("factual_id").alias("doc"))
    settings = [dict(q_search.FIELDS), {"place_name": 2.0, "locality": 3.0, "region": 1.0}, {"place_name": 1.0}]
    return tune.evaluate(q_search._clauses(s, d), q_search._index(s, d), tune.trial_table(s, settings), asked)


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(s, d):
    return classify.rolling_counts(table(s, d, "events"), "ts", "event_type")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(s, d):
    """The same windows from a stream that reads the table's file to its end."""
    source = s.readStream.schema(table(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    name = f"windows_{uuid.uuid4().hex}"
    run = classify.rolling_counts(source, "ts", "event_type").writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{shared_folder(s)}/streams/{name}").trigger(availableNow=True).start()
    run.awaitTermination()
    return s.table(name)
