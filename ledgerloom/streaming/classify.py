"""The enrichment plan over a stream of requests, batch by batch, and incremental user context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich
from ..sources.readers import request_rows


def request_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(request_id, value) of files of one JSON request per line."""
    lines = spark.readStream.text(folder)
    return lines.select(F.xxhash64("value").alias("request_id"), "value")


def classify_stream(requests: DataFrame, merchants: DataFrame, cities: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Enriches each batch with the same plan as a batch job. Top-k needs a window over scores, which
    streams do not allow, so that it runs inside foreachBatch."""

    def step(batch: DataFrame, number: int) -> None:
        rows, _ = request_rows(batch)
        keyed = rows.withColumn("row_key", F.concat_ws(":", "request_id", "pos"))
        write(enrich.find_merchants(keyed, "row_key", "description", merchants, cities, least_gap=0.5), number)

    return requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolling_counts(events: DataFrame, time: str, kind: str, lateness: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events per window and kind with a bound on lateness; the same plan on a table or a stream."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    return events.withWatermark(time, lateness).groupBy(F.window(time, window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def user_cities(rows: DataFrame, user: str, city: str) -> DataFrame:
    """(user, n_cities, n_rows) kept up to date per user on a stream. The state holds a user's distinct
    cities, not rows."""

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, n = (set(state.get[0].split("\x1f")) - {""}, state.get[1]) if state.exists else (set(), 0)
        for f in frames:
            seen |= {c for c in f[city].dropna() if c}
            n += len(f)
        state.update(("\x1f".join(sorted(seen)), n))
        yield pd.DataFrame({user: [key[0]], "n_cities": [len(seen)], "n_rows": [n]})

    slim = rows.select(user, city)
    return slim.groupBy(user).applyInPandasWithState(update, f"`{user}` string, n_cities long, n_rows long", "cities string, n long", "update", "NoTimeout")
