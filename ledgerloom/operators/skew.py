"""Per-key results that stay balanced although a few keys hold most records.

Rows are range partitioned on the composite (key, order columns, row hash): Spark samples quantiles of
the composite, so that a heavy key is cut over as many partitions as its share of the rows asks for.
Inside a partition the rows are sorted; one pass over Arrow batches folds each run of a key into a
partial state. A key cut by a boundary leaves one state per partition it touches, and those, at most
as many as there are partitions, are stitched in partition order.

A state is (n, amount_sum, first_at, last_at, longest_gap): counts and sums add up, and the gap between
one state's last instant and the next one's first is the piece that only stitching can supply.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STATE = "k string, pid int, n bigint, total double, first_at bigint, last_at bigint, longest_gap bigint"
_FIELDS = pa.schema([("k", pa.string()), ("pid", pa.int32()), ("n", pa.int64()), ("total", pa.float64()), ("first_at", pa.int64()), ("last_at", pa.int64()), ("longest_gap", pa.int64())])
_NONE = np.iinfo(np.int64).min


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds sorted rows (k, at, v, pid) into one state per run of k; the run that a batch ends with
    stays open until the next batch begins. NULL instants count in n only."""
    held: list | None = None  # [k, pid, n, total, first, last, gap]
    out: list[list] = []

    def flush(rows: list[list]) -> pa.RecordBatch:
        clean = [[None if x == _NONE else x for x in r[4:]] for r in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate(_FIELDS.types[:4])] + [pa.array([c[i] for c in clean], pa.int64()) for i in range(3)], schema=_FIELDS
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0)
        codes = keys.dictionary_encode()
        ids = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        names = codes.dictionary
        at = batch.column(1).fill_null(_NONE).to_numpy(zero_copy_only=False)
        values = batch.column(2).fill_null(0.0).to_numpy(zero_copy_only=False)
        pid = batch.column(3)[0].as_py()
        cuts = np.flatnonzero(np.diff(ids)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(ids)]])
        sums = np.add.reduceat(values, starts)
        for s, e, total in zip(starts.tolist(), ends.tolist(), sums.tolist()):
            name = None if ids[s] < 0 else names[int(ids[s])].as_py()
            known = at[s:e]
            known = known[known != _NONE]
            gap = int(np.diff(known).max()) if len(known) > 1 else _NONE
            first, last = (int(known[0]), int(known[-1])) if len(known) else (_NONE, _NONE)
            if held is not None and held[0] == name:
                if first != _NONE:
                    if held[5] != _NONE:
                        gap = max(gap, first - held[5])
                    held[4] = first if held[4] == _NONE else held[4]
                    held[5] = last
                held[2], held[3], held[6] = held[2] + e - s, held[3] + total, max(held[6], gap)
            else:
                if held is not None:
                    out.append(held)
                held = [name, pid, e - s, total, first, last, gap]
        if len(out) > 4096:
            yield flush(out)
            out = []
    if held is not None:
        yield flush([*out, held])


def range_partials(df: DataFrame, key: str, order: list[str], instant: str, value: str, partitions: int | None = None) -> DataFrame:
    """One partial state per key and range partition."""
    n = partitions or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = [f"_o{i}" for i in range(len(order))]
    slim = df.select(
        F.col(key).cast("string").alias("k"),
        F.unix_micros(F.col(instant).cast("timestamp")).alias("at"),
        F.col(value).cast("double").alias("v"),
        *[F.col(c).alias(a) for c, a in zip(order, names)],
    )
    composite = ["k", "at", *names]
    spread = slim.repartitionByRange(n, *composite).sortWithinPartitions(*composite)
    return spread.select("k", "at", "v", F.spark_partition_id().alias("pid")).mapInArrow(_fold, _STATE)


def stitch(partials: DataFrame) -> DataFrame:
    """Joins the states of each key in partition order. A key has at most one state per partition, so
    the lists are bounded by the number of partitions, whatever the rows of the key."""
    start = "named_struct('n', 0L, 'total', 0D, 'first_at', CAST(NULL AS BIGINT), 'last_at', CAST(NULL AS BIGINT), 'gap', CAST(NULL AS BIGINT))"
    fold = """aggregate(states, {start}, (a, s) -> named_struct(
        'n', a.n + s.n, 'total', a.total + s.total,
        'first_at', coalesce(a.first_at, s.first_at),
        'last_at', coalesce(s.last_at, a.last_at),
        'gap', greatest(a.gap, s.longest_gap, s.first_at - a.last_at)))""".format(start=start)
    states = partials.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pid", "n", "total", "first_at", "last_at", "longest_gap"))).alias("states"))
    return states.select("k", F.expr(fold).alias("r"), F.size("states").alias("pieces")).select("k", "r.*", "pieces")


def per_key(df: DataFrame, key: str, instant: str, value: str, order: list[str], partitions: int | None = None) -> DataFrame:
    """Rows, sum, first and last instant and longest gap between neighbouring instants of every key:
    (key, n, total, first_at, last_at, longest_gap_days, pieces).

    Keys are compared exactly as stored; NULL is a key of its own, and so is ''. NULL instants and
    values count as rows only. `order` breaks ties between rows of one instant, and the finer it is,
    the finer a heavy key can be cut; the results do not depend on it. Repeated rows count each. An
    empty table gives no rows. Columns other than the named ones are not read.
    """
    day = 86_400_000_000
    return stitch(range_partials(df, key, order, instant, value, partitions)).select(
        F.col("k").alias(key),
        "n",
        F.round("total", 2).alias("total"),
        F.timestamp_micros("first_at").alias("first_at"),
        F.timestamp_micros("last_at").alias("last_at"),
        (F.col("gap") / F.lit(day)).alias("longest_gap_days"),
        "pieces",
    )


def heavy_keys(df: DataFrame, key: str, instant: str, value: str, order: list[str], share: float = 0.03) -> DataFrame:
    """The non-blank keys that hold at least `share` of all rows of df, blank and NULL ones included
    in the total. The comparison is made in integers, n * 10^6 >= share * 10^6 * rows."""
    states = per_key(df, key, instant, value, order)
    rows = df.agg(F.count(F.lit(1)).alias("rows")).scalar()
    scaled = round(share * 1_000_000)
    return states.filter(F.col(key).isNotNull() & F.col(key).rlike(r"(?U)\S") & (F.col("n") * 1_000_000 >= F.lit(scaled) * rows)).select(key, "n", "total", "pieces")
