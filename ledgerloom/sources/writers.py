"""Sinks: delimited text, JSON lines, partitioned snapshots, archives and upload checks."""

from __future__ import annotations

import json
import tarfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import SourceError


def write_piped(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "overwrite") -> None:
    """Pipe-delimited text with a header; columns that are not in the order are left out."""
    cols = [c for c in (order or df.columns) if c in df.columns]
    df.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols]).write.mode(mode).csv(path, sep="|", header=True, emptyValue="", quote="")


def write_soft_targets(df: DataFrame, scores: str, classes: int, path: str) -> None:
    """The rows with one column class_i per score."""
    wide = df.select(*[c for c in df.columns if c != scores], *[F.get(F.col(scores), i).alias(f"class_{i + 1}") for i in range(classes)])
    write_piped(wide, path)


def upsert(snapshot: DataFrame | None, rows: DataFrame, key: str, order: str, region: str, path: str, mode: str = "errorifexists", files: int = 200) -> None:
    """A new snapshot at a new path, partitioned by region: of the rows of a key the last one by `order`
    stands. Rows of a region are spread over up to `files` tasks by key, so that a region of a third of
    all rows is not written by one. A path that exists is an error, or with mode 'ignore' left as it is;
    the snapshot that is read cannot be the one that is written."""
    both = rows if snapshot is None else snapshot.unionByName(rows, allowMissingColumns=True)
    rest = [c for c in both.columns if c != key]
    last = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, "_r.*")
    last.repartition(files, region, F.pmod(F.xxhash64(key), F.lit(files))).write.mode(mode).partitionBy(region).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_json(value, path: str) -> None:
    Path(path).write_text(json.dumps(value, sort_keys=True), encoding="utf-8")


def merge_report_name(folder: str, name: str, percent: float) -> str:
    """Where the report of a merge goes; its name tells the success rate."""
    return f"{folder.rstrip('/')}/{name}_{percent:.2f}"


def write_merge_report(matches: DataFrame, folder: str, name: str) -> str:
    """Writes the rows of a merge, with a column `matched`, to a path that tells the success rate."""
    counted = matches.agg(F.count_if("matched").alias("m"), F.count(F.lit(1)).alias("n")).first()
    path = merge_report_name(folder, name, 100.0 * counted.m / max(1, counted.n))
    write_piped(matches, path)
    return path


def write_relinked(rows: DataFrame, blank: list[str], order: list[str], path: str) -> None:
    """All buckets of a comparison in one file: enriched columns blank, columns in order, relinked_id last."""
    write_piped(rows.withColumns({c: F.lit("") for c in blank}), path, [*order, "relinked_id"])


def push(spark: SparkSession, local: str, target: str) -> None:
    """Copies a local file to a folder of any file system that Spark reaches."""
    to = spark._jvm.org.apache.hadoop.fs.Path(target)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(local), to)


def pack(files: list[str], archive: str) -> None:
    with tarfile.open(archive, "w:gz") as tar:
        for f in files:
            tar.add(f, arcname=Path(f).name)


def check_upload(folder: str) -> None:
    """One CSV file or more, exactly one JSON file, nothing else."""
    kinds = [p.suffix for p in Path(folder).iterdir()]
    if kinds.count(".json") != 1 or kinds.count(".csv") < 1 or set(kinds) - {".json", ".csv"}:
        raise SourceError(f"{folder} must hold CSV files and exactly one JSON file")
