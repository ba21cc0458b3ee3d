"""Scans: delimited text of several dialects, gazetteers, embeddings, archives, versions and requests."""

from __future__ import annotations

import csv
import io
import json
import re
import tarfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A value no file holds: keeps empty cells apart from missing ones.
_NEVER = "\ue001"


class SourceError(ValueError):
    """Input that cannot be used as it is."""


def header_of(spark: SparkSession, path: str, delimiter: str, quote: str = "") -> list[str]:
    """The names in the first line of a file (or of the first file of a folder)."""
    line = spark.read.text(path).limit(1).collect()
    if not line:
        raise SourceError(f"{path} has no header")
    text = line[0][0]
    return next(csv.reader(io.StringIO(text), delimiter=delimiter)) if quote else text.split(delimiter)


def piped(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, delimiter: str = "|") -> DataFrame:
    """Delimited text without quoting, all strings: empty and missing cells are '', records with too many
    fields and blank lines are dropped, short records padded. Only the columns asked for are kept. Lines
    that repeat the header are taken for the headers of further files."""
    names = header_of(spark, path if isinstance(path, str) else path[0], delimiter)
    lines = spark.read.text(path).filter((F.col("value") != delimiter.join(names)) & (F.col("value") != ""))
    cells = lines.select(F.split("value", f"[{delimiter}]", -1).alias("c")).filter(F.size("c") <= len(names))
    return cells.select([F.coalesce(F.get("c", names.index(n)), F.lit("")).alias(n) for n in (columns or names)])


def quoted(spark: SparkSession, path: str | list[str], rename: dict[str, str] | None = None) -> DataFrame:
    """Comma-separated text with quoting; named columns only (blank headers are left out), renamed."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', nullValue=_NEVER)
    names = [n for n in df.columns if n.strip() and not re.fullmatch(r"_c\d+", n)]
    return df.select([F.coalesce(F.col(f"`{n}`"), F.lit("")).alias((rename or {}).get(n, n)) for n in names])


def tabbed_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected): tab-separated lines under a header; short lines are padded with '', long
    ones set apart with their number of fields."""
    names = header_of(spark, path, "\t")
    lines = spark.read.text(path).filter(F.col("value") != "\t".join(names)).withColumn("c", F.split("value", "\t", -1))
    n = len(names)
    padded = F.concat("c", F.array_repeat(F.lit(""), n))
    good = lines.filter(F.size("c") <= n).select([F.element_at(padded, i + 1).alias(name) for i, name in enumerate(names)])
    return good, lines.filter(F.size("c") > n).select(F.col("value").alias("line"), F.size("c").alias("n_fields"))


def gazetteer_tabbed(spark: SparkSession, path: str, states: tuple[str, ...]) -> DataFrame:
    """(city, state) of a tab-separated list: third column the town, fifth the state; lines whose third
    column is a number are skipped."""
    c = F.split("value", "\t", -1)
    rows = spark.read.text(path).select(F.get(c, 2).alias("city"), F.upper(F.get(c, 4)).alias("state"))
    return rows.filter(F.col("city").try_cast("int").isNull() & F.col("state").isin(*states))


def gazetteer_nested(spark: SparkSession, path: str) -> DataFrame:
    """(city, state) of a nested aggregation: states with buckets of localities."""
    schema = "aggregations struct<states:struct<buckets:array<struct<key:string,localities:struct<buckets:array<struct<key:string>>>>>>>"
    states = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("aggregations.states.buckets").alias("s"))
    return states.select(F.explode("s.localities.buckets").alias("c"), F.upper("s.key").alias("state")).select(F.col("c.key").alias("city"), "state")


def city_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lower("value").alias("city"))


def embeddings(spark: SparkSession, path: str, lower: bool = False) -> DataFrame:
    """(word, vector) of lines 'word x y z'; of a word given twice the last line stands, files being taken
    by name."""
    parts = F.split("value", " ")
    word = F.element_at(parts, 1)
    line = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    rows = spark.read.text(path).select((F.lower(word) if lower else word).alias("word"), F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.cast("double")).alias("vector"), line.alias("line"))
    return rows.groupBy("word").agg(F.max_by("vector", "line").alias("vector"))


def merged(spark: SparkSession, paths: list[str], columns: list[str], delimiter: str = "|", needed: list[str] | None = None) -> DataFrame:
    """Rows of several files of one kind in one scan, without those that lack one of the needed columns
    (by default the first)."""
    rows = piped(spark, paths, columns, delimiter)
    for c in needed or columns[:1]:
        rows = rows.filter(F.col(c) != "")
    return rows


def renamed(spark: SparkSession, path: str | list[str], rename: dict[str, str], constants: dict[str, str] | None = None, delimiter: str = "|") -> DataFrame:
    """Delimited text, gzipped or not, with some columns renamed and constant columns added."""
    rows = piped(spark, path, None, delimiter)
    return rows.withColumnsRenamed({a: b for a, b in rename.items() if a in rows.columns}).withColumns({c: F.lit(v) for c, v in (constants or {}).items()})


def line_count(spark: SparkSession, path: str, header: bool = True) -> int:
    """Lines of a file without its header."""
    return max(0, spark.read.text(path).count() - header)


def unpack(archive: str, target: str, pattern: str | None = None) -> list[Path]:
    """Extracts the plain files of a gzipped tar (those matching the pattern, if one is given); members
    that point outside the target are refused."""
    root = Path(target).resolve()
    out = []
    with tarfile.open(archive, "r:*") as tar:
        for member in tar.getmembers():
            if not member.isfile() or (pattern and not re.search(pattern, member.name)):
                continue
            place = (root / member.name).resolve()
            if root not in place.parents:
                raise SourceError(f"{member.name} points outside of {target}")
            place.parent.mkdir(parents=True, exist_ok=True)
            place.write_bytes(tar.extractfile(member).read())
            out.append(place)
    return out


def only_file(archive: str, pattern: str, target: str) -> Path:
    found = unpack(archive, target, pattern)
    if len(found) != 1:
        raise SourceError(f"{archive} holds {len(found)} files that match {pattern}, not one")
    return found[0]


def listing(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    """(path, size, modified) of the files under a folder of any file system, those of one name if given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    if name:
        files = files.filter(F.element_at(F.split("path", "/"), -1) == name)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def newest_version(spark: SparkSession, folder: str) -> str | None:
    """The largest of the folders, under this one, whose names are all digits, compared as numbers."""
    below = F.slice(F.split(F.element_at(F.split("path", re.escape("/" + folder.rstrip("/").rsplit("/", 1)[-1] + "/")), -1), "/"), 1, 1_000)
    names = listing(spark, folder).select(F.explode(below).alias("p")).filter(F.col("p").rlike("^[0-9]+$"))
    bare = F.regexp_replace("p", "^0+", "")
    return names.agg(F.max_by("p", F.struct(F.length(bare), bare))).first()[0]


def exists(spark: SparkSession, path: str) -> bool:
    return _file_system(spark, path)[0].exists(_file_system(spark, path)[1])


def changed_since(spark: SparkSession, path: str, mark: str | None) -> tuple[bool, str]:
    """(whether the file is another than the one of the mark, its mark now): size and time of change."""
    system, at = _file_system(spark, path)
    if not system.exists(at):
        raise SourceError(f"{path} does not exist")
    status = system.getFileStatus(at)
    now = f"{status.getLen()}-{status.getModificationTime()}"
    return now != mark, now


def pull_only(spark: SparkSession, folder: str, suffix: str) -> str:
    """The path of the one file of a folder that ends so."""
    found = [r.path for r in listing(spark, folder).filter(F.col("path").endswith(suffix)).select("path").limit(2).collect()]
    if len(found) != 1:
        raise SourceError(f"{folder} must hold exactly one file that ends with {suffix}")
    return found[0]


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def hyperparameters(path: str) -> dict:
    """Parameters of a search from a JSON file: numbers given as text become numbers."""
    if not Path(path).is_file():
        raise SourceError(f"there are no parameters at {path}")
    number = lambda v: float(v) if isinstance(v, str) and re.fullmatch(r"-?\d+(\.\d+)?", v) else v
    return {k: number(v) for k, v in json_object(path).items()}


def json_object(path_or_object) -> dict:
    return path_or_object if isinstance(path_or_object, dict) else json.loads(Path(path_or_object).read_text(encoding="utf-8"))


TRANSACTION = T.StructType(
    [T.StructField("transaction_id", T.LongType()), T.StructField("description", T.StringType()), T.StructField("amount", T.DoubleType()), T.StructField("ledger_entry", T.StringType()), T.StructField("date", T.StringType())]
)
REQUEST = T.StructType(
    [T.StructField("cobrand_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("container", T.StringType()), T.StructField("debug", T.BooleanType()), T.StructField("services_list", T.ArrayType(T.StringType())), T.StructField("transaction_list", T.ArrayType(TRANSACTION))]
)
MOST_TRANSACTIONS = 1_000


def request_rows(requests: DataFrame, body: str = "value", request: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """(rows, refused): the transactions of JSON requests, one row each with its position, and the
    requests that break the input schema with the reason. Works on streams as well."""
    parsed = requests.withColumn("_r", F.from_json(F.col(body), REQUEST))
    items = F.col("_r.transaction_list")
    complete = F.forall(items, lambda t: t["transaction_id"].isNotNull() & t["description"].isNotNull() & t["amount"].isNotNull() & t["ledger_entry"].isin("debit", "credit") & t["date"].isNotNull())
    reason = (
        F.when(F.col("_r.cobrand_id").isNull() & items.isNull(), "not an object of the schema")
        .when(F.col("_r.cobrand_id").isNull() | F.col("_r.user_id").isNull(), "cobrand_id or user_id is missing")
        .when(~F.coalesce(F.col("_r.container").isin("bank", "card"), F.lit(False)), "container must be bank or card")
        .when(~F.coalesce(F.size(items).between(1, MOST_TRANSACTIONS), F.lit(False)), f"transaction_list must hold 1 to {MOST_TRANSACTIONS} items")
        .when(~F.coalesce(complete, F.lit(False)), "a transaction lacks a field or has a wrong one")
        .when(F.size(F.array_distinct(items)) < F.size(items), "transactions must be unique")
    )
    checked = parsed.withColumn("reason", reason)
    good = checked.filter("reason is null").select(request, "_r.container", F.coalesce("_r.debug", F.lit(False)).alias("debug"), "_r.services_list", F.posexplode("_r.transaction_list").alias("pos", "t"))
    return good.select(request, "container", "debug", "services_list", "pos", "t.*"), checked.filter("reason is not null").select(request, "reason")
