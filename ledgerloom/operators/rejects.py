"""Rows that fail to parse: typed rows on one side, rejected rows with their reason on the other.

A delimited record is parsed with array expressions only (no Python, no backtracking pattern over the
record). Splitting a record at its quote characters gives segments; those at odd positions lie
inside quotes. A record is well quoted exactly if the number of quotes is even, every segment
outside quotes is either empty between two quoted pieces (an escaped quote) or is bounded by
delimiters next to the quotes.

The parsed cells are exploded into (row, column, value), joined with a rule table, validated and the
failures aggregated per row; clean rows are those left by an anti join with the failures. A record is
parsed once: one that has no cells of its own (broken quoting, wrong number of fields) is exploded into
one that stands for its failure. Only cells that fail are shuffled, so the cost of the aggregation follows
the number of failures.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

QUOTING, COLUMN_COUNT, VALUE = "quoting", "column_count", "value"


@dataclass(frozen=True)
class Rule:
    """One column of a feed: its name, the kind of value it must hold and the type it is given."""

    name: str
    kind: str
    sql_type: str = "string"


#: The feed of delivered transactions.
TRANSACTION_RULES = (
    Rule("transaction_id", "digits", "bigint"),
    Rule("unique_mem_id", "digits_or_empty"),
    Rule("amount", "money", "double"),
    Rule("transaction_date", "iso_day", "date"),
    Rule("ledger_entry", "ledger"),
    Rule("description_unmasked", "clean_text"),
    Rule("factual_id", "id_or_null"),
)

_HEX = "[0-9a-f]"


def _full(value: Column, pattern: str) -> Column:
    return value.rlike(rf"\A(?:{pattern})\z")


def _day(value: Column) -> Column:
    return _full(value, "[0-9]{4}-[0-9]{2}-[0-9]{2}") & ~value.startswith("0000") & F.try_to_date(value, "yyyy-MM-dd").isNotNull()


#: Kinds of value, each a test over a string column.
KINDS = {
    "any": lambda v: F.lit(True),
    "digits": lambda v: _full(v, "[0-9]+"),
    "digits_or_empty": lambda v: _full(v, "[0-9]*"),
    "money": lambda v: _full(v, r"-?[0-9]+(?:\.[0-9]{1,2})?"),
    "iso_day": _day,
    "ledger": lambda v: v.isin("credit", "debit"),
    "clean_text": lambda v: v.rlike(r"(?U)\S") & ~v.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F�]"),
    "id_or_null": lambda v: _full(v, f"|NULL|{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}"),
}


def well_quoted(line: Column, delimiter: str = "|") -> Column:
    """Whether every quoted field is closed and followed by the delimiter or the end, and no
    unquoted field holds a quote."""
    parts = F.split(line, '"', -1)
    last = F.size(parts) - 1

    def outside(part: Column, i: Column) -> Column:
        opens = (i == last) | part.endswith(delimiter) | ((i == 0) & (part == ""))
        closes = (i == 0) | part.startswith(delimiter) | ((i == last) & (part == ""))
        escaped = (i > 0) & (i < last) & (part == "")
        return escaped | (opens & closes)

    sound = F.forall(F.transform(parts, lambda p, i: (i % 2 == 1) | outside(p, i)), lambda x: x)
    return (F.size(parts) % 2 == 1) & sound


def fields_of(line: Column, delimiter: str = "|") -> Column:
    """The fields of a well quoted record. Delimiters and backslashes inside quotes are escaped, the
    record is split and the escapes undone."""
    parts = F.split(line, '"', -1)
    last = F.size(parts) - 1
    plain = F.transform(
        parts,
        lambda p, i: F.when(i % 2 == 1, F.replace(F.replace(p, F.lit("\\"), F.lit("\\s")), F.lit(delimiter), F.lit("\\p")))
        .when((i > 0) & (i < last) & (p == ""), F.lit('"'))
        .otherwise(F.replace(p, F.lit("\\"), F.lit("\\s"))),
    )
    cut = F.split(F.array_join(plain, ""), f"[{delimiter}]", -1)
    return F.transform(cut, lambda f: F.replace(F.replace(f, F.lit("\\p"), F.lit(delimiter)), F.lit("\\s"), F.lit("\\")))


def parse(df: DataFrame, line: str = "raw_line", delimiter: str = "|") -> DataFrame:
    """Adds _quoted (bool) and _cells (the fields, or NULL where the quoting is broken)."""
    text = F.coalesce(F.col(line), F.lit(""))
    return df.withColumn("_quoted", well_quoted(text, delimiter)).withColumn("_cells", F.when(F.col("_quoted"), fields_of(text, delimiter)))


def rule_table(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    schema = T.StructType([T.StructField("_pos", T.IntegerType()), T.StructField("_column", T.StringType()), T.StructField("_kind", T.StringType())])
    return df.sparkSession.createDataFrame([(i, r.name, r.kind) for i, r in enumerate(rules)], schema)


def failed_cells(parsed: DataFrame, rows: list[str], rules: tuple[Rule, ...] = TRANSACTION_RULES) -> DataFrame:
    """One row per failure of parsed records: (*rows, _reason, _column). The rule table has one row per
    column of the feed, so its broadcast is bounded by the feed's definition."""
    none = F.lit(None).cast("string")
    cells = (
        F.when(~F.col("_quoted"), F.array(F.struct(F.lit(-2).alias("_pos"), none.alias("_value"))))
        .when(F.size("_cells") != len(rules), F.array(F.struct(F.lit(-1).alias("_pos"), none.alias("_value"))))
        .otherwise(F.transform("_cells", lambda v, i: F.struct(i.alias("_pos"), v.alias("_value"))))
    )
    checked = parsed.select(*rows, F.explode(cells).alias("_c")).select(*rows, "_c.*").join(F.broadcast(rule_table(parsed, rules)), "_pos", "left")
    valid = F.lit(False)
    for kind in sorted({r.kind for r in rules}):
        valid = F.when(F.col("_kind") == kind, KINDS[kind](F.col("_value"))).otherwise(valid)
    reason = F.when(F.col("_pos") == -2, QUOTING).when(F.col("_pos") == -1, COLUMN_COUNT).otherwise(VALUE)
    return checked.filter(~valid).select(*rows, reason.alias("_reason"), "_column")


def rejected(df: DataFrame, key: str, line: str = "raw_line", rules: tuple[Rule, ...] = TRANSACTION_RULES, delimiter: str = "|") -> DataFrame:
    """The failing records: (key, reason, bad_columns), reason being the first that applies in the
    order quoting, column_count, value, and bad_columns the names of the columns with bad values.

    A NULL or empty record has one empty field and fails for its column count. Several records with
    one key give one row. An empty table gives no rows; other columns of df are not looked at.
    """
    parsed = parse(df.select(F.col(key), F.col(line)), line, delimiter)
    return _by_row(failed_cells(parsed, [key], rules), [key])


def _by_row(failures: DataFrame, rows: list[str]) -> DataFrame:
    order = F.when(F.col("_reason") == QUOTING, 0).when(F.col("_reason") == COLUMN_COUNT, 1).otherwise(2)
    return failures.groupBy(*rows).agg(F.min_by("_reason", order).alias("reason"), F.array_join(F.array_sort(F.collect_set("_column")), ",").alias("bad_columns"))


def split_feed(df: DataFrame, key: str, line: str = "raw_line", rules: tuple[Rule, ...] = TRANSACTION_RULES, delimiter: str = "|") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): the clean records with typed columns beside the key, and (key, record, reason,
    bad_columns) of the others. Every record is on one side, once.

    Records are told apart by their place in the table, not by the key, so that NULL and repeated keys
    do no harm: each record is judged by itself. Digits beyond the range of a long give NULL in the
    typed column. Columns of df other than the key and the record are not carried, so no name can
    clash. An empty table gives two empty ones.
    """
    slim = df.select(F.col(key).alias("_key"), F.col(line).alias("_line"))
    parsed = cut(parse(slim, "_line", delimiter).withColumn("_row", F.monotonically_increasing_id()))
    failures = cut(_by_row(failed_cells(parsed, ["_row"], rules), ["_row"]))
    clean = parsed.join(failures.select("_row"), "_row", "left_anti")
    typed = [(F.get("_cells", i) if r.sql_type == "string" else F.get("_cells", i).try_cast(r.sql_type)).alias(r.name) for i, r in enumerate(rules)]
    bad = parsed.select("_row", F.col("_key").alias(key), F.col("_line").alias(line)).join(failures, "_row").drop("_row")
    return clean.select(F.col("_key").alias(key), *typed), bad


def accepted(df: DataFrame, key: str, line: str = "raw_line", rules: tuple[Rule, ...] = TRANSACTION_RULES, delimiter: str = "|") -> DataFrame:
    """The clean records of split_feed()."""
    return split_feed(df, key, line, rules, delimiter)[0]
