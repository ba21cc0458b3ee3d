"""Queries of the operators for rejected rows and for skewed keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rejects, skew
from ..session import table
from .registry import registry

QUERIES, SQL, query = registry()

ORDER = ["loaded_at", "transaction_id"]


_FIELD = '("([^"]|"")*"|[^"|]*)'
_P3 = f"""WITH q AS (SELECT line_id, raw_line AS l, regexp_full_match(raw_line, '(?s){_FIELD}([|]{_FIELD})*') AS quoted FROM raw_transactions),
  f AS (SELECT line_id, quoted, list_transform(regexp_extract_all('|' || l, '(?s)[|]("(?:[^"]|"")*"|[^"|]*)', 1), lambda x: CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS v FROM q),
  r AS (SELECT line_id, CASE WHEN NOT quoted THEN 'quoting' WHEN len(v) <> 7 THEN 'column_count'
    WHEN NOT (regexp_full_match(v[1], '[0-9]+') AND regexp_full_match(v[2], '[0-9]*') AND regexp_full_match(v[3], '-?[0-9]+([.][0-9]{{1,2}})?') AND regexp_full_match(v[4], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast(v[4] AS DATE) IS NOT NULL
      AND v[5] IN ('credit', 'debit') AND regexp_matches(v[6], '[^\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}]') AND NOT regexp_matches(v[6], '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{{FFFD}}]')
      AND regexp_full_match(v[7], '|NULL|[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}')) THEN 'value' END AS reason, v FROM f) """


@query(_P3 + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL")
def p3_found(s, d):
    return rejects.rejected(table(s, d, "raw_transactions"), "line_id").select("line_id", "reason")


@query(_P3 + "SELECT line_id, try_cast(v[1] AS BIGINT) AS transaction_id, v[2] AS unique_mem_id, CAST(v[3] AS DOUBLE) AS amount, CAST(v[4] AS DATE) AS transaction_date, v[5] AS ledger_entry, v[6] AS description_unmasked, v[7] AS factual_id FROM r WHERE reason IS NULL")
def p3_accepted(s, d):
    return rejects.accepted(table(s, d, "raw_transactions"), "line_id")


_CHECKS = {
    "transaction_id": "regexp_full_match(v[1], '[0-9]+')",
    "unique_mem_id": "regexp_full_match(v[2], '[0-9]*')",
    "amount": "regexp_full_match(v[3], '-?[0-9]+([.][0-9]{1,2})?')",
    "transaction_date": "regexp_full_match(v[4], '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(v[4] AS DATE) IS NOT NULL",
    "ledger_entry": "v[5] IN ('credit', 'debit')",
    "description_unmasked": r"regexp_matches(v[6], '[^\s\x{a0}\x{2000}-\x{200a}]') AND NOT regexp_matches(v[6], '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{FFFD}]')",
    "factual_id": "regexp_full_match(v[7], '|NULL|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}')",
}
_BAD = "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN NOT ({test}) THEN '{name}' END" for name, test in _CHECKS.items()) + "], lambda x: x IS NOT NULL)), ',')"


@query(_P3 + f"SELECT reason, CASE WHEN reason = 'value' THEN {_BAD} ELSE '' END AS bad_columns, count(*) AS n_lines FROM r WHERE reason IS NOT NULL GROUP BY 1, 2")
def p3_reasons(s, d):
    return rejects.split_feed(table(s, d, "raw_transactions"), "line_id")[1].groupBy("reason", "bad_columns").agg(F.count(F.lit(1)).alias("n_lines"))


@query("""SELECT merchant_name FROM labeled_transactions WHERE regexp_matches(merchant_name, '\\S')
    GROUP BY merchant_name HAVING count(*) * 100 >= 3 * (SELECT count(*) FROM labeled_transactions)""")
def p5_found(s, d):
    return skew.heavy_keys(table(s, d, "labeled_transactions"), "merchant_name", "transaction_date", "amount", ORDER).select("merchant_name")


@query("""WITH g AS (SELECT merchant_name, transaction_date AS t, amount, transaction_date - lag(transaction_date) OVER (PARTITION BY merchant_name ORDER BY transaction_date) AS gap FROM labeled_transactions)
    SELECT merchant_name, count(*) AS n, CAST(round(sum(amount)) AS BIGINT) AS total, CAST(min(t) AS DATE) AS first_at, CAST(max(t) AS DATE) AS last_at, CAST(max(gap) AS BIGINT) AS longest_gap_days FROM g GROUP BY merchant_name""")
def p5_per_key(s, d):
    out = skew.per_key(table(s, d, "labeled_transactions"), "merchant_name", "transaction_date", "amount", ORDER)
    return out.select("merchant_name", "n", F.round("total").cast("bigint").alias("total"), F.col("first_at").cast("date").alias("first_at"), F.col("last_at").cast("date").alias("last_at"), F.col("longest_gap_days").cast("bigint").alias("longest_gap_days"))
