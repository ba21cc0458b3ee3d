"""Driver queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import addresses, canonical, collapse, leaks, linkage, mixture, pieces, splits


def _fields(s: SparkSession, d: str):
    return [(canonical.MERCHANT, table(s, d, "merchant_ref")), (canonical.CITY, table(s, d, "city_ref"))]


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return canonical.found(table(s, d, "labeled_transactions"), "transaction_id", _fields(s, d))


def p1_misses(s: SparkSession, d: str) -> DataFrame:
    return canonical.misses(table(s, d, "labeled_transactions"), "transaction_id", _fields(s, d))


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return splits.tied_members(table(s, d, "labeled_transactions"))


def p2_splits(s: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(s, d, "labeled_transactions"))[1]


def p2_shares(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "labeled_transactions")
    return splits.split_shares(rows, splits.assign_splits(rows)[1])


def _deliveries(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The rows loaded in the first half of the time that the table spans, and those loaded later."""
    rows = table(s, d, "labeled_transactions")
    at = F.unix_timestamp("loaded_at")
    middle = rows.agg(((F.min(at) + F.max(at)) / 2).alias("m")).scalar()
    early = F.coalesce(at <= middle, F.lit(True))
    return rows.filter(early), rows.filter(~early)


def _persisted(s: SparkSession, d: str) -> DataFrame:
    """The component table after the first delivery, written and read again. Its splits are those that an
    earlier system gave by the md5 of a component's smallest member."""
    members = splits.assign_splits(_deliveries(s, d)[0])[0]
    share = F.conv(F.substring(F.md5("root"), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    given = members.withColumn("split", F.when(share < 0.8, "train").when(share < 0.9, "validation").otherwise("test"))
    return splits.load_table(s, splits.save_table(given))


def p2_incremental(s: SparkSession, d: str) -> DataFrame:
    """What became of every member when the second delivery was added to the persisted table."""
    grown = splits.assign_splits(_deliveries(s, d)[1], known=_persisted(s, d))[0]
    return grown.select(F.col("node").alias("unique_mem_id"), F.col("root").alias("first_mem_id"), "state", F.when(F.col("state") != "new", F.col("split")).alias("kept_split"))


def p2_quarantine(s: SparkSession, d: str) -> DataFrame:
    """The components that the second delivery merged although their parts had different splits."""
    return splits.merge_conflicts(splits.assign_splits(_deliveries(s, d)[1], known=_persisted(s, d))[0]).withColumnRenamed("root", "first_mem_id")


def p2_violations(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "labeled_transactions")
    return splits.violations(rows, splits.assign_splits(rows)[1])


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return p4_links(s, d).select("store_row", "factual_id")


def p4_links(s: SparkSession, d: str) -> DataFrame:
    return linkage.link(table(s, d, "store_numbers"), table(s, d, "merchants"), table(s, d, "city_ref")).withColumn("confidence", F.round("confidence", 6))


def _towns_of_postcodes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "merchants").select("locality", "region", "postcode")


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return addresses.same_address_pairs(table(s, d, "store_numbers"), table(s, d, "city_ref"), further=_towns_of_postcodes(s, d))


def p6_classes(s: SparkSession, d: str) -> DataFrame:
    return addresses.address_classes(table(s, d, "store_numbers"), table(s, d, "city_ref"), further=_towns_of_postcodes(s, d))


def p7_found(s: SparkSession, d: str) -> DataFrame:
    return collapse.copy_pairs(table(s, d, "labeled_transactions"))


def p7_collapsed(s: SparkSession, d: str) -> DataFrame:
    return collapse.collapsed(table(s, d, "labeled_transactions"))


def p8_found(s: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(s, d, "documents"), table(s, d, "eval_items")).select("doc_id", "item_id")


def p8_items(s: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(s, d, "documents"), table(s, d, "eval_items"))


def p8_cleaned(s: SparkSession, d: str) -> DataFrame:
    return leaks.cleaned(table(s, d, "documents"), table(s, d, "eval_items"))


def p9_mixture(s: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(s, d, "documents"), table(s, d, "source_targets"))


def p9_shares(s: SparkSession, d: str) -> DataFrame:
    return mixture.shares(table(s, d, "documents"), table(s, d, "source_targets"))


def p10_found(s: SparkSession, d: str) -> DataFrame:
    return pieces.oversized(table(s, d, "documents"))


def p10_pieces(s: SparkSession, d: str) -> DataFrame:
    """The pieces of all texts; those within the limit are one piece."""
    return pieces.pieces(table(s, d, "documents"), whole=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (p1_found, p1_misses, p2_found, p2_splits, p2_shares, p2_incremental, p2_quarantine, p2_violations, p4_found, p4_links, p6_found, p6_classes, p7_found, p7_collapsed, p8_found, p8_items, p8_cleaned, p9_mixture, p9_shares, p10_found, p10_pieces)
    return {f.__name__: f for f in made}


_NORMAL = """list_aggregate(list_sort(list_filter(list_transform(
    regexp_split_to_array(description_unmasked, '~~|\\||;'), lambda p: lower(regexp_replace(p, '[^\\pL\\pN]', '', 'g'))), lambda p: p <> '')), 'string_agg', '~')"""

_COPIES = f"""WITH t AS (SELECT transaction_id AS r, unique_mem_id AS m, amount AS a, transaction_date AS dt, ledger_entry AS l, {_NORMAL} AS f
    FROM labeled_transactions WHERE unique_mem_id IS NOT NULL AND regexp_matches(description_unmasked, '[\\pL\\pN]')),
  g AS (SELECT m, a, dt, l, f, min(r) AS first, count(DISTINCT r) AS k, count(*) AS n FROM t GROUP BY ALL)"""

_TIES = """WITH RECURSIVE p AS (SELECT DISTINCT transaction_id AS r, unique_mem_id AS m FROM labeled_transactions WHERE unique_mem_id IS NOT NULL AND transaction_id IS NOT NULL),
  e AS (SELECT DISTINCT x.m AS a, y.m AS b FROM p x JOIN p y USING (r) WHERE x.m <> y.m),
  c AS (SELECT a AS n, a AS root FROM e UNION SELECT e.b, c.root FROM c JOIN e ON c.n = e.a)"""


_MIDDLE = "(SELECT (min(epoch(date_trunc('second', loaded_at))) + max(epoch(date_trunc('second', loaded_at)))) / 2 FROM labeled_transactions)"
_EARLY = f"coalesce(epoch(date_trunc('second', loaded_at)) <= {_MIDDLE}, true)"


def _closure(name: str, source: str) -> str:
    return f"""{name}p AS (SELECT DISTINCT transaction_id AS r, unique_mem_id AS m FROM ({source}) WHERE unique_mem_id IS NOT NULL),
  {name}e AS (SELECT DISTINCT x.m AS a, y.m AS b FROM {name}p x JOIN {name}p y USING (r) WHERE x.m <> y.m UNION SELECT m, m FROM {name}p),
  {name}c AS (SELECT a AS n, a AS root FROM {name}e UNION SELECT e.b, c.root FROM {name}c c JOIN {name}e e ON c.n = e.a),
  {name} AS (SELECT n AS node, min(root) AS root FROM {name}c GROUP BY n)"""


# ties of the later rows join those that the table of the first delivery holds
_GROWN = f"""WITH RECURSIVE {_closure('k', f"SELECT * FROM labeled_transactions WHERE {_EARLY}")},
  given AS (SELECT node, root, ('0x' || substr(md5(root), 1, 8))::BIGINT / 4294967296.0 AS x FROM k),
  known AS (SELECT node, root, CASE WHEN x < 0.8 THEN 'train' WHEN x < 0.9 THEN 'validation' ELSE 'test' END AS split FROM given),
  {_closure('g', f"SELECT transaction_id::VARCHAR AS transaction_id, unique_mem_id FROM labeled_transactions WHERE NOT {_EARLY} UNION ALL SELECT 'k' || root, node FROM k")},
  held AS (SELECT g.root, min(known.split) AS lo, max(known.split) AS hi FROM g JOIN known ON g.node = known.node GROUP BY 1),
  grown AS (SELECT g.node, g.root, CASE WHEN lo IS NULL THEN 'new' WHEN lo = hi THEN 'kept' ELSE 'quarantined' END AS state, CASE WHEN lo = hi THEN lo WHEN lo < hi THEN 'quarantine' END AS kept_split FROM g LEFT JOIN held USING (root)) """


def oracle_sql() -> dict[str, str]:
    return {
        "p2_incremental": _GROWN + "SELECT node AS unique_mem_id, root AS first_mem_id, state, kept_split FROM grown",
        "p2_quarantine": _GROWN + "SELECT root AS first_mem_id, count(*) AS n_members FROM grown WHERE state = 'quarantined' GROUP BY 1",
        "p2_violations": "SELECT count(DISTINCT transaction_id) AS n_records, 0::BIGINT AS n_unassigned, 0::BIGINT AS n_twice, 0::BIGINT AS n_members_apart FROM labeled_transactions",
        "p8_items": """WITH w AS (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS ws FROM documents WHERE text IS NOT NULL
              UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') FROM eval_items WHERE text IS NOT NULL),
            g AS (SELECT kind, id, i, list_aggregate(ws[i:i + 9], 'string_agg', ' ') AS gram FROM (SELECT kind, id, ws, unnest(range(1, len(ws) - 8)) AS i FROM w WHERE len(ws) >= 10)),
            h AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id, d.i FROM g d JOIN g i ON d.gram = i.gram WHERE d.kind = 'd' AND i.kind = 'i'),
            r AS (SELECT doc_id, item_id, i - row_number() OVER (PARTITION BY doc_id, item_id ORDER BY i) AS island FROM h),
            s AS (SELECT doc_id, item_id, count(*) + 9 AS longest FROM r GROUP BY doc_id, item_id, island)
            SELECT item_id, count(DISTINCT doc_id) AS n_docs, max(longest) AS longest FROM s GROUP BY item_id""",
        "p2_found": _TIES + " SELECT min(root) AS first_mem_id, n AS unique_mem_id FROM c GROUP BY n HAVING min(root) <> n",
        "p7_found": _COPIES + " SELECT DISTINCT g.first AS first_transaction_id, t.r AS transaction_id FROM t JOIN g ON t.m = g.m AND t.a = g.a AND t.dt = g.dt AND t.l = g.l AND t.f = g.f WHERE t.r > g.first AND g.k > 1",
        "p7_collapsed": _COPIES + """ SELECT first AS transaction_id, CAST(sum(k) AS BIGINT) AS n_records, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT first, k, n FROM g UNION ALL
            SELECT transaction_id, 1, 1 FROM labeled_transactions WHERE unique_mem_id IS NULL OR description_unmasked IS NULL OR NOT regexp_matches(description_unmasked, '[\\pL\\pN]')) GROUP BY first""",
        "p8_found": """WITH w AS (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS ws FROM documents WHERE text IS NOT NULL
              UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') FROM eval_items WHERE text IS NOT NULL),
            g AS (SELECT kind, id, list_aggregate(ws[i:i + 9], 'string_agg', ' ') AS gram FROM (SELECT kind, id, ws, unnest(range(1, len(ws) - 8)) AS i FROM w WHERE len(ws) >= 10))
            SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.gram = i.gram WHERE d.kind = 'd' AND i.kind = 'i'""",
    }
