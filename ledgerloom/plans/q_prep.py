"""Queries of preparation, evaluation and quality gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import documents, prep, quality
from ..session import bounded_rows, sized_broadcast, table
from .registry import registry

QUERIES, SQL, query = registry()

LT = "labeled_transactions"
_B = "coalesce(description_unmasked, '')"
_A = "coalesce(description, '')"


@query(f"SELECT transaction_id, CASE WHEN {_B} = '' THEN {_A} ELSE {_B} END AS text FROM {LT}")
def fill_description(s, d):
    return prep.fill_primary(table(s, d, LT), "description_unmasked", "description").select("transaction_id", F.col("description_unmasked").alias("text"))


@query(f"SELECT count(*) FILTER (WHERE {_A} <> '' OR {_B} <> '') AS kept, count(*) FILTER (WHERE {_A} = '' AND {_B} = '') AS dropped FROM {LT}")
def drop_empty(s, d):
    empty = prep.both_empty("description_unmasked", "description").cast("long")
    return table(s, d, LT).agg(F.sum(1 - empty).alias("kept"), F.sum(empty).alias("dropped"))


@query(f"SELECT transaction_id, loaded_at::DATE AS loaded, ledger_entry AS side FROM {LT} WHERE lower(ledger_entry) = 'credit'")
def ledger_split(s, d):
    return prep.by_ledger(table(s, d, LT), "ledger_entry")["credit"].select("transaction_id", F.col("loaded_at").cast("date").alias("loaded"), F.col("ledger_entry").alias("side"))


@query("SELECT line_id, row_number() OVER (ORDER BY line_id) - 1 AS row_no FROM raw_transactions")
def row_number_id(s, d):
    return prep.row_numbers(table(s, d, "raw_transactions").select("line_id"), ["line_id"], buckets=16).select("line_id", "row_no")


@query("SELECT line_id, (row_number() OVER (ORDER BY line_id) - 1) // 128 AS batch FROM raw_transactions")
def batches(s, d):
    numbered = prep.row_numbers(table(s, d, "raw_transactions").select("line_id"), ["line_id"], buckets=16)
    return numbered.select("line_id", prep.batch_of(F.col("row_no"), 128).alias("batch"))


@query(f"SELECT t.transaction_id, m.merchant_id AS label_num FROM {LT} t JOIN merchant_ref m ON t.merchant_name = m.canonical_name")
def label_map_join(s, d):
    labels = table(s, d, "merchant_ref").select(F.col("merchant_id").alias("label_num"), F.col("canonical_name").alias("label"))
    return prep.map_labels(table(s, d, LT).select("transaction_id", "merchant_name"), labels, "merchant_name").select("transaction_id", "label_num")


@query("SELECT trade, max(merchant_id) AS merchant_id FROM merchant_ref GROUP BY trade")
def label_map_reverse(s, d):
    return prep.reverse_map(table(s, d, "merchant_ref"), "merchant_id", "trade")


@query(f"SELECT count(*) AS n_dropped FROM {LT} t WHERE NOT EXISTS (SELECT 1 FROM merchant_ref m WHERE m.canonical_name = t.merchant_name)")
def unmapped_drop(s, d):
    labels = sized_broadcast(table(s, d, "merchant_ref").select(F.col("canonical_name").alias("merchant_name")))
    return table(s, d, LT).join(labels, "merchant_name", "left_anti").agg(F.count(F.lit(1)).alias("n_dropped"))


@query(f"SELECT transaction_id, unique_mem_id, CASE WHEN ('0x' || substr(md5(CAST(transaction_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 <= 0.9 THEN 'train' ELSE 'test' END AS part FROM {LT}")
def hash_split(s, d):
    return prep.hash_split(table(s, d, LT), "transaction_id").select("transaction_id", "unique_mem_id", "part")


@query(f"""WITH c AS (SELECT proposed_subtype, count(*) AS n FROM {LT} GROUP BY 1), t AS (SELECT count(*) AS n, count(DISTINCT proposed_subtype) AS k FROM {LT})
    SELECT proposed_subtype, round(0.5 / t.n + 0.5 / (t.k * c.n), 10) AS weight, count(*) AS n_rows FROM {LT} JOIN c USING (proposed_subtype), t GROUP BY ALL""")
def balanced_weights(s, d):
    return prep.balanced_weights(table(s, d, LT), "proposed_subtype").groupBy("proposed_subtype", F.round("weight", 10).alias("weight")).agg(F.count(F.lit(1)).alias("n_rows"))


@query()
def random_sample(s, d):
    return prep.exact_sample(table(s, d, LT).select("transaction_id"), 100, 7)


@query("SELECT place_name AS name, address AS street, locality AS city FROM merchants")
def rename_fields(s, d):
    return prep.with_fields(table(s, d, "merchants"), {"place_name": "name", "address": "street", "locality": "city"})


@query("SELECT row_number() OVER (ORDER BY transaction_id, unique_mem_id, loaded_at) AS request_pos, transaction_id, description AS text, 'credit' AS ledger_entry FROM labeled_transactions")
def request_adapter(s, d):
    return documents.adapted_requests(table(s, d, LT), {"transaction_id": "transaction_id", "description": "text"}, ["transaction_id", "unique_mem_id", "loaded_at"])


# ---- machine against human labels: the masked description's text stands in for the machine

_MACHINE = f"SELECT transaction_id AS id, CASE WHEN transaction_id % 11 = 0 THEN '' WHEN transaction_id % 7 = 0 THEN 'Purchase - Card' ELSE upper(proposed_subtype) END AS label FROM (SELECT transaction_id, min(proposed_subtype) AS proposed_subtype FROM {LT} GROUP BY 1)"
_HUMAN = f"SELECT transaction_id AS id, max_by(proposed_subtype, loaded_at) AS label FROM {LT} WHERE transaction_id % 5 <> 0 GROUP BY 1"
_STATUS = f"SELECT m.id, CASE WHEN m.label = '' THEN 'unlabeled' WHEN coalesce(h.label, '') = '' THEN 'needs_hand' WHEN lower(m.label) = lower(h.label) THEN 'correct' ELSE 'mislabeled' END AS status FROM ({_MACHINE}) m LEFT JOIN ({_HUMAN}) h USING (id)"


def _machine(s, d):
    t = table(s, d, LT).groupBy("transaction_id").agg(F.min("proposed_subtype").alias("p"))
    return t.select(F.col("transaction_id").alias("id"), F.when(F.col("transaction_id") % 11 == 0, "").when(F.col("transaction_id") % 7 == 0, "Purchase - Card").otherwise(F.upper("p")).alias("label"))


def _human(s, d):
    t = table(s, d, LT).filter("transaction_id % 5 <> 0").select(F.col("transaction_id").alias("id"), F.col("proposed_subtype").alias("label"), "loaded_at")
    return ev.last_wins(t, "id", ["loaded_at"]).select("id", "label")


def _status(s, d):
    return ev.accuracy_status(_machine(s, d), _human(s, d), "id", "label", "label")


@query(_STATUS)
def accuracy_status(s, d):
    return _status(s, d).select("id", "status")


@query(f"""WITH s AS ({_STATUS}), c AS (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'unlabeled') AS unlabeled, count(*) FILTER (WHERE status = 'needs_hand') AS needs_hand, count(*) FILTER (WHERE status = 'correct') AS correct, count(*) FILTER (WHERE status = 'mislabeled') AS mislabeled FROM s)
    SELECT *, round((total - unlabeled) * 100.0::DOUBLE / total, 6) AS labeled_percent, round((total - unlabeled - needs_hand) * 100.0::DOUBLE / total, 6) AS verified_percent, round(correct * 100.0::DOUBLE / greatest(total - unlabeled - needs_hand, 1), 6) AS predictive_accuracy FROM c""")
def accuracy_metrics(s, d):
    return ev.accuracy_metrics(_status(s, d))


@query(f"SELECT round(count(*) FILTER (WHERE is_physical_transaction = '1') * 100.0::DOUBLE / count(*), 6) AS physical_percent, round(count(*) FILTER (WHERE is_physical_transaction <> '1') * 100.0::DOUBLE / count(*), 6) AS other_percent FROM {LT}")
def physical_percent(s, d):
    return ev.physical_percents(table(s, d, LT), "is_physical_transaction")


@query(f"SELECT transaction_id, loaded_at::DATE AS loaded FROM {LT} WHERE coalesce(merchant_name, '') = '' AND description_unmasked IN (SELECT description_unmasked FROM {LT} WHERE is_physical_transaction = '0')")
def binary_semi(s, d):
    t = table(s, d, LT)
    rows = t.filter(F.coalesce("merchant_name", F.lit("")) == "")
    return ev.flagged_once(rows, t, "description_unmasked", "is_physical_transaction", "0").select("transaction_id", F.col("loaded_at").cast("date").alias("loaded"))


@query(f"SELECT a.transaction_id, count(*) AS n FROM {LT} a JOIN {LT} b ON a.description_unmasked = b.description_unmasked WHERE a.is_physical_transaction = '0' AND b.is_physical_transaction = '0' AND a.description_unmasked <> '' GROUP BY 1")
def binary_inner(s, d):
    t = table(s, d, LT).filter("description_unmasked <> ''")
    return ev.flagged_each(t.filter("is_physical_transaction = '0'").select("transaction_id", "description_unmasked"), t, "description_unmasked", "is_physical_transaction", "0").groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n"))


_CONF = f"SELECT proposed_subtype AS actual, CASE WHEN transaction_id % 9 = 0 THEN 'Fees - Service' ELSE proposed_subtype END AS predicted, count(*) AS n FROM {LT} GROUP BY 1, 2"


def _confusion(s, d):
    t = table(s, d, LT).withColumn("p", F.when(F.col("transaction_id") % 9 == 0, "Fees - Service").otherwise(F.col("proposed_subtype")))
    return ev.confusion(t, "proposed_subtype", "p")


@query(_CONF)
def confusion_long(s, d):
    return _confusion(s, d)


@query(f"SELECT a.l AS actual, p.l AS predicted, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT proposed_subtype AS l FROM {LT}) a CROSS JOIN (SELECT DISTINCT proposed_subtype AS l FROM {LT}) p LEFT JOIN ({_CONF}) c ON c.actual = a.l AND c.predicted = p.l")
def confusion_grid(s, d):
    classes = [r[0] for r in bounded_rows(table(s, d, LT).select("proposed_subtype").distinct(), 10_000, "the classes")]
    return ev.confusion_grid(_confusion(s, d), classes)


@query(f"SELECT side AS actual, CAST(count(*) FILTER (WHERE NOT flip AND side = 'credit' OR flip AND side = 'debit') AS BIGINT) AS credit, CAST(count(*) FILTER (WHERE NOT flip AND side = 'debit' OR flip AND side = 'credit') AS BIGINT) AS debit FROM (SELECT ledger_entry AS side, transaction_id % 13 = 0 AS flip FROM {LT}) GROUP BY 1")
def confusion_pivot(s, d):
    other = F.when(F.col("ledger_entry") == "credit", "debit").otherwise("credit")
    t = table(s, d, LT).withColumn("p", F.when(F.col("transaction_id") % 13 == 0, other).otherwise(F.col("ledger_entry")))
    return ev.confusion_wide(ev.confusion(t, "ledger_entry", "p"), ["credit", "debit"])


@query(f"""WITH c AS ({_CONF}), r AS (SELECT actual AS label, sum(n) AS rn FROM c GROUP BY 1), k AS (SELECT predicted AS label, sum(n) AS cn FROM c GROUP BY 1), t AS (SELECT sum(n) AS total FROM c),
    j AS (SELECT label, coalesce(c.n, 0)::BIGINT AS tp, (coalesce(cn, 0) - coalesce(c.n, 0))::BIGINT AS fp, (coalesce(rn, 0) - coalesce(c.n, 0))::BIGINT AS fn, total FROM r FULL JOIN k USING (label) LEFT JOIN c ON c.actual = label AND c.predicted = label, t),
    m AS (SELECT label, tp, fp, fn, (total - tp - fp - fn)::BIGINT AS tn, tp::DOUBLE / nullif(tp + fp, 0) AS p, tp::DOUBLE / nullif(tp + fn, 0) AS r FROM j)
    SELECT label, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(tn::DOUBLE / nullif(tn + fp, 0), 6) AS specificity, round(2 * p * r / nullif(p + r, 0), 6) AS f_measure FROM m""")
def class_report(s, d):
    return ev.class_report(_confusion(s, d))


@query(f"SELECT round(sum(n) FILTER (WHERE actual = predicted)::DOUBLE / sum(n), 6) AS accuracy FROM ({_CONF})")
def overall_accuracy(s, d):
    return ev.overall_accuracy(_confusion(s, d))


@query(f"SELECT unique_mem_id, count(*) AS total, round(greatest(date_diff('second', min(loaded_at), max(loaded_at)), 1) / count(*)::DOUBLE, 6) AS seconds_each, round(count(*) * 60.0::DOUBLE / greatest(date_diff('second', min(loaded_at), max(loaded_at)), 1), 6) AS per_minute FROM (SELECT unique_mem_id, date_trunc('second', loaded_at) AS loaded_at FROM {LT}) GROUP BY 1")
def throughput(s, d):
    t = table(s, d, LT).groupBy("unique_mem_id").agg(F.count(F.lit(1)).alias("total"), (F.unix_timestamp(F.date_trunc("second", F.max("loaded_at"))) - F.unix_timestamp(F.date_trunc("second", F.min("loaded_at")))).alias("run"))
    each, minute = ev.throughput(F.col("total"), F.col("run"))
    return t.select("unique_mem_id", "total", F.round(each, 6).alias("seconds_each"), F.round(minute, 6).alias("per_minute"))


# ---- candidates: members as model types, rows as runs

_CAND = f"SELECT unique_mem_id AS model, strftime(loaded_at, '%Y%m%d%H%M%S') AS stamp, max(amount) AS score FROM {LT} WHERE unique_mem_id IS NOT NULL GROUP BY 1, 2"


def _candidates(s, d):
    return table(s, d, LT).filter("unique_mem_id is not null").groupBy(F.col("unique_mem_id").alias("model"), F.date_format("loaded_at", "yyyyMMddHHmmss").alias("stamp")).agg(F.max("amount").alias("score"))


@query(f"SELECT model, stamp, score FROM ({_CAND}) QUALIFY row_number() OVER (PARTITION BY model ORDER BY score DESC, stamp) = 1")
def best_model(s, d):
    return ev.best_candidate(_candidates(s, d), "model", "score", "stamp")


@query(f"WITH c AS ({_CAND}), p AS (SELECT model, min(stamp) AS pin FROM c WHERE model LIKE '%1' GROUP BY 1 HAVING count(*) % 3 = 0) SELECT model, stamp, score FROM c LEFT JOIN p USING (model) QUALIFY row_number() OVER (PARTITION BY model ORDER BY coalesce(stamp = pin, false) DESC, score DESC, stamp) = 1")
def pinned_model(s, d):
    c = _candidates(s, d)
    pins = c.filter(F.col("model").endswith("1")).groupBy("model").agg(F.min("stamp").alias("stamp"), F.count(F.lit(1)).alias("n")).filter("n % 3 = 0").select("model", "stamp")
    return ev.best_candidate(c, "model", "score", "stamp", pins)


@query(f"SELECT model, max(stamp) AS newest FROM ({_CAND}) WHERE regexp_full_match(stamp, '[0-9]+') GROUP BY model")
def newest_version(s, d):
    return _candidates(s, d).filter(F.col("stamp").rlike("^[0-9]+$")).groupBy("model").agg(F.max("stamp").alias("newest"))


@query(f"SELECT month, count(*) AS n, string_agg(model, ',' ORDER BY model) AS models FROM (SELECT DISTINCT substr(stamp, 1, 6) AS month, substr(model, 1, 5) AS model FROM ({_CAND})) GROUP BY month")
def peer_models(s, d):
    t = _candidates(s, d).select(F.substring("stamp", 1, 6).alias("month"), F.substring("model", 1, 5).alias("model")).distinct()
    return t.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("model")), ",").alias("models"))


@query("SELECT factual_id, max_by(place_name, updated_at) AS place_name FROM merchants GROUP BY factual_id")
def last_wins(s, d):
    return ev.last_wins(table(s, d, "merchants").select("factual_id", "place_name", "updated_at"), "factual_id", ["updated_at"]).select("factual_id", "place_name")


_ERAS = "SELECT o_custkey AS model, o_orderkey AS era, o_totalprice AS score FROM orders"


@query(f"SELECT model, era, max(score) OVER (PARTITION BY model ORDER BY era) AS best FROM ({_ERAS})")
def running_best(s, d):
    t = table(s, d, "orders").select(F.col("o_custkey").alias("model"), F.col("o_orderkey").alias("era"), F.col("o_totalprice").alias("score"))
    return t.select("model", "era", F.max("score").over(Window.partitionBy("model").orderBy("era").rowsBetween(Window.unboundedPreceding, 0)).alias("best"))


@query(f"""WITH e AS (SELECT model, row_number() OVER (PARTITION BY model ORDER BY era) AS era, score FROM ({_ERAS})), b AS (SELECT *, score >= coalesce(max(score) OVER (PARTITION BY model ORDER BY era ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), score) AS new FROM e),
    a AS (SELECT model, era, era - max(CASE WHEN new THEN era END) OVER (PARTITION BY model ORDER BY era) AS since FROM b) SELECT model, CAST(min(era) AS BIGINT) AS stop_era FROM a WHERE since >= 3 GROUP BY model""")
def early_stop(s, d):
    t = table(s, d, "orders").select(F.col("o_custkey").alias("model"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("era"), F.col("o_totalprice").alias("score"))
    return ev.running_best(t, "model", "era", "score", 3).filter("stop").groupBy("model").agg(F.min("era").cast("long").alias("stop_era"))


# ---- gates

@query(f"SELECT proposed_subtype AS label, count(*) AS n FROM {LT} GROUP BY 1")
def label_counts(s, d):
    return quality.label_counts(table(s, d, LT), "proposed_subtype")


@query(f"SELECT merchant_name AS label, count(*) AS n FROM {LT} GROUP BY 1 HAVING count(*) < 500")
def small_classes(s, d):
    return quality.small_classes(quality.label_counts(table(s, d, LT), "merchant_name"), 500)


@query("SELECT canonical_city AS name, count(DISTINCT city_id) AS n, min(city_id) AS first_key, max(city_id) AS last_key FROM city_ref GROUP BY 1 HAVING count(DISTINCT city_id) > 1")
def dup_names(s, d):
    return quality.duplicate_names(table(s, d, "city_ref"), "canonical_city", "city_id")


@query(f"SELECT label, 'missing' AS side FROM (SELECT DISTINCT merchant_name AS label FROM {LT} WHERE merchant_name IS NOT NULL) WHERE label NOT IN (SELECT canonical_name FROM merchant_ref) UNION ALL SELECT canonical_name, 'extra' FROM merchant_ref WHERE canonical_name NOT IN (SELECT merchant_name FROM {LT} WHERE merchant_name IS NOT NULL)")
def label_set_diff(s, d):
    return quality.label_differences(table(s, d, LT).withColumnRenamed("merchant_name", "label"), table(s, d, "merchant_ref").withColumnRenamed("canonical_name", "label"), "label")


@query(f"""SELECT n, n_null, round(c, 6) AS change, CASE WHEN c >= 0.05 THEN 'critical' WHEN c >= 0.01 THEN 'warn' ELSE 'ok' END AS verdict FROM (SELECT n, n_null, greatest(abs(n - 12000) / 12000.0::DOUBLE, abs(n_null - 1500) / 1500.0::DOUBLE) AS c
    FROM (SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(merchant_name, '') = '') AS n_null FROM {LT}))""")
def size_gate(s, d):
    return quality.size_gate(table(s, d, LT), 12000, "merchant_name", 1500)


@query(f"SELECT count(DISTINCT proposed_subtype) AS n_classes, count(DISTINCT trade) AS n_trades FROM {LT} FULL JOIN merchant_ref ON merchant_name = canonical_name")
def class_count_check(s, d):
    a, b = table(s, d, LT).agg(F.count_distinct("proposed_subtype").alias("n")), table(s, d, "merchant_ref").agg(F.count_distinct("trade").alias("n"))
    return a.select(F.col("n").alias("n_classes"), b.scalar().alias("n_trades"))


@query("SELECT city AS name FROM store_numbers WHERE city IS NOT NULL UNION SELECT locality FROM merchants WHERE locality IS NOT NULL")
def key_union(s, d):
    return table(s, d, "store_numbers").select(F.col("city").alias("name")).union(table(s, d, "merchants").select(F.col("locality").alias("name"))).filter("name is not null").distinct()


@query("SELECT keywords AS name, state, 'store' AS origin FROM store_numbers UNION ALL SELECT place_name, region, 'merchant' FROM merchants")
def union_buckets(s, d):
    a = table(s, d, "store_numbers").select(F.col("keywords").alias("name"), "state", F.lit("store").alias("origin"))
    return a.unionByName(table(s, d, "merchants").select(F.col("place_name").alias("name"), F.col("region").alias("state"), F.lit("merchant").alias("origin")))
