"""Queries of the service plan, of free-text and address search, of the tagger and of small gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..functions import text as tx
from ..operators import enrich, models, prep, relink, search, service, tagger
from ..operators import evaluate as ev
from ..session import cut, table
from . import q_search
from .registry import registry

QUERIES, SQL, query = registry()

LT = "labeled_transactions"
# every combination of services that may be asked for, none, and one that may not
_ASKED = [[], *map(list, service.COMBINATIONS), ["bloom_filter", "cnn_category"]]


def _services(i):
    return F.element_at(F.array(*[F.array(*map(F.lit, a)).cast("array<string>") for a in _ASKED]), (F.pmod(i, F.lit(len(_ASKED))) + 1).cast("int"))


_LISTS = "[" + ", ".join("[" + ", ".join(f"'{x}'" for x in a) + "]::VARCHAR[]" for a in _ASKED) + "]"
_REQUESTS = f"SELECT *, {_LISTS}[(transaction_id % {len(_ASKED)}) + 1] AS services FROM {LT}"
_runs = lambda *names: f"(len(services) = 0 OR list_has_any(services, [{', '.join(repr(n) for n in names)}]))"
_STAGES = f"{_runs('bloom_filter')} AS runs_location, {_runs('search')} AS runs_search, {_runs('cnn_subtype')} AS runs_subtype, {_runs('cnn_category', 'cnn_subtype')} AS runs_category, {_runs('cnn_merchant')} AS runs_merchant"


@query(f"SELECT transaction_id, unique_mem_id, {_STAGES} FROM ({_REQUESTS})")
def service_stages(s, d):
    t = table(s, d, LT).select("transaction_id", "unique_mem_id", _services(F.col("transaction_id")).alias("services"))
    return t.withColumns(service.stages(F.col("services"))).drop("services")


@query(f"SELECT allowed, count(*) AS n FROM (SELECT services <> ['bloom_filter', 'cnn_category'] AS allowed FROM ({_REQUESTS})) GROUP BY 1")
def service_combinations(s, d):
    t = table(s, d, LT).select(service.allowed_combination(_services(F.col("transaction_id"))).alias("allowed"))
    return t.groupBy("allowed").agg(F.count(F.lit(1)).alias("n"))


def _labelled(s, d):
    """Rows whose labels stand for those of the models."""
    t = table(s, d, LT).groupBy("transaction_id").agg(F.min("description_unmasked").alias("description"), F.min("proposed_subtype").alias("subtype"), F.min("merchant_name").alias("merchant_label"), F.min("is_physical_transaction").alias("p"))
    t = t.withColumns(service.stages(_services(F.col("transaction_id"))))
    t = t.withColumns({"subtype": F.when(F.col("runs_subtype"), F.coalesce("subtype", F.lit(""))).otherwise(""), "category": F.when(F.col("runs_category"), F.split("subtype", " - ")[0]).otherwise(""), "merchant_label": F.when(F.col("runs_merchant"), F.coalesce("merchant_label", F.lit(""))).otherwise("")})
    return t.withColumn("is_physical_merchant", F.col("p") == "1").withColumns({f"{c}_score": F.lit(0.5) for c in ("merchant_label", "subtype", "category")})


def _shaped(s, d):
    places = table(s, d, LT).filter("city <> '' and state <> ''").groupBy(F.col("description_unmasked").alias("description")).agg(F.min("city").alias("city"), F.min("state").alias("state"))
    ids = table(s, d, "merchants").groupBy("factual_id").agg(F.max_by(F.struct("place_name", "address", "country"), "updated_at").alias("m")).select("factual_id", "m.*")
    links = table(s, d, LT).filter("factual_id not in ('', 'NULL')").groupBy("transaction_id").agg(F.min("factual_id").alias("factual_id"))
    rows = _labelled(s, d)
    hits = links.join(ids, "factual_id").join(rows.filter("runs_search and is_physical_merchant").select("transaction_id"), "transaction_id", "left_semi")
    found = hits.select("transaction_id", F.coalesce("place_name", F.lit("")).alias("merchant"), F.lit(True).alias("match_found"), F.lit("FACTUAL").alias("source"), F.lit("").alias("category_labels"), F.col("address").alias("street"), "country", F.col("factual_id").alias("source_merchant_id"))
    return service.assemble(rows, "transaction_id", places, found)


_SHAPE = f"""WITH r AS (SELECT transaction_id, min(description_unmasked) AS description, min(proposed_subtype) AS sub, min(merchant_name) AS label, min(is_physical_transaction) = '1' AS physical, {_LISTS}[(transaction_id % {len(_ASKED)}) + 1] AS services FROM {LT} GROUP BY transaction_id),
  q AS (SELECT *, {_STAGES} FROM r), p AS (SELECT description_unmasked AS description, min(city) AS city, min(state) AS state FROM {LT} WHERE city <> '' AND state <> '' GROUP BY 1),
  l AS (SELECT transaction_id, min(factual_id) AS factual_id FROM {LT} WHERE factual_id NOT IN ('', 'NULL') GROUP BY 1), m AS (SELECT factual_id, max_by(place_name, updated_at) AS place_name, arg_max_null(address, updated_at) AS address FROM merchants GROUP BY 1),
  j AS (SELECT q.*, p.description IS NOT NULL AND runs_location AS located, p.city, p.state, m.factual_id, m.place_name, m.address, m.factual_id IS NOT NULL AS hit FROM q LEFT JOIN p USING (description) LEFT JOIN l ON l.transaction_id = q.transaction_id AND runs_search AND physical LEFT JOIN m ON m.factual_id = l.factual_id) """


@query(_SHAPE + """SELECT transaction_id, physical AS is_physical_merchant, CASE WHEN located THEN city ELSE '' END AS city, CASE WHEN located THEN state ELSE '' END AS state, CASE WHEN runs_merchant AND label <> '' THEN label ELSE coalesce(place_name, '') END AS merchant_name,
    CASE WHEN runs_subtype THEN string_split(sub, ' - ')[1] ELSE '' END AS txn_type, CASE WHEN runs_subtype THEN coalesce(string_split(sub, ' - ')[2], '') ELSE '' END AS txn_sub_type, CASE WHEN physical THEN hit END AS match_found, CASE WHEN physical THEN CASE WHEN hit THEN 'FACTUAL' ELSE 'OTHER' END END AS source,
    CASE WHEN physical THEN coalesce(address, '') END AS street, CASE WHEN physical THEN coalesce(factual_id, '') END AS source_merchant_id, CASE WHEN physical THEN '' END AS fax_number FROM j""")
def service_output(s, d):
    return _shaped(s, d).select("transaction_id", "is_physical_merchant", "city", "state", "merchant_name", "txn_type", "txn_sub_type", "match_found", "source", "street", "source_merchant_id", "fax_number")


@query(_SHAPE + "SELECT physical AS is_physical_merchant, physical AS has_search, true AS has_location, true AS has_labels, count(*) AS n FROM j GROUP BY ALL")
def service_debug(s, d):
    shaped = service.output(_shaped(s, d), "transaction_id", debug=True)
    r = F.from_json("json", "is_physical_merchant boolean, search struct<merchant_name:string,neighbourhood:string>, bloom_filter struct<city:string>, cnn struct<txn_type:string,merchant_score:double>")
    has = lambda c: r[c].isNotNull()
    return shaped.select(r["is_physical_merchant"].alias("is_physical_merchant"), has("search").alias("has_search"), has("bloom_filter").alias("has_location"), has("cnn").alias("has_labels")).groupBy("is_physical_merchant", "has_search", "has_location", "has_labels").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 0::BIGINT AS n_faults")
def response_faults(s, d):
    return service.response_faults(service.output(_shaped(s, d), "transaction_id"), "transaction_id").agg(F.count(F.lit(1)).alias("n_faults"))


@query()
def classified_service(s, d):
    """The whole plan with fitted models, over the transactions whose id is divisible by 50, as they are searched."""
    t = table(s, d, LT)
    slim = t.select("transaction_id", F.col("description_unmasked").alias("description"), "container", "ledger_entry", "is_physical_transaction", "proposed_subtype")
    train = cut(slim.filter("description is not null"))
    fit = lambda rows, label: models.fit(rows, "description", label)
    kinds = {"physical": {c: fit(train.filter(F.col("container") == c), "is_physical_transaction") for c in ("bank", "card")}}
    kinds["subtype"] = {f"{c}_{x}": fit(train.filter((F.col("container") == c) & (F.col("ledger_entry") == x)), "proposed_subtype") for c in ("bank", "card") for x in ("credit", "debit")}
    rest = ["description", "container", "ledger_entry"]
    asked = slim.filter("transaction_id % 50 = 0").groupBy("transaction_id").agg(F.min(F.struct(*rest)).alias("r")).select("transaction_id", "r.*").withColumn("services_list", _services(F.col("transaction_id") / 50))
    return service.output(service.classify(asked, "transaction_id", kinds, q_search._directory(s, d), table(s, d, "city_ref"), least_gap=0.5), "transaction_id", debug=True)


# ---- searches by address, in all fields, and without meaningless words

_ADDRESS = {"keywords": "place_name", "address": "address", "city": "locality", "state": "region", "zip_code": "postcode"}
_boost = lambda f: 2.0 if f == "place_name" else 1.0
_CELLS = lambda fields: " UNION ALL ".join(f"SELECT factual_id AS doc, '{f}' AS field, regexp_extract_all(lower({e}), '[a-z0-9]+') AS ts FROM dirx" for f, e in fields.items())


def _weighted_sql(fields: dict[str, str]) -> str:
    return f"""WITH dirx AS {q_search._DIR}, cells AS ({_CELLS(fields)}),
  post AS (SELECT field, term, doc, dl, count(*) AS tf FROM (SELECT field, doc, len(ts) AS dl, unnest(ts) AS term FROM cells WHERE len(ts) > 0) GROUP BY ALL),
  st AS (SELECT field, count(*) AS n, avg(len(ts)) AS avgdl FROM cells WHERE len(ts) > 0 GROUP BY 1), fr AS (SELECT field, term, count(*) AS df FROM post GROUP BY 1, 2),
  w AS (SELECT p.field, p.term, p.doc, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM post p JOIN fr USING (field, term) JOIN st USING (field)) """


_RANKED = """SELECT query, doc, round(sum(boost * w), 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(sum(boost * w), 6) DESC, doc) AS rank FROM c JOIN w USING (field, term) GROUP BY query, doc QUALIFY rank <= 5"""


@query(_weighted_sql({f: f for f in _ADDRESS.values()}) + ", c AS (" + " UNION ".join(f"SELECT store_row AS query, '{f}' AS field, {_boost(f)}::DOUBLE AS boost, unnest(regexp_extract_all(lower({c}), '[a-z0-9]+')) AS term FROM store_numbers WHERE store_row % 50 = 0" for c, f in _ADDRESS.items()) + ") " + _RANKED)
def address_relink(s, d):
    """The five best records for every fiftieth store by its name and address."""
    asked = table(s, d, "store_numbers").filter("store_row % 50 = 0")
    idx = search.index(q_search._directory(s, d), "factual_id", list(_ADDRESS.values()))
    return search.top_hits(enrich.address_clauses(asked, "store_row", _ADDRESS), idx, 5)


_ALL = ["place_name", "address", "address_extended", "locality", "region", "postcode", "tel", "category_labels", "chain_name"]
_FREE = {"everything": "concat_ws(' ', " + ", ".join(_ALL) + ")", **{f: f for f in ("place_name", "address", "locality", "region", "postcode")}}
_N = tx.QUERY_NOISE.replace("'", "''")
_FREE_TEXT = f"lower(trim(regexp_replace(regexp_replace(text, '{_N}', ' ', 'g'), '{tx.SPACE}+', ' ', 'g')))"
_FREE_ROWS = f"(SELECT transaction_id AS query, min(description_unmasked) AS text, min(merchant_name) AS name, min(city) AS place FROM {LT} WHERE transaction_id % 50 = 0 GROUP BY 1)"


@query(_weighted_sql(_FREE) + f""", e AS (SELECT query, 'everything' AS field, 1.0::DOUBLE AS boost, unnest(list_distinct(regexp_extract_all({_FREE_TEXT}, '[a-z0-9]+'))) AS term FROM {_FREE_ROWS}
    UNION ALL SELECT query, 'place_name', 4.0, unnest(list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+'))) FROM {_FREE_ROWS} UNION ALL """ + " UNION ALL ".join(f"SELECT query, '{f}', 2.0, unnest(list_distinct(regexp_extract_all(lower(place), '[a-z0-9]+'))) FROM {_FREE_ROWS}" for f in ("address", "locality", "region", "postcode")) + """),
    c AS (SELECT query, field, term, sum(boost) AS boost FROM e GROUP BY ALL) """ + _RANKED)
def free_text_search(s, d):
    """The five best records for the text of every fiftieth transaction in all fields, with name and town."""
    t = table(s, d, LT).filter("transaction_id % 50 = 0").groupBy("transaction_id").agg(F.min("description_unmasked").alias("text"), F.min("merchant_name").alias("name"), F.min("city").alias("place"))
    idx = search.index(enrich.with_everything(q_search._directory(s, d), _ALL), "factual_id", list(_FREE))
    return search.top_hits(enrich.free_text_clauses(t, "transaction_id", "text", "name", "place"), idx, 5)


_STRIP = f"upper(trim(regexp_replace(regexp_replace(lower({_FREE_TEXT}), '{'|'.join(tx.NOISE_PATTERNS + tx.NOISE_WORDS)}', ' ', 'g'), '{tx.SPACE}+', ' ', 'g')))"


@query(f"SELECT transaction_id, unique_mem_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(lower({_STRIP}), 'qt', ' quicktrip ', 'g'), '{_N}', ' ', 'g'), '{tx.SPACE}+', ' ', 'g'))) AS sought FROM (SELECT transaction_id, unique_mem_id, description_unmasked AS text FROM {LT}) WHERE NOT (length({_FREE_TEXT}) <= 2 AND regexp_matches({_FREE_TEXT}, '^[a-zA-Z0-9_]+$'))")
def noise_free_query(s, d):
    """What is sought for a description once meaningless words are gone."""
    t = table(s, d, LT).select("transaction_id", "unique_mem_id", enrich.noise_free_text(F.col("description_unmasked")).alias("sought"))
    return t.filter("sought is not null")


_BUCKETS = q_search._DIFF


@query(f"SELECT b.transaction_id, b.bucket, '' AS city, '' AS state, CASE WHEN b.transaction_id % 97 = 0 THEN 'x' ELSE '' END AS relinked_id FROM ({_BUCKETS}) b")
def relinked_rows(s, d):
    """All six buckets of the comparison with the enriched columns blank, as they are saved."""
    return relink.blanked(q_search._difference(s, d), ["city", "state"]).select("transaction_id", "bucket", "city", "state", "relinked_id")


# ---- the tagger

_CHARS = "abcdefghijklmnopqrstuvwxyz0123456789"
WORD_LENGTH, TOKENS = 20, 35


@query(f"""SELECT transaction_id, unique_mem_id, array_to_string(list_resize(list_concat([1], list_transform(range(1, least(length(w), {WORD_LENGTH - 2}) + 1), lambda i: CASE WHEN strpos('{_CHARS}', substr(w, i, 1)) > 0 THEN strpos('{_CHARS}', substr(w, i, 1)) + 2 ELSE {3 + len(_CHARS)} END), [2]), {WORD_LENGTH}, 0), ',') AS ids
    FROM (SELECT transaction_id, unique_mem_id, lower(merchant_name) AS w FROM {LT} WHERE merchant_name IS NOT NULL)""")
def character_indices(s, d):
    t = table(s, d, LT).filter("merchant_name is not null")
    return t.select("transaction_id", "unique_mem_id", F.array_join(tagger.character_indices(F.col("merchant_name"), _CHARS, WORD_LENGTH).cast("array<string>"), ",").alias("ids"))


@query(f"""WITH v AS (SELECT word, row_number() OVER (ORDER BY place) AS i FROM (SELECT word, min((merchant_id, pos)) AS place FROM (SELECT merchant_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM (SELECT merchant_id, string_split(lower(canonical_name), ' ') AS ws FROM merchant_ref)) GROUP BY word)),
    t AS (SELECT transaction_id, any_value(ws) AS ws FROM (SELECT transaction_id, string_split(lower(min(merchant_name)), ' ') AS ws FROM {LT} WHERE merchant_name IS NOT NULL GROUP BY 1) GROUP BY 1),
    c AS (SELECT transaction_id, unnest(ws[1:{TOKENS}]) AS word, unnest(range(0, least(len(ws), {TOKENS}))) AS p FROM t)
    SELECT transaction_id, array_to_string(list_resize(list(coalesce(i, 0) ORDER BY p), {TOKENS}, 0), ',') AS ids FROM c LEFT JOIN v USING (word) GROUP BY 1""")
def word_indices(s, d):
    listed = table(s, d, "merchant_ref").select("merchant_id", F.posexplode(F.split(F.lower("canonical_name"), " ")).alias("pos", "word"))
    known = tagger.vocabulary(listed, "word", ["merchant_id", "pos"], buckets=8)
    t = table(s, d, LT).filter("merchant_name is not null").groupBy("transaction_id").agg(F.min("merchant_name").alias("n"))
    rows = tagger.word_indices(t.withColumn("ts", F.split("n", " ")), "transaction_id", "ts", known, TOKENS)
    return rows.select("transaction_id", F.array_join(F.col("word_indices").cast("array<string>"), ",").alias("ids"))


def _tagged(s, d):
    t = prep.hash_split(table(s, d, LT).filter("description_unmasked is not null").groupBy("transaction_id").agg(F.min(F.struct("description_unmasked", "merchant_name")).alias("r")).select("transaction_id", "r.*"), "transaction_id", 0.8)
    model = tagger.fit(t.filter("part = 'train'"), "transaction_id", "description_unmasked", "merchant_name")
    return t.filter("part = 'test'"), model


@query()
def tagger_report(s, d):
    """Held-out report of the fitted tagger."""
    held, model = _tagged(s, d)
    named = held.filter("merchant_name <> ''")
    truth = tagger.token_rows(named, "transaction_id", "description_unmasked", "merchant_name").select("transaction_id", "pos", F.col("tag").alias("actual"))
    got = tagger.tag(model, named, "transaction_id", "description_unmasked").select("transaction_id", "pos", "predicted")
    return tagger.tag_report(truth.join(got, ["transaction_id", "pos"]), "transaction_id")


@query()
def tagged_merchants(s, d):
    """The merchant's words that the tagger finds in held-out descriptions."""
    held, model = _tagged(s, d)
    return tagger.merchants_of(tagger.tag(model, held, "transaction_id", "description_unmasked"), "transaction_id")


# ---- small ones

@query("SELECT sum(k)::BIGINT AS n, count(*) AS groups, round(sum(k * k)::DOUBLE * count(*) / sum(k) - sum(k), 6) AS chi_square, count(*) - 1 AS degrees FROM (SELECT state, count(*) AS k FROM store_numbers GROUP BY 1)")
def chi_square(s, d):
    return ev.chi_square(table(s, d, "store_numbers"), "state")


@query("SELECT store_row, store_number, row_number() OVER (ORDER BY coalesce(try_cast(split_part(store_number, ' ', 1) AS BIGINT), 9000000000), split_part(store_number, ' ', 1), store_row) AS place FROM store_numbers WHERE store_number IS NOT NULL")
def numeric_sort(s, d):
    t = table(s, d, "store_numbers").filter("store_number is not null").withColumn("_o", prep.numeric_order(F.split("store_number", " ")[0]))
    return prep.row_numbers(t, ["_o", "store_row"], buckets=8).select("store_row", "store_number", (F.col("row_no") + 1).alias("place"))


@query(f"SELECT transaction_id, unique_mem_id, string_split(proposed_subtype, ' - ')[1] AS first, strftime(loaded_at, '%Y%m%d%H%M%S') AS stamp FROM {LT}")
def first_and_stamp(s, d):
    return table(s, d, LT).select("transaction_id", "unique_mem_id", ar.first_of_list(F.split("proposed_subtype", " - ")).alias("first"), tx.version_stamp(F.col("loaded_at")).alias("stamp"))


@query("SELECT merchant_name, count(*) AS total, count(*) FILTER (WHERE p = '') AS unlabeled, count(*) FILTER (WHERE p <> '' AND p = h) AS correct FROM (SELECT coalesce(merchant_name, '') AS merchant_name, CASE WHEN transaction_id % 11 = 0 THEN '' WHEN transaction_id % 7 = 0 THEN 'x' ELSE proposed_subtype END AS p, proposed_subtype AS h FROM labeled_transactions) GROUP BY 1")
def accuracy_by_merchant(s, d):
    """The counters of the comparison for every merchant in one pass."""
    i = F.col("transaction_id")
    t = table(s, d, LT).select(F.coalesce("merchant_name", F.lit("")).alias("merchant_name"), F.when(i % 11 == 0, "").when(i % 7 == 0, "x").otherwise(F.col("proposed_subtype")).alias("m"), F.col("proposed_subtype").alias("h"))
    status = F.when(F.col("m") == "", "unlabeled").when(F.lower("m") == F.lower("h"), "correct").otherwise("mislabeled")
    return ev.accuracy_metrics(t.withColumn("status", status), ["merchant_name"]).select("merchant_name", "total", "unlabeled", "correct")
