"""Queries of search, enrichment, relinking and store merging. Search queries take every transaction
whose id is divisible by 50 (store_match every store row likewise) against the whole directory; enrichment
takes all transactions and merging all store rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..functions import text as tx
from ..operators import documents, enrich, relink, search, service, stores
from ..operators.locate import locate as locate_op
from ..session import cut, table
from .registry import registry

QUERIES, SQL, query = registry()

LT = "labeled_transactions"
FIELDS = {"place_name": 2.781, "locality": 1.367, "region": 1.685, "postcode": 0.914}


def _directory(s, d):
    return search.directory(table(s, d, "merchants"), "factual_id", "updated_at")


def _asked(s, d):
    t = table(s, d, LT).filter("transaction_id % 50 = 0")
    return t.groupBy("transaction_id").agg(F.min("description_unmasked").alias("text"), F.min("state").alias("state"))


def _weights(s, d, fields=None):
    docs = _directory(s, d)
    names = list(fields or FIELDS)
    return search.weighted(search.postings(docs, "factual_id", names), docs, "factual_id", names)


def _index(s, d, **how):
    return search.index(_directory(s, d), "factual_id", list(FIELDS), **how)


def _clauses(s, d):
    return search.clause(_asked(s, d).withColumn("q", enrich.search_text(F.col("text"))).filter("q is not null"), "transaction_id", "q", FIELDS)


def _hits(s, d, k=45):
    return search.top_hits(_clauses(s, d), _index(s, d), k)


_W = tx.SPACE
_N = tx.QUERY_NOISE.replace("'", "''")
_CLEAN = f"lower(trim(regexp_replace(regexp_replace(text, '{_N}', ' ', 'g'), '{_W}+', ' ', 'g')))"
# the invented descriptions hold none of the synonym spellings but qt, which stands in some names
_SYN = f"regexp_replace({_CLEAN}, 'qt', ' quicktrip ', 'g')"
_VALUES = ", ".join(f"('{f}', {b})" for f, b in FIELDS.items())
_CELLS = " UNION ALL ".join(f"SELECT factual_id AS doc, '{f}' AS field, regexp_extract_all(lower({f}), '[a-z0-9]+') AS ts FROM dirx" for f in FIELDS)
_BASE = f"""WITH dirx AS (SELECT m.* FROM merchants m JOIN (SELECT factual_id, max(updated_at) AS u FROM merchants GROUP BY 1) x ON m.factual_id = x.factual_id AND m.updated_at = x.u),
  cells AS ({_CELLS}),
  post AS (SELECT field, term, doc, dl, count(*) AS tf FROM (SELECT field, doc, len(ts) AS dl, unnest(ts) AS term FROM cells WHERE len(ts) > 0) GROUP BY ALL),
  st AS (SELECT field, count(*) AS n, avg(len(ts)) AS avgdl FROM cells WHERE len(ts) > 0 GROUP BY 1),
  fr AS (SELECT field, term, count(*) AS df FROM post GROUP BY 1, 2),
  w AS (SELECT p.field, p.term, p.doc, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM post p JOIN fr USING (field, term) JOIN st USING (field)),
  asked AS (SELECT transaction_id, min(description_unmasked) AS text, min(state) AS state FROM {LT} WHERE transaction_id % 50 = 0 GROUP BY 1),
  q AS (SELECT transaction_id, state, {_SYN} AS q FROM asked WHERE NOT (length({_CLEAN}) <= 2 AND regexp_matches({_CLEAN}, '^[a-zA-Z0-9_]+$'))),
  c AS (SELECT DISTINCT transaction_id AS query, state AS region, unnest(regexp_extract_all(q, '[a-z0-9]+')) AS term FROM q),
  b(field, boost) AS (VALUES {_VALUES}),
  sc AS (SELECT query, doc, round(sum(boost * w), 6) AS score FROM c JOIN w USING (term) JOIN b USING (field) GROUP BY 1, 2),
  h AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc QUALIFY rank <= 45),
  g AS (SELECT query, count(*) AS n_hits, max(score) FILTER (WHERE rank = 1) AS top_score, round((max(score) FILTER (WHERE rank = 1) - max(score) FILTER (WHERE rank = 2)) / CASE WHEN stddev_pop(score) > 1e-9 THEN stddev_pop(score) END, 3) AS gap FROM h GROUP BY 1) """


@query(_BASE + "SELECT query, doc, score, rank FROM h WHERE rank <= 10")
def bm25_topk(s, d):
    return _hits(s, d, 10)


@query(_BASE + "SELECT query, doc, score, rank FROM h WHERE rank > 10 AND rank <= 20")
def bm25_page(s, d):
    return search.top_hits(_clauses(s, d), _index(s, d), 10, 10)


@query(_BASE + "SELECT field, term, count(*) AS n_docs, round(max(w), 6) AS most FROM w GROUP BY 1, 2")
def bm25_fields(s, d):
    return _weights(s, d).groupBy("field", "term").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.max("w"), 6).alias("most"))


@query(_BASE + """, r AS (SELECT query, doc, round(sum(boost * w), 6) AS score FROM c JOIN w USING (term) JOIN b USING (field) JOIN dirx ON doc = factual_id AND dirx.region = c.region GROUP BY 1, 2)
    SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM r QUALIFY rank <= 10""")
def bm25_routed(s, d):
    asked = _asked(s, d).select(F.col("transaction_id").alias("query"), F.col("state").alias("route"))
    return search.top_hits(_clauses(s, d).join(asked, "query"), _index(s, d, route="region", routes=asked), 10)


@query(_BASE + "SELECT * FROM g")
def zscore_gap(s, d):
    return search.gaps(_hits(s, d))


@query(_BASE + "SELECT query, coalesce(gap > 0.5 AND top_score > 1.0, false) AS accepted FROM g")
def accept_rule(s, d):
    return search.gaps(_hits(s, d)).select("query", search.accepted(F.col("gap"), F.col("top_score"), 0.5, 1.0).alias("accepted"))


@query(_BASE + "SELECT h.query, doc, score, rank, gap FROM h JOIN g ON h.query = g.query WHERE rank = 3")
def nth_hit(s, d):
    hits = cut(_hits(s, d))
    return search.nth_hit(hits, search.gaps(hits), 2)


@query(_BASE + """SELECT query, max(place_name) FILTER (WHERE rank = 1) AS place_name_1, max(place_name) FILTER (WHERE rank = 2) AS place_name_2, max(region) FILTER (WHERE rank = 1) AS region_1, max(region) FILTER (WHERE rank = 2) AS region_2
    FROM h JOIN dirx ON doc = factual_id WHERE rank <= 2 GROUP BY 1""")
def top2_agree(s, d):
    return search.top_two(_hits(s, d), _directory(s, d), "factual_id", ["place_name", "region"])


_TRIALS = ((1, "place_name", 2.781), (1, "locality", 1.367), (1, "region", 1.685), (2, "place_name", 1.0), (2, "locality", 2.5), (3, "postcode", 3.0))


@query(_BASE + f", t(trial, field, factor) AS (VALUES {', '.join(str(x) for x in _TRIALS)}) SELECT trial, query, doc, round(sum(factor * w), 6) AS score FROM c JOIN w USING (term) JOIN t USING (field) GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY trial, query ORDER BY score DESC, doc) = 1")
def trial_scores(s, d):
    trials = s.createDataFrame(list(_TRIALS), "trial int, field string, factor double")
    return search.trial_hits(_clauses(s, d), _index(s, d), trials, 1).drop("rank")


@query()
def locate_city(s, d):
    return locate_op(table(s, d, LT), "description_unmasked", table(s, d, "city_ref"))


@query()
def enriched_transactions(s, d):
    t = table(s, d, LT).groupBy("transaction_id").agg(F.min("description_unmasked").alias("description"))
    return enrich.find_merchants(t, "transaction_id", "description", _directory(s, d), table(s, d, "city_ref"), least_gap=0.5)


def _assembled(s, d):
    found = cut(enriched_transactions(s, d))  # read three times
    rows = found.select("transaction_id", "description", F.lit(True).alias("is_physical_merchant"), F.lit(True).alias("runs_location"), F.lit(False).alias("runs_subtype"), *[F.lit("").alias(c) for c in ("subtype", "category", "merchant_label")], *[F.lit(None).cast("double").alias(f"{c}_score") for c in ("subtype", "category", "merchant_label")])
    places = found.filter("city <> '' and state <> ''").groupBy("description").agg(F.min(F.struct("city", "state")).alias("p")).select("description", "p.*")
    return service.assemble(rows, "transaction_id", places, found)


@query()
def output_shape(s, d):
    return service.output(_assembled(s, d), "transaction_id")


@query()
def debug_shape(s, d):
    return service.output(_assembled(s, d), "transaction_id", debug=True)


# ---- directory documents

@query("""SELECT factual_id, updated_at::DATE AS at, trim(coalesce(address, '') || ' ' || coalesce(address_extended, '') || ' ' || coalesce(locality, '') || ', ' || coalesce(region, '') || ' ' || coalesce(postcode, '')) AS composite FROM merchants""")
def composite_field(s, d):
    out = documents.composite("{0} {1} {2}, {3} {4}", ["address", "address_extended", "locality", "region", "postcode"])
    return table(s, d, "merchants").select("factual_id", F.col("updated_at").cast("date").alias("at"), out.alias("composite"))


@query("""SELECT factual_id, updated_at::DATE AS at, nullif(regexp_extract(tel, '^\\(([0-9]{3})\\) ([0-9]{3})-([0-9]{4})$', 1), '') AS area, nullif(regexp_extract(tel, '^\\(([0-9]{3})\\) ([0-9]{3})-([0-9]{4})$', 3), '') AS line FROM merchants""")
def dispersed_field(s, d):
    out = documents.dispersed(table(s, d, "merchants"), "tel", r"\((?P<area>[0-9]{3})\) (?P<exchange>[0-9]{3})-(?P<line>[0-9]{4})")
    return out.select("factual_id", F.col("updated_at").cast("date").alias("at"), "area", "line")


@query("SELECT factual_id, updated_at::DATE AS at, CASE WHEN longitude IS NOT NULL AND latitude IS NOT NULL THEN 'point(' || printf('%.6f', longitude) || ' ' || printf('%.6f', latitude) || ')' END AS pin, coalesce(nullif(trim(region), ''), 'XX') AS region FROM merchants")
def pin_point(s, d):
    out = documents.with_region(documents.with_point(table(s, d, "merchants")))
    pin = F.when(F.col("pin").isNotNull(), F.concat("pin.type", F.lit("("), F.array_join("pin.coordinates", " "), F.lit(")")))
    return out.select("factual_id", F.col("updated_at").cast("date").alias("at"), pin.alias("pin"), "region")


@query("SELECT factual_id, count(*) AS n_fields FROM (SELECT factual_id, unnest([place_name, address, address_extended, locality, region, postcode, country, tel, website, category_labels, status, chain_name]) AS v FROM merchants) WHERE v <> '' GROUP BY 1")
def sparse_document(s, d):
    names = ["place_name", "address", "address_extended", "locality", "region", "postcode", "country", "tel", "website", "category_labels", "status", "chain_name"]
    sparse = documents.without_blanks(table(s, d, "merchants"), names)
    return sparse.select("factual_id", F.size(F.array_compact(F.array(*names))).alias("n")).groupBy("factual_id").agg(F.sum("n").alias("n_fields")).filter("n_fields > 0")


@query("SELECT category_labels AS facet, count(*) AS n FROM merchants WHERE category_labels IS NOT NULL GROUP BY 1 ORDER BY n DESC, facet LIMIT 10")
def terms_facet(s, d):
    return table(s, d, "merchants").filter("category_labels is not null").groupBy(F.col("category_labels").alias("facet")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "facet").limit(10)


@query("SELECT region, count(*) AS n_towns, sum(n)::BIGINT AS n, max(n) AS most FROM (SELECT region, locality, count(*) AS n FROM merchants GROUP BY 1, 2) GROUP BY 1")
def nested_terms(s, d):
    towns = table(s, d, "merchants").groupBy("region", "locality").agg(F.count(F.lit(1)).alias("n"))
    return towns.groupBy("region").agg(F.count(F.lit(1)).alias("n_towns"), F.sum("n").alias("n"), F.max("n").alias("most"))


@query("SELECT place_name AS name, count(*) AS n FROM merchants GROUP BY 1")
def name_terms(s, d):
    return table(s, d, "merchants").groupBy(F.col("place_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT transaction_id, array_to_string(list_sort(list_distinct([trim(x) FOR x IN string_split(replace(proposed_subtype, ' - ', '|'), '|')])), ',') AS labels FROM labeled_transactions")
def flatten_categories(s, d):
    parts = F.split("proposed_subtype", " - ")
    nested = F.to_json(F.array(F.array(F.element_at(parts, 1)), F.array(F.element_at(parts, -1))))
    return table(s, d, LT).select("transaction_id", F.array_join(arrays.category_list(nested), ",").alias("labels"))


# ---- ids, snapshots and users

_DIR = "(SELECT m.* FROM merchants m JOIN (SELECT factual_id, max(updated_at) AS u FROM merchants GROUP BY 1) x ON m.factual_id = x.factual_id AND m.updated_at = x.u)"
_OLD = "(SELECT m.* FROM merchants m JOIN (SELECT factual_id, min(updated_at) AS u FROM merchants GROUP BY 1) x ON m.factual_id = x.factual_id AND m.updated_at = x.u)"


@query(f"SELECT t.transaction_id, t.factual_id, coalesce(m.place_name, '') AS found_place_name, coalesce(m.locality, '') AS found_locality, m.factual_id IS NOT NULL AS merchant_found FROM {LT} t LEFT JOIN {_DIR} m ON t.factual_id = m.factual_id AND t.factual_id NOT IN ('', 'NULL')")
def id_lookup(s, d):
    return relink.lookup(table(s, d, LT), _directory(s, d), "factual_id", ["place_name", "locality"]).select("transaction_id", "factual_id", "found_place_name", "found_locality", "merchant_found")


@query(f"SELECT t.transaction_id, coalesce(printf('%.6f', m.longitude), '') AS lon, coalesce(printf('%.6f', m.latitude), '') AS lat FROM {LT} t LEFT JOIN {_DIR} m ON t.factual_id = m.factual_id")
def enrich_found(s, d):
    m = _directory(s, d).select("factual_id", "longitude", "latitude")
    out = table(s, d, LT).select("transaction_id", "factual_id").join(m, "factual_id", "left")
    return out.select("transaction_id", F.coalesce(tx.coordinate(F.col("longitude")), F.lit("")).alias("lon"), F.coalesce(tx.coordinate(F.col("latitude")), F.lit("")).alias("lat"))


_NEW = f"(SELECT * FROM {_DIR} WHERE substr(factual_id, 1, 1) <> 'a')"
_DIFF = f"""SELECT t.transaction_id, CASE WHEN t.transaction_id % 97 = 0 THEN 'relinked' WHEN coalesce(t.factual_id, '') = '' THEN 'unlinked' WHEN t.factual_id = 'NULL' THEN 'null' WHEN n.factual_id IS NULL THEN 'id_changed'
    WHEN o.factual_id IS NULL OR (coalesce(o.place_name, ''), coalesce(o.address, ''), coalesce(o.locality, ''), coalesce(o.region, ''), coalesce(o.postcode, '')) <> (coalesce(n.place_name, ''), coalesce(n.address, ''), coalesce(n.locality, ''), coalesce(n.region, ''), coalesce(n.postcode, '')) THEN 'details_changed' ELSE 'unchanged' END AS bucket
    FROM {LT} t LEFT JOIN {_OLD} o ON t.factual_id = o.factual_id LEFT JOIN {_NEW} n ON t.factual_id = n.factual_id"""


def _difference(s, d):
    m = table(s, d, "merchants")
    rest = [c for c in m.columns if c != "factual_id"]
    old = m.groupBy("factual_id").agg(F.min_by(F.struct(*rest), "updated_at").alias("_r")).select("factual_id", "_r.*")
    new = _directory(s, d).filter(F.substring("factual_id", 1, 1) != "a")  # an index from which some records are gone
    rows = table(s, d, LT).withColumn("relinked_id", F.when(F.col("transaction_id") % 97 == 0, "x").otherwise(""))
    return relink.snapshot_difference(rows, "factual_id", old, new, "relinked_id")


@query(_DIFF)
def index_diff(s, d):
    return _difference(s, d).select("transaction_id", "bucket")


@query(f"SELECT bucket, count(*) AS n FROM ({_DIFF}) GROUP BY 1")
def bucket_sizes(s, d):
    return _difference(s, d).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT transaction_id, CASE WHEN transaction_id % 3 = 1 THEN 'NULL' WHEN transaction_id % 3 = 2 THEN 'new-' || transaction_id ELSE '' END AS relinked_id FROM {LT} WHERE NOT (transaction_id % 3 = 0 AND transaction_id % 7 = 0)")
def review_decisions(s, d):
    t = table(s, d, LT)
    i = F.col("transaction_id")
    answers = t.select("transaction_id").distinct().select("transaction_id", F.when(i % 3 == 1, "null").when(i % 3 == 2, "link").when(i % 7 == 0, "rm").otherwise("skip").alias("answer"), F.concat(F.lit("new-"), i.cast("string")).alias("new_id"))
    return relink.apply_decisions(t.select("transaction_id"), answers, "transaction_id").select("transaction_id", "relinked_id")


@query(f"""WITH f AS (SELECT unique_mem_id, city, min((transaction_date, transaction_id)) AS p FROM {LT} WHERE unique_mem_id IS NOT NULL AND coalesce(city, '') <> '' GROUP BY 1, 2)
    SELECT unique_mem_id, count(*) AS n_values, string_agg(city, '; ' ORDER BY p, city) AS values FROM f GROUP BY 1""")
def user_context(s, d):
    return relink.user_context(table(s, d, LT), "unique_mem_id", "city", ["transaction_date", "transaction_id"])


@query(f"SELECT unique_mem_id, count(*) AS n FROM {LT} WHERE unique_mem_id IS NOT NULL GROUP BY 1")
def user_buckets(s, d):
    return relink.user_buckets(table(s, d, LT), "unique_mem_id", "transaction_id").groupBy("unique_mem_id").agg(F.sum("n").alias("n"))


@query(f"SELECT transaction_id, count(*) AS n_rows FROM {LT} WHERE unique_mem_id IN (SELECT unique_mem_id FROM {LT} WHERE amount > 200) GROUP BY 1")
def has_parent(s, d):
    t = table(s, d, LT)
    return documents.children_of(t, t, "unique_mem_id", F.col("amount") > 200).groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT store_row, '' AS city, '' AS state, keywords FROM store_numbers")
def blank_columns(s, d):
    return relink.blanked(table(s, d, "store_numbers"), ["city", "state"]).select("store_row", "city", "state", "keywords")


# ---- stores

def _matches(s, d):
    return stores.match_stores(table(s, d, "store_numbers"), _directory(s, d))


_SCELLS = " UNION ALL ".join(f"SELECT factual_id AS doc, '{f}' AS field, regexp_extract_all(lower({f}), '[a-z0-9]+') AS ts FROM dirx" for f in stores.FIELDS.values())
_SCLAUSES = " UNION ".join(f"SELECT store_row AS query, '{f}' AS field, unnest(regexp_extract_all(lower({'substr(zip_code, 1, 5)' if c == 'zip5' else c}), '[a-z0-9]+')) AS term FROM store_numbers" for c, f in stores.FIELDS.items())
_STORE = f"""WITH dirx AS {_DIR}, cells AS ({_SCELLS}),
  post AS (SELECT field, term, doc, dl, count(*) AS tf FROM (SELECT field, doc, len(ts) AS dl, unnest(ts) AS term FROM cells WHERE len(ts) > 0) GROUP BY ALL),
  st AS (SELECT field, count(*) AS n, avg(len(ts)) AS avgdl FROM cells WHERE len(ts) > 0 GROUP BY 1), fr AS (SELECT field, term, count(*) AS df FROM post GROUP BY 1, 2),
  w AS (SELECT p.field, p.term, p.doc, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM post p JOIN fr USING (field, term) JOIN st USING (field)),
  c AS ({_SCLAUSES}), sc AS (SELECT query, doc, round(sum(w), 6) AS score FROM c JOIN w USING (field, term) GROUP BY 1, 2),
  h AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc QUALIFY rank <= 45),
  g AS (SELECT query, count(*) AS n_hits, round((max(score) FILTER (WHERE rank = 1) - max(score) FILTER (WHERE rank = 2)) / CASE WHEN stddev_pop(score) > 1e-9 THEN stddev_pop(score) END, 3) AS gap FROM h GROUP BY 1),
  m AS (SELECT s.store_row, s.keywords, coalesce(n_hits, 0) AS n_hits, gap, doc, coalesce(contains(lower(place_name), lower(s.keywords)) AND gap > 0.95, false) AS matched FROM store_numbers s LEFT JOIN g ON g.query = s.store_row LEFT JOIN h ON h.query = s.store_row AND rank = 1 LEFT JOIN dirx ON doc = factual_id) """


@query(_STORE + "SELECT store_row, keywords, n_hits, gap, CASE WHEN matched THEN doc END AS factual_id, matched FROM m WHERE store_row % 50 = 0")
def store_match(s, d):
    return stores.match_stores(table(s, d, "store_numbers").filter("store_row % 50 = 0"), _directory(s, d))


@query(_STORE + "SELECT factual_id, coalesce(number, '') AS internal_store_number FROM dirx LEFT JOIN (SELECT doc, max_by(aggdata_store_number, m.store_row) AS number FROM m JOIN store_numbers n ON n.store_row = m.store_row WHERE matched GROUP BY 1) ON doc = factual_id")
def store_update(s, d):
    return stores.update_directory(_directory(s, d), _matches(s, d), table(s, d, "store_numbers")).select("factual_id", "internal_store_number")


@query(_STORE + "SELECT keywords, count(*) AS n_stores, count(*) FILTER (WHERE matched) AS n_matched, round(count(*) FILTER (WHERE matched) * 100.0::DOUBLE / count(*), 6) AS percent_merged FROM m GROUP BY 1")
def percent_merged(s, d):
    return stores.merged_percent(_matches(s, d))
