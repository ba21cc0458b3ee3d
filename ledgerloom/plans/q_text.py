"""Queries of the string functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import sized_broadcast, table
from .registry import registry

QUERIES, SQL, query = registry()

WS = tx.SPACE
_squeeze = lambda e: f"trim(regexp_replace({e}, '{WS}+', ' ', 'g'))"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _descriptions(s, d):
    return table(s, d, "labeled_transactions").select("transaction_id", F.col("description_unmasked").alias("text"))


def _over_descriptions(name, expr, sql):
    def build(s, d):
        return _descriptions(s, d).select("transaction_id", expr(F.col("text")).alias("out"))

    build.__name__ = name
    query(f"SELECT transaction_id, {sql('description_unmasked')} AS out FROM labeled_transactions")(build)


_clean = lambda e: f"lower({_squeeze(f'regexp_replace({e}, {_lit(tx.QUERY_NOISE)}, {_lit(' ')}, {_lit('g')})')})"
_over_descriptions("clean_string", tx.clean_query, _clean)
_over_descriptions("clean_panel", tx.clean_panel, lambda e: _squeeze(f"regexp_replace(replace({e}, '''', ' '), '\\*<', ' ', 'g')"))
_over_descriptions("stopword_strip", tx.strip_noise, lambda e: f"upper({_squeeze(f'regexp_replace(lower({e}), {_lit("|".join(tx.NOISE_PATTERNS + tx.NOISE_WORDS))}, {_lit(" ")}, {_lit("g")})')})")
_over_descriptions("squeeze_upper", tx.bare_upper, lambda e: f"regexp_replace(regexp_replace(upper({e}), '{WS}', '', 'g'), {_lit(tx.PUNCTUATION)}, '', 'g')")
_over_descriptions("remove_company_id", lambda c: F.regexp_replace(c, "(?i) co id:", ""), lambda e: f"regexp_replace({e}, ' co id:', '', 'gi')")
_over_descriptions("short_query_guard", lambda c: ~((F.length(tx.clean_query(c)) <= 2) & tx.clean_query(c).rlike("^[a-zA-Z0-9_]+$")), lambda e: f"NOT (length({_clean(e)}) <= 2 AND regexp_matches({_clean(e)}, '^[a-zA-Z0-9_]+$'))")

_KEYS = "|".join("".join("\\" + c if c in r"\.+*?()[]{}|^$-" else c for c in k) for k in tx.SYNONYMS).replace("'", "''")
_CASES = " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in tx.SYNONYMS.items())


# descriptions with the spellings put in, as the invented merchants have no synonyms of their own
@query(f"""SELECT transaction_id, upper(array_to_string(list_transform(string_split(regexp_replace(t, '({_KEYS})', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)),
    lambda p: CASE p {_CASES} ELSE p END), '')) AS out
    FROM (SELECT transaction_id, lower(description_unmasked || ' uspsamsclub loweshell oil ' || CASE WHEN amount > 50 THEN 'wal-mart qt' ELSE 'macy''s east' END) AS t FROM labeled_transactions)""")
def synonym_replace(s, d):
    t = table(s, d, "labeled_transactions")
    tail = F.when(F.col("amount") > 50, "wal-mart qt").otherwise("macy's east")
    return t.select("transaction_id", tx.replace_synonyms(F.concat(F.col("description_unmasked"), F.lit(" uspsamsclub loweshell oil "), tail)).alias("out"))


@query("""SELECT DISTINCT proposed_subtype, array_to_string(list_transform(string_split(proposed_subtype, ' '), lambda w: CASE WHEN lower(w) IN ('by', 'with', 'or', 'at', 'in') THEN lower(w) ELSE upper(substr(w, 1, 1)) || substr(w, 2) END), ' ') AS out FROM labeled_transactions""")
def cap_label(s, d):
    return table(s, d, "labeled_transactions").select("proposed_subtype").distinct().select("proposed_subtype", tx.capitalise_label(F.col("proposed_subtype")).alias("out"))


@query("""SELECT factual_id, updated_at::VARCHAR AS at, CASE WHEN place_name = upper(place_name) THEN array_to_string(list_transform(string_split(place_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') ELSE place_name END AS out
    FROM (SELECT factual_id, updated_at::DATE AS updated_at, place_name FROM merchants)""")
def capwords_name(s, d):
    return table(s, d, "merchants").select("factual_id", F.col("updated_at").cast("date").cast("string").alias("at"), tx.capwords_if_upper(F.col("place_name")).alias("out"))


@query(f"""SELECT transaction_id, CASE WHEN ws IS NOT NULL THEN array_to_string(list_prepend(0, list_transform(range(1, len(ws) + 1), lambda i: list_sum(list_transform(ws[1:i], lambda w: length(w)))::BIGINT)), ',') END AS out FROM (
    SELECT transaction_id, list_filter(string_split({_squeeze(f"regexp_replace(replace(description_unmasked, '''', ''), {_lit(tx.PUNCTUATION)}, ' ', 'g')")}, ' '), lambda w: w <> '') AS ws FROM labeled_transactions)""")
def token_start_offsets(s, d):
    return _descriptions(s, d).select("transaction_id", F.array_join(tx.token_starts(F.col("text")).cast("array<string>"), ",").alias("out"))


@query("""SELECT transaction_id, CASE WHEN contains(proposed_subtype, ' - ') THEN string_split(proposed_subtype, ' - ')[1] WHEN ledger_entry = 'debit' THEN 'Other Expenses' WHEN container = 'bank' THEN 'Other Income' ELSE 'Bank Adjustment' END AS label_type,
    CASE WHEN contains(proposed_subtype, ' - ') THEN string_split(proposed_subtype, ' - ')[2] WHEN ledger_entry = 'debit' THEN 'Debit' WHEN container = 'bank' THEN 'Credit' ELSE 'Adjustment' END AS label_subtype FROM labeled_transactions""")
def type_split(s, d):
    kind, sub = tx.split_label(F.col("proposed_subtype"), F.col("ledger_entry"), F.col("container"))
    return table(s, d, "labeled_transactions").select("transaction_id", kind.alias("label_type"), sub.alias("label_subtype"))


@query("SELECT factual_id, latitude, printf('%.6f', latitude) AS lat, printf('%.6f', longitude) AS lon FROM merchants WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def coordinate_format(s, d):
    t = table(s, d, "merchants").filter("latitude is not null and longitude is not null")
    return t.select("factual_id", "latitude", tx.coordinate(F.col("latitude")).alias("lat"), tx.coordinate(F.col("longitude")).alias("lon"))


@query("SELECT feed_file, CASE WHEN contains(f, 'bank') THEN 'bank' WHEN contains(f, 'card') THEN 'card' ELSE '' END AS container FROM (SELECT DISTINCT container || '_' || feed_file AS feed_file, lower(container || '_' || feed_file) AS f FROM raw_transactions, (SELECT DISTINCT container FROM labeled_transactions))")
def container_from_file(s, d):
    kinds = F.explode(F.array(F.lit("bank"), F.lit("card")))
    t = table(s, d, "raw_transactions").select("feed_file").distinct().withColumn("c", kinds).select(F.concat_ws("_", "c", "feed_file").alias("feed_file"))
    return t.select("feed_file", tx.container_of(F.col("feed_file")).alias("container"))


@query("SELECT transaction_id, contains(lower(description_unmasked), lower(merchant_name)) AS named FROM labeled_transactions WHERE merchant_name IS NOT NULL AND description_unmasked IS NOT NULL")
def name_in_description(s, d):
    t = table(s, d, "labeled_transactions").filter("merchant_name is not null and description_unmasked is not null")
    return t.select("transaction_id", tx.contains_folded(F.col("description_unmasked"), F.col("merchant_name")).alias("named"))


@query("SELECT store_row, substr(zip_code, 1, 5) AS zip5 FROM store_numbers")
def zip_prefix(s, d):
    return table(s, d, "store_numbers").select("store_row", tx.zip_prefix(F.col("zip_code")).alias("zip5"))


@query("SELECT transaction_id, CASE WHEN regexp_full_match(t, '[0-9]+\\.[0-9]+') THEN CAST(t AS DOUBLE) ELSE 0.0 END AS accuracy FROM (SELECT transaction_id, CASE WHEN amount > 20 THEN CAST(amount AS VARCHAR) ELSE 'n/a ' || amount END AS t FROM labeled_transactions)")
def accuracy_literal(s, d):
    text = F.when(F.col("amount") > 20, F.col("amount").cast("string")).otherwise(F.concat(F.lit("n/a "), F.col("amount").cast("string")))
    return table(s, d, "labeled_transactions").select("transaction_id", tx.accuracy_literal(text).alias("accuracy"))


@query("""WITH RECURSIVE c AS (SELECT city_id, list_filter(string_split(regexp_replace(replace(upper(canonical_city), '.', ''), '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS ts FROM city_ref),
    e AS (SELECT unnest(['EAST', 'WEST', 'NORTH', 'SOUTH', 'SAINT', 'FORT', 'BEACH']) AS w, unnest(['E', 'W', 'N', 'S', 'ST', 'FT', 'BCH']) AS put UNION SELECT w, w FROM (SELECT unnest(ts) AS w FROM c)),
    r AS (SELECT city_id, ts, 0 AS i, '' AS form FROM c UNION ALL SELECT city_id, ts, i + 1, form || put FROM r JOIN e ON e.w = ts[i + 1] WHERE i < len(ts))
    SELECT DISTINCT city_id, form FROM r WHERE i = len(ts)""")
def city_forms(s, d):
    return table(s, d, "city_ref").select("city_id", F.explode(tx.city_short_forms(F.col("canonical_city"))).alias("form"))


@query("""SELECT city_id, array_to_string(list_transform(string_split(upper(canonical_city), ' '), lambda w: substr(CASE w WHEN 'E' THEN 'EAST' WHEN 'W' THEN 'WEST' WHEN 'N' THEN 'NORTH' WHEN 'S' THEN 'SOUTH' WHEN 'ST' THEN 'SAINT' WHEN 'FT' THEN 'FORT' WHEN 'BCH' THEN 'BEACH' ELSE w END, 1, 1)
    || lower(substr(CASE w WHEN 'E' THEN 'EAST' WHEN 'W' THEN 'WEST' WHEN 'N' THEN 'NORTH' WHEN 'S' THEN 'SOUTH' WHEN 'ST' THEN 'SAINT' WHEN 'FT' THEN 'FORT' WHEN 'BCH' THEN 'BEACH' ELSE w END, 2))), ' ') AS long_form FROM city_ref""")
def city_long(s, d):
    return table(s, d, "city_ref").select("city_id", tx.city_long_form(F.col("canonical_city")).alias("long_form"))


@query("SELECT DISTINCT lower(canonical_city) AS city FROM city_ref")
def city_list(s, d):
    return table(s, d, "city_ref").select(F.lower("canonical_city").alias("city")).distinct()


_TOKENS = f"list_filter(string_split({_squeeze('lower(description_unmasked)')}, ' '), lambda t: t <> '')[1:35]"
_words_of = lambda e: f"list_filter(string_split({_squeeze(f"lower(replace({e}, ',', ' '))")}, ' '), lambda t: t NOT IN ('', 'null'))"
_hit = lambda ws, at: f"coalesce(contains(ts[i + 1], {ws}[{at}]), false)"


@query(f"""WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, transaction_id, {_TOKENS} AS ts, {_words_of("coalesce(merchant_name, '')")} AS ws FROM labeled_transactions WHERE description_unmasked IS NOT NULL),
    r AS (SELECT rid, transaction_id, ts, ws, 0 AS i, 1 AS k, []::VARCHAR[] AS m FROM t
      UNION ALL SELECT rid, transaction_id, ts, ws, i + 1, k + {_hit('ws', 'k')}::INT, CASE WHEN {_hit('ws', 'k')} THEN list_append(m, ts[i + 1]) ELSE m END FROM r WHERE i < len(ts))
    SELECT transaction_id, len(ts) AS n_tokens, array_to_string(m, ' ') AS merchant FROM r WHERE i = len(ts)""")
def token_tags(s, d):
    t = table(s, d, "labeled_transactions").filter("description_unmasked is not null")
    tags = tx.merchant_tags(F.col("description_unmasked"), F.coalesce("merchant_name", F.lit("")))
    return t.select("transaction_id", F.size(tags).cast("long").alias("n_tokens"), tx.merchant_of_tags(tags).alias("merchant"))


@query(f"""WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, {_TOKENS} AS ts, {_words_of('merchant_name')} AS ws, {_words_of("coalesce(canonical_name, '')")} AS gs
      FROM labeled_transactions LEFT JOIN merchant_ref ON merchant_name = canonical_name WHERE description_unmasked IS NOT NULL AND merchant_name <> ''),
    r AS (SELECT rid, ts, ws, gs, 0 AS i, 1 AS k, 1 AS g, false AS a, false AS b FROM t
      UNION ALL SELECT rid, ts, ws, gs, i + 1, k + {_hit('ws', 'k')}::INT, g + {_hit('gs', 'g')}::INT, {_hit('ws', 'k')}, {_hit('gs', 'g')} FROM r WHERE i < len(ts))
    SELECT CASE WHEN a THEN 'merchant' ELSE 'background' END AS actual, CASE WHEN b THEN 'merchant' ELSE 'background' END AS predicted, count(*) AS n FROM r WHERE i > 0 GROUP BY 1, 2""")
def tag_accuracy(s, d):
    """Token accuracy of a tagger that knows the directory's names only, against the labelled names."""
    t = table(s, d, "labeled_transactions").filter("description_unmasked is not null and merchant_name <> ''").join(sized_broadcast(table(s, d, "merchant_ref")), F.col("merchant_name") == F.col("canonical_name"), "left")
    truth, got = tx.merchant_tags(F.col("description_unmasked"), F.col("merchant_name")), tx.merchant_tags(F.col("description_unmasked"), F.coalesce("canonical_name", F.lit("")))
    pair = F.explode(F.arrays_zip(truth.alias("a"), got.alias("b")))
    cells = t.select(pair.alias("p")).select(F.col("p.a.tag").alias("actual"), F.col("p.b.tag").alias("predicted"))
    return cells.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
