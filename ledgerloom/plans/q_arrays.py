"""Queries of score vectors, label rules, geography and index features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..functions import geo
from ..operators import tagger
from ..session import table
from .registry import registry

QUERIES, SQL, query = registry()

_V = "list_transform(embedding, lambda x: x::DOUBLE)"


def _vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@query(f"SELECT vec_id, list_position(v, list_max(v))::BIGINT AS best, round(list_max(v), 6) AS score FROM (SELECT vec_id, {_V} AS v FROM embeddings)")
def argmax_label(s, d):
    return _vectors(s, d).select("vec_id", ar.first_argmax(F.col("v")).alias("best"), F.round(F.array_max("v"), 6).alias("score"))


@query(f"SELECT vec_id, CASE WHEN ln(list_max(v)) < ln(0.2) THEN 1 ELSE list_position(v, list_max(v)) END::BIGINT AS label FROM (SELECT vec_id, {_V} AS v FROM embeddings) WHERE list_max(v) > 0")
def threshold_fallback(s, d):
    t = _vectors(s, d).filter(F.array_max("v") > 0)
    return t.select("vec_id", ar.label_or_default(ar.first_argmax(F.col("v")), F.log(F.array_max("v")), F.lit(0.2)).alias("label"))


@query(f"SELECT vec_id, list_position(m, list_max(m))::BIGINT AS best, round(list_max(m), 6) AS score FROM (SELECT vec_id, list_transform(range(1, len(v) + 1), lambda i: (v[i] + v[len(v) + 1 - i]) / 2) AS m FROM (SELECT vec_id, {_V} AS v FROM embeddings))")
def soft_target_mean(s, d):
    t = _vectors(s, d).withColumn("m", ar.mean_vectors([F.col("v"), F.reverse("v")]))
    return t.select("vec_id", ar.first_argmax(F.col("m")).alias("best"), F.round(F.array_max("m"), 6).alias("score"))


@query(f"SELECT vec_id, round(exp(list_max(v) / 2) / list_sum(list_transform(v, lambda x: exp(x / 2))), 6) AS most FROM (SELECT vec_id, {_V} AS v FROM embeddings)")
def softmax_temp(s, d):
    return _vectors(s, d).select("vec_id", F.round(F.array_max(ar.softmax(F.col("v"), 2.0)), 6).alias("most"))


@query(f"SELECT vec_id, round(list_sum(list_transform(v, lambda x: ln(greatest(least(x, 1.0), 1e-10)))), 4) AS total FROM (SELECT vec_id, {_V} AS v FROM embeddings)")
def log_clip(s, d):
    return _vectors(s, d).select("vec_id", F.round(F.aggregate(ar.clipped_log(F.col("v")), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT transaction_id, CASE WHEN amount - 50 >= 1e-6 THEN amount - 50 ELSE 0.0 END AS out FROM labeled_transactions")
def threshold_relu(s, d):
    return table(s, d, "labeled_transactions").select("transaction_id", ar.threshold_relu(F.col("amount") - 50).alias("out"))


@query("SELECT vec_id, array_to_string(list_transform(range(1, 11), lambda i: CASE WHEN i = label + 1 THEN 1 ELSE 0 END), '') AS hot FROM embeddings")
def label_onehot(s, d):
    return table(s, d, "embeddings").select("vec_id", F.array_join(ar.one_hot(F.col("label") + 1, 10).cast("array<string>"), "").alias("hot"))


ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-,;.!?:'\"/\\|_@#$%^&*~`+=<>()[]{}"  # fixed value
#: Characters of a description that the classifiers read.
DOC_LENGTH = 123


@query(f"""SELECT transaction_id, array_to_string(list_reverse(list_transform(range(1, length(t) + 1), lambda i: strpos('{ALPHABET.replace("'", "''")}', substr(t, i, 1)))), ',') AS indices
    FROM (SELECT transaction_id, substr(lower(description_unmasked), 1, {DOC_LENGTH}) AS t FROM labeled_transactions)""")
def char_onehot(s, d):
    indices = ar.char_indices(F.col("description_unmasked"), ALPHABET, DOC_LENGTH)
    return table(s, d, "labeled_transactions").select("transaction_id", F.array_join(indices.cast("array<string>"), ",").alias("indices"))


@query("""SELECT word, row_number() OVER (ORDER BY place) AS word_index FROM (SELECT word, min(merchant_id * 100 + pos) AS place FROM (SELECT merchant_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM (SELECT merchant_id, string_split(lower(canonical_name), ' ') AS ws FROM merchant_ref)) GROUP BY word)""")
def word_index(s, d):
    words = table(s, d, "merchant_ref").select("merchant_id", F.posexplode(F.split(F.lower("canonical_name"), " ")).alias("pos", "word"))
    return tagger.vocabulary(words, "word", ["merchant_id", "pos"], buckets=8)


@query("SELECT word, bool_or(side = 'a') AS in_names, bool_or(side = 'b') AS in_cities FROM (SELECT 'a' AS side, unnest(string_split(lower(canonical_name), ' ')) AS word FROM merchant_ref UNION ALL SELECT 'b', unnest(string_split(lower(canonical_city), ' ')) FROM city_ref) GROUP BY 1")
def vocabulary_union(s, d):
    side = lambda name, c: table(s, d, name).select(F.explode(F.split(F.lower(c), " ")).alias("word"))
    return tagger.vocabulary_union(side("merchant_ref", "canonical_name"), side("city_ref", "canonical_city")).withColumnsRenamed({"in_training": "in_names", "in_known": "in_cities"})


# ---- geography

RING = [(-100.0, 30.0), (-80.0, 32.0), (-85.0, 42.0), (-98.0, 40.0)]
OTHER = [(-120.0, 35.0), (-110.0, 35.0), (-115.0, 45.0)]


def _ring_sql(ring):
    closed = [*ring, ring[0]]
    edges = [f"CASE WHEN (latitude < {y1}) <> (latitude < {y2}) AND longitude < {x1} + (latitude - {y1}) * ({x2} - ({x1})) / ({y2} - ({y1})) THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(closed, closed[1:]) if y1 != y2]
    return f"(({' + '.join(edges)}) % 2 = 1)"


def _points(s, d):
    return table(s, d, "merchants").filter("longitude is not null and latitude is not null")


@query("SELECT factual_id, place_name FROM merchants WHERE longitude BETWEEN -95 AND -80 AND latitude BETWEEN 30 AND 40")
def envelope_filter(s, d):
    return _points(s, d).filter(geo.in_envelope(F.col("longitude"), F.col("latitude"), -95, 40, -80, 30)).select("factual_id", "place_name")


@query(f"SELECT factual_id, place_name FROM merchants WHERE longitude IS NOT NULL AND latitude IS NOT NULL AND {_ring_sql(RING)}")
def polygon_filter(s, d):
    return _points(s, d).filter(geo.in_polygon(F.col("longitude"), F.col("latitude"), [RING])).select("factual_id", "place_name")


@query(f"SELECT factual_id, place_name FROM merchants WHERE longitude IS NOT NULL AND latitude IS NOT NULL AND ({_ring_sql(RING)} OR {_ring_sql(OTHER)}) AND list_contains(regexp_extract_all(lower(place_name), '[a-z0-9]+'), 'lodge')")
def multi_polygon_text(s, d):
    from ..operators.search import terms

    inside = geo.in_multipolygon(F.col("longitude"), F.col("latitude"), [[RING], [OTHER]])
    return _points(s, d).filter(inside & F.array_contains(terms(F.col("place_name")), "lodge")).select("factual_id", "place_name")
