"""Text search over a directory as joins: postings, per-field BM25, boosts, top-k and score gaps.

score(query, document) = sum over clauses of clause boost x sum over fields of field boost x BM25 of the
clause's terms in that field (k1 1.2, b 0.75). The sum is linear in the boosts, so that many boost
settings can be scored in one job. Ranks go by the score rounded to six digits, then by document id.
All terms count, however common. score() scores every document that shares a term with a query;
top_hits() finds the best ones without doing so (searching.py).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, sized_broadcast
from . import searching
from .searching import K1

B = 0.75
#: Most documents and most clauses of one term that a part of the join holds.
PART_DOCS, PART_CLAUSES = 5_000, 5_000


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def postings(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, term, doc, tf, dl) of all documents."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), terms(F.col(f).cast("string")).alias("ts")) for f in fields]))
    flat = docs.select(F.col(key).alias("doc"), cells.alias("c")).filter(F.size("c.ts") > 0).select("doc", "c.field", F.size("c.ts").alias("dl"), F.explode("c.ts").alias("term"))
    return flat.groupBy("field", "term", "doc", "dl").agg(F.count(F.lit(1)).alias("tf"))


def _weight() -> Column:
    """BM25 of a term from df, n, tf, dl and avgdl."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def weighted(post: DataFrame, docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, term, doc, w): what a term adds to the score of a document. No term is left out."""
    sizes = docs.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.size(terms(F.col(f).cast("string"))).alias("dl")) for f in fields])).alias("c")).select("c.*").filter("dl > 0")
    per_field = sizes.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    frequency = post.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    known = frequency.join(F.broadcast(per_field), "field")
    return post.join(known, ["field", "term"]).select("field", "term", "doc", _weight().alias("w"))


def clause(queries: DataFrame, key: str, text: str, boosts: dict[str, float]) -> DataFrame:
    """(query, term, field, boost): the distinct terms of a text sought in fields with their boosts;
    boosts of 0 are left out."""
    table = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(float(b)).alias("boost")) for f, b in boosts.items() if b])
    return queries.select(F.col(key).alias("query"), F.explode(F.array_distinct(terms(F.col(text)))).alias("term")).withColumn("c", F.explode(table)).select("query", "term", "c.field", "c.boost")


def meet(clauses: DataFrame, weights: DataFrame, on: tuple[str, ...] = ("term", "field"), doc: str = "doc") -> DataFrame:
    """Joins clauses with weights by term. The documents of a common term are spread over as many parts
    as hold PART_DOCS each and the clauses of a term that many queries hold over parts of PART_CLAUSES;
    every part of the one meets every part of the other once. Both sides get a fixed number of
    partitions, since the sizes that adaptive execution would coalesce by say nothing of the rows
    that come out."""
    n = int(clauses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    on = list(on)
    many = lambda df, most, out: df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(*on, F.ceil(F.col("_n") / most).cast("int").alias(out))
    common, popular = many(weights, PART_DOCS, "_dp"), many(clauses, PART_CLAUSES, "_cp")
    parted = lambda df: df.join(common, on, "left").join(popular, on, "left").withColumns({"_dp": F.coalesce("_dp", F.lit(1)), "_cp": F.coalesce("_cp", F.lit(1))})
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    own = lambda key, parts: F.pmod(F.xxhash64(key), F.col(parts)).cast("int")
    right = parted(weights).withColumn("_d", own(doc, "_dp")).withColumn("_c", every("_cp")).drop("_dp", "_cp").repartition(n, *on, "_d", "_c")
    left = parted(clauses).withColumn("_c", own("query", "_cp")).withColumn("_d", every("_dp")).drop("_dp", "_cp").repartition(n, *on, "_d", "_c")
    return left.join(right, [*on, "_d", "_c"]).drop("_d", "_c")


def score(clauses: DataFrame, weights: DataFrame) -> DataFrame:
    """(query, doc, score) of all documents that meet at least one clause."""
    merged = clauses.groupBy("query", "term", "field").agg(F.sum("boost").alias("boost"))
    return meet(merged, weights).groupBy("query", "doc").agg(F.round(F.sum(F.col("boost") * F.col("w")), 6).alias("score"))


def top_k(scored: DataFrame, k: int, start: int = 0) -> DataFrame:
    """Ranks start + 1 to start + k of each query. Spark keeps only the first rows of each query on the
    map side (window group limit), so that a query with many hits does not gather them."""
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc").asc())
    return scored.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") > start) & (F.col("rank") <= start + k))


@dataclass(frozen=True)
class Index:
    """What is kept of a directory for search.

    docs: (id, doc, route, cells), ids in the order of the documents' keys, cells the terms of every field;
    fields: (field, n, avgdl). A tag is a term of a field, of a route where the index is routed. routes
    are the routes whose documents are sought.
    """

    docs: DataFrame
    fields: DataFrame
    routed: bool = False
    routes: DataFrame | None = None


def tag(routed: bool = False) -> Column:
    return F.concat_ws("\x1f", *(["route"] if routed else []), "field", "term")


def index(docs: DataFrame, key: str, fields: list[str], route: str | None = None, routes: DataFrame | None = None) -> Index:
    """Indexes every document. Weights are those of weighted(), over the whole directory. With a route
    column documents are kept apart by it, and only those whose route is among `routes` (route) are
    indexed. NULL routes have no documents."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), terms(F.col(f).cast("string")).alias("ts")) for f in fields])
    kept = docs.select(F.col(key).alias("doc"), (F.col(route) if route else F.lit("")).cast("string").alias("route"), *fields).orderBy("doc")
    numbered = cut(kept.select(F.monotonically_increasing_id().alias("id"), "doc", "route", cells.alias("cells")))  # cells after the sort, which reads its input twice
    per_field = numbered.select(F.explode("cells").alias("c")).select("c.field", F.size("c.ts").alias("dl")).filter("dl > 0").groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return Index(numbered, per_field, bool(route), routes)


#: Most documents of a block and distinct queries of a part: what one worker holds at a time.
BLOCK_DOCS, PART_QUERIES = 200_000, 50_000


@dataclass(frozen=True)
class Hits:
    """best: (q, id, score, rank, n_hits, second, spread) of each distinct query, the last three being of all its
    hits; own: (query, q); docs: (id, doc)."""

    best: DataFrame
    own: DataFrame
    docs: DataFrame

    def rows(self) -> DataFrame:
        """(query, doc, score, rank)."""
        return meet(self.own, self.best.join(self.docs, "id"), ("q",)).select("query", "doc", "score", "rank")

    def first(self, n: int) -> DataFrame:
        """rows() up to rank n."""
        return Hits(self.best.filter(F.col("rank") <= n), self.own, self.docs).rows()

    def gaps(self) -> DataFrame:
        """gaps() of all hits, told once for queries that seek the same."""
        told = self.best.filter("rank = 1").select("q", "n_hits", F.col("score").alias("top_score"), _gap(F.col("score"), F.col("second"), F.col("spread")).alias("gap"))
        return self.own.join(told, "q").drop("q")


def top_hits(clauses: DataFrame, idx: Index, k: int, start: int = 0) -> DataFrame:
    """(query, doc, score, rank), ranks start + 1 to start + k: exactly what top_k(score(...)) gives."""
    return best_hits(clauses, idx, k, start).rows()


def best_hits(clauses: DataFrame, idx: Index, k: int, start: int = 0, first: int | None = None) -> Hits:
    """The hits of top_hits() by distinct queries: queries that seek the same are one. With `first` only the
    hits up to that rank are kept, with what gaps() tells of all k.

    The postings of the tags that are sought are packed into blocks of documents; the queries are spread
    over parts, and every part goes through all blocks in turn with the best scores it has so far
    (searching.py). Only the hits leave a part.
    """
    context = clauses.sparkSession.sparkContext
    labelled = clauses if idx.routed else clauses.withColumn("route", F.lit(""))
    labelled = labelled.select("query", tag(idx.routed).alias("tag"), "boost")
    docs = idx.docs.filter("route is not null") if idx.routed else idx.docs
    if idx.routes is not None:
        docs = docs.join(sized_broadcast(idx.routes.select(F.col("route").cast("string")).distinct()), "route", "left_semi")
    cells = docs.select("id", "route", F.explode("cells").alias("c")).filter(F.size("c.ts") > 0).select("id", "route", "c.field", "c.ts")
    # frequencies are those of the whole directory, whatever the routes
    frequency = idx.docs.select(F.explode("cells").alias("c")).select("c.field", F.explode(F.array_distinct("c.ts")).alias("term")).groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    weighed = frequency.join(F.broadcast(idx.fields), "field")  # one row a field
    weighed = weighed.select("field", "term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl")
    if idx.routed:
        weighed = weighed.join(cells.select("field", F.explode("ts").alias("term"), "route").distinct(), ["field", "term"])
    sought = cut(weighed.withColumn("tag", tag(idx.routed)).join(labelled.select("tag").distinct(), "tag", "left_semi").withColumn("t", F.monotonically_increasing_id()))
    asked = labelled.join(sized_broadcast(sought.select("tag", "t")), "tag").select("query", "t", "boost").repartition("query")
    asked = asked.groupBy("query", "t").agg(F.sum("boost").alias("boost")).filter("boost > 0")
    asked = asked.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("t", "boost"))).alias("terms"))
    asked = cut(asked.withColumn("hash", F.xxhash64("terms")))  # joins sort by it first
    wants = cut(asked.select("hash", "terms").distinct().withColumn("q", F.monotonically_increasing_id()))
    own = cut(asked.join(wants, ["hash", "terms"]).select("query", "q"))
    n_queries, n_docs = wants.count(), idx.docs.count()
    n_parts = max(1, -(-n_queries // PART_QUERIES), min(2 * context.defaultParallelism, -(-n_queries // 64)))
    n_blocks = max(1, -(-n_docs // BLOCK_DOCS))
    on = ["field", "term", *(["route"] if idx.routed else [])]
    flat = cells.select("id", "route", "field", F.size("ts").alias("dl"), F.explode("ts").alias("term"))
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    post = flat.join(sized_broadcast(sought.select(*on, "t", "idf", "avgdl")), on).select("id", "t", "idf", norm.alias("norm"), F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block"))
    packed = cut(post.repartitionById(n_blocks, "block").sortWithinPartitions("t", "id").select("block", "id", "t", "idf", "norm").mapInArrow(searching.pack, "block int, piece binary"))
    ask = wants.select(F.pmod(F.xxhash64("q"), F.lit(n_parts)).cast("int").alias("part"), F.lit(-1).alias("block"), "q", F.col("terms.t").alias("ts"), F.col("terms.boost").alias("boosts"), F.lit(None).cast("binary").alias("piece"))
    given = packed.select(F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"), "block", F.lit(0).cast("long").alias("q"), F.lit(None).cast("array<bigint>").alias("ts"), F.lit(None).cast("array<double>").alias("boosts"), "piece")
    met = ask.unionByName(given).repartitionById(n_parts, "part").sortWithinPartitions("block")
    best = cut(met.mapInArrow(searching.searched(start + k, first), searching.FOUND).filter(F.col("rank") > start))
    return Hits(best, own, idx.docs.select("id", "doc"))


def gaps(hits: DataFrame) -> DataFrame:
    """(query, n_hits, top_score, gap): the difference of the first two population z-scores to three
    digits; NULL for one hit or equal scores."""
    first, second = F.max(F.when(F.col("rank") == 1, F.col("score"))), F.max(F.when(F.col("rank") == 2, F.col("score")))
    out = hits.groupBy("query").agg(F.count(F.lit(1)).alias("n_hits"), first.alias("top_score"), second.alias("_s"), F.stddev_pop("score").alias("_d"))
    return out.select("query", "n_hits", "top_score", _gap(F.col("top_score"), F.col("_s"), F.col("_d")).alias("gap"))


def _gap(top: Column, second: Column, spread: Column) -> Column:
    return F.round(F.try_divide(top - second, F.when(spread > 1e-9, spread)), 3)


def accepted(gap: Column, top: Column, least_gap: float = 2.857, least_score: float = 1.0) -> Column:
    """Both above their thresholds; NULL and NaN are not."""
    sure = lambda c: c.isNotNull() & ~F.isnan(c)
    return F.when(sure(gap) & sure(top), (gap > least_gap) & (top > least_score)).otherwise(False)


def nth_hit(hits: DataFrame, gap_table: DataFrame, n: int) -> DataFrame:
    """The hit after n others with the gap of its query; queries with fewer hits have none."""
    return hits.filter(F.col("rank") == n + 1).join(gap_table.select("query", "gap"), "query")


def top_two(hits: DataFrame, docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(query, <c>_1, <c>_2 ...) of the two best hits."""
    two = hits.filter("rank <= 2").join(docs.select(F.col(key).alias("doc"), *columns), "doc")
    return two.groupBy("query").agg(*[F.max(F.when(F.col("rank") == i, F.col(c))).alias(f"{c}_{i}") for c in columns for i in (1, 2)])


def trial_hits(clauses: DataFrame, idx: Index, trials: DataFrame, k: int) -> DataFrame:
    """(trial, query, doc, score, rank) for many boost settings (trial, field, factor) in one job: every
    query is asked once per trial, with the trial's factors as boosts. There are few trials."""
    each = clauses.select("query", "term", "field").distinct().join(sized_broadcast(trials), "field")
    hits = top_hits(each.select(F.struct("trial", "query").alias("query"), "term", "field", F.col("factor").alias("boost")), idx, k)
    return hits.select("query.trial", "query.query", "doc", "score", "rank")


def directory(docs: DataFrame, key: str, updated: str) -> DataFrame:
    """The latest delivery of every document."""
    rest = [c for c in docs.columns if c != key]
    return docs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(updated)).alias("_r")).select(key, "_r.*")
