import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evaluate as ev
from ledgerloom.operators import enrich, models, prep, quality, relink, search, searching, stores, tune
from ledgerloom.operators.locate import NOT_STATES, STATES, locate
from ledgerloom.plans import q_search


def test_prep(spark):
    df = spark.createDataFrame([("", "m"), ("u", "m"), ("", ""), (None, None)], "u string, m string")
    assert [r.u for r in prep.fill_primary(df, "u", "m").collect()] == ["m", "u", "", ""]
    kept, dropped = prep.drop_empty(df, "u", "m")
    assert (kept.count(), dropped.count()) == (2, 2)
    numbers = [r.row_no for r in prep.row_numbers(spark.range(100).repartition(7), ["id"], buckets=5).orderBy("id").collect()]
    assert numbers == list(range(100))
    assert [r[0] for r in spark.range(3).select(prep.batch_of(F.col("id"), 2)).collect()] == [0, 0, 1]
    assert [r[0] for r in spark.range(3).select(prep.batch_of(F.col("id"), -1)).collect()] == [0, 1, 2]
    guard = spark.createDataFrame([("8",), ("abc",), ("a-",)], "q string").select(prep.needs_search(F.col("q"))).collect()
    assert [r[0] for r in guard] == [False, True, True]
    weights = prep.balanced_weights(spark.createDataFrame([("a",)] * 3 + [("b",)] + [(None,)], "c string"), "c")
    assert weights.agg(F.sum("weight")).first()[0] == pytest.approx(1.1 - 0.0, abs=0.11)


def test_accuracy(spark):
    machine = spark.createDataFrame([(1, "A"), (2, ""), (3, "B"), (4, "c")], "id int, label string")
    human = spark.createDataFrame([(1, "a", 1), (1, "x", 0), (2, "a", 0), (4, "d", 0)], "id int, label string, at int")
    status = ev.accuracy_status(machine, ev.last_wins(human, "id", ["at"]), "id", "label", "label")
    assert {r.id: r.status for r in status.collect()} == {1: "correct", 2: "unlabeled", 3: "needs_hand", 4: "mislabeled"}
    m = ev.accuracy_metrics(status).first()
    assert (m.total, m.labeled_percent, m.verified_percent, m.predictive_accuracy) == (4, 75.0, 50.0, 50.0)


def test_class_report(spark):
    long = spark.createDataFrame([(1, 1, 8), (1, 2, 2), (2, 2, 5), (3, 1, 1)], "actual int, predicted int, n long")
    r = {x.label: x for x in ev.class_report(long).collect()}
    assert (r[1].tp, r[1].fp, r[1].fn, r[1].tn) == (8, 1, 2, 5) and r[1].precision == round(8 / 9, 6) and r[3].precision is None and r[3].f_measure is None
    assert ev.overall_accuracy(long).first().accuracy == round(13 / 16, 6)
    assert ev.confusion_grid(long, [1, 2, 3]).count() == 9
    assert {tuple(x) for x in ev.confusion_wide(long, [1, 2, 3]).collect()} == {(1, 8, 2, 0), (2, 0, 5, 0), (3, 1, 0, 0)}


def test_candidates_and_stops(spark):
    c = spark.createDataFrame([("m", "1", 0.9), ("m", "2", 0.9), ("m", "3", 0.1), ("n", "4", 0.2)], "model string, stamp string, score double")
    assert {r.model: r.stamp for r in ev.best_candidate(c, "model", "score", "stamp").collect()} == {"m": "1", "n": "4"}
    pins = spark.createDataFrame([("m", "3")], "model string, stamp string")
    assert {r.model: r.stamp for r in ev.best_candidate(c, "model", "score", "stamp", pins).collect()} == {"m": "3", "n": "4"}
    e = spark.createDataFrame([("m", i, s) for i, s in enumerate([1.0, 3.0, 2.0, 2.0, 2.0, 4.0])], "model string, era int, score double")
    assert [r.stop for r in ev.running_best(e, "model", "era", "score", 3).orderBy("era").collect()] == [False, False, False, False, True, False]


def test_quality(spark, tmp_path):
    a, b = spark.createDataFrame([("1",), ("2",)], "l string"), spark.createDataFrame([("2",), ("3",), ("4",)], "l string")
    assert {tuple(r) for r in quality.label_differences(a, b, "l").collect()} == {("1", "missing"), ("3", "extra"), ("4", "extra")}
    counts = quality.label_counts(spark.createDataFrame([("a",)] * 6 + [("b",)] * 4, "x string"), "x")
    assert [r.label for r in quality.small_classes(counts, 5).collect()] == ["b"]
    assert quality.size_gate(spark.range(96), 100).first().verdict == "warn" and quality.size_gate(spark.range(90), 100).first().verdict == "critical" and quality.size_gate(spark.range(100), 100).first().verdict == "ok"
    (tmp_path / "d.json").write_text('{"1": 1, "1": 2}')
    with pytest.raises(quality.QualityError):
        quality.strict_json(str(tmp_path / "d.json"))
    with pytest.raises(quality.QualityError):
        quality.label_map_table(spark, {"0": "a", "1": "b"})
    table = quality.label_map_table(spark, {"1": {"label": "x", "category": {"credit": "in", "debit": "out"}, "cost": 2}, "2": "y"})
    got = table.withColumn("ledger_entry", F.lit("Credit")).select("label", quality.category_of(), "cost").orderBy("label").collect()
    assert [tuple(r) for r in got] == [("x", "in", 2.0), ("y", None, 1.0)]
    with pytest.raises(quality.QualityError):
        quality.check_header(a, ["k"])


@pytest.mark.parametrize("scores, gap", [([8, 4, 2, 1], 1.492), ([2, 1], 2.0), ([1], None), ([3, 3], None)])
def test_gap(spark, scores, gap):
    hits = spark.createDataFrame([("q", f"d{i}", float(s), i + 1) for i, s in enumerate(scores)], "query string, doc string, score double, rank int")
    assert search.gaps(hits).first().gap == gap


def test_acceptance(spark):
    df = spark.createDataFrame([(3.0, 2.0), (2.857, 2.0), (3.0, 1.0), (None, 2.0), (float("nan"), 2.0)], "g double, s double")
    assert [r[0] for r in df.select(search.accepted(F.col("g"), F.col("s"))).collect()] == [True, False, False, False, False]


def test_search_and_trials(spark):
    docs = spark.createDataFrame([("d1", "blue lodge", "north"), ("d2", "blue diner", "south"), ("d3", "red diner", None), ("d4", None, "east"), ("d5", "x", "x"), ("d6", "y", "y")], "id string, name string, town string")
    idx = search.index(docs, "id", ["name", "town"])
    q = spark.createDataFrame([(1, "Blue DINER"), (2, "nothing"), (3, None)], "k int, t string")
    hits = search.top_hits(search.clause(q, "k", "t", {"name": 2.0, "town": 0.0}), idx, 2)
    assert [(r.query, r.doc) for r in hits.orderBy("query", "rank").collect()] == [(1, "d2"), (1, "d1")]
    trials = tune.trial_table(spark, [{"name": 1.0}, {"name": 4.0, "z_score_threshold": 2.0}])
    t = search.trial_hits(search.clause(q, "k", "t", {"name": 1.0}), idx, trials, 9)
    one, four = ({r.doc: r.score for r in t.filter(F.col("trial") == i).collect()} for i in (0, 1))
    assert len(one) == 3 and all(abs(four[d] - 4 * one[d]) < 1e-5 for d in one)
    assert tune.split_parameters({"raw_score_threshold": 1, "es_result_size": 5}) == ({"raw_score_threshold": 1}, {"es_result_size": 5})
    assert search.top_hits(search.clause(q.limit(0), "k", "t", {"name": 2.0}), idx, 2).count() == 0
    assert search.top_hits(search.clause(q, "k", "t", {"name": 2.0}), search.index(docs.limit(0), "id", ["name"]), 2).count() == 0


def test_common_terms_are_scored(spark, monkeypatch):
    """A chain that holds more than a third of the directory is found by its own name."""
    docs = spark.createDataFrame([(f"d{i}", "bigmart" if i < 4 else f"shop{i}", "north" if i < 9 else "south") for i in range(10)], "id string, name string, town string")
    w = search.weighted(search.postings(docs, "id", ["name", "town"]), docs, "id", ["name", "town"])
    q = spark.createDataFrame([(1, "bigmart"), (2, "shop5 north")], "k int, t string")
    scored = lambda: {(r.query, r.doc): r.score for r in search.score(search.clause(q, "k", "t", {"name": 2.0, "town": 1.0}), w).collect()}
    got = scored()
    idf = lambda df: math.log(1 + (10 - df + 0.5) / (df + 0.5))
    assert {d for k, d in got if k == 1} == {"d0", "d1", "d2", "d3"} and {d for k, d in got if k == 2} == {f"d{i}" for i in range(9)}
    assert got[1, "d0"] == pytest.approx(2 * idf(4), abs=1e-6) and got[2, "d5"] == pytest.approx(2 * idf(1) + idf(9), abs=1e-6) and got[2, "d0"] == pytest.approx(idf(9), abs=1e-6)
    monkeypatch.setattr(search, "PART_DOCS", 2)
    monkeypatch.setattr(search, "PART_CLAUSES", 1)
    assert scored() == got


@pytest.mark.parametrize("k, start", [(1, 0), (3, 0), (2, 3), (60, 0)])
def test_top_hits_equal_those_of_all_scores(spark, k, start):
    """Setting common terms aside changes nothing: many ties, common and rare terms, queries of common terms only."""
    rng = random.Random(5)
    word = lambda: rng.choices(["st", "ave", "north", "shop", *(f"w{i}" for i in range(40))], [30, 20, 15, 15, *[1] * 40])[0]
    docs = spark.createDataFrame([(f"d{i:03}", " ".join(word() for _ in range(rng.randint(1, 6))), word() if i % 7 else None, rng.choice(["a", "b", None])) for i in range(400)], "id string, name string, town string, region string")
    q = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randint(1, 4)))) for i in range(40)] + [(90, "st"), (91, "st ave"), (92, "")], "k int, t string")
    fields = ["name", "town"]
    clauses = search.clause(q, "k", "t", {"name": 2.0, "town": 0.5})
    w = search.weighted(search.postings(docs, "id", fields), docs, "id", fields)
    rows = lambda df: sorted((r.query, r.doc, round(r.score, 5), r["rank"]) for r in df.collect())
    assert rows(search.top_hits(clauses, search.index(docs, "id", fields), k, start)) == rows(search.top_k(search.score(clauses, w), k, start))
    routes = q.select(F.col("k").alias("query"), F.when(F.col("k") % 2 == 0, "a").otherwise("none").alias("route"))
    routed = search.top_hits(clauses.join(routes, "query"), search.index(docs, "id", fields, "region", routes), k, start)
    near = docs.filter("region = 'a'").select(F.col("id").alias("doc"))
    assert rows(routed) == rows(search.top_k(search.score(clauses.filter("query % 2 = 0"), w.join(near, "doc")), k, start))


@pytest.mark.parametrize("name", ["bm25_fields", "bm25_routed", "trial_scores", "store_match", "store_update", "percent_merged", "request_adapter", "char_onehot"])
def test_against_registered_sql(spark, sf, name):
    import duckdb

    from ledgerloom.plans import catalogue

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("merchants", "labeled_transactions", "store_numbers"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = catalogue.queries()[name](spark, sf)
    cols = sorted(df.columns)
    rows = lambda found: sorted(repr(tuple(round(v, 5) if isinstance(v, float) else v for v in r)) for r in found)
    assert rows(df.select(cols).collect()) == rows(con.execute(f"SELECT {', '.join(cols)} FROM ({catalogue.oracle_sql()[name]})").fetchall())


def brute_locate(text, towns):
    import re

    names = {}
    short = {"EAST": "E", "WEST": "W", "NORTH": "N", "SOUTH": "S", "SAINT": "ST", "FORT": "FT", "BEACH": "BCH"}
    for city, state in towns:
        forms = [""]
        for token in city.upper().split():
            forms = [f + x for f in forms for x in ([token, short[token]] if token in short else [token])]
        for f in forms:
            names[state + f] = (city, state)
    plain = re.sub(" co id:", "", text, flags=re.I)
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    spaced = plain.replace("'", "")
    for m in marks:
        spaced = spaced.replace(m, " ")
    begins, at = [0] if not spaced.split() else [], 0
    for token in spaced.split():
        begins.append(at)
        at += len(token)
    begins.append(at)
    t = "".join(c for c in "".join(plain.upper().split()) if c not in marks)
    for i in range(len(t) - 2, -1, -1):
        st = t[i : i + 2]
        word = t[i : min([b for b in begins if b > i], default=len(t))]
        if st in STATES and i + 1 not in begins and word not in NOT_STATES:
            best = next((j for j in range(0, i - 2) if st + t[j:i] in names), None)
            if best is not None:
                key = st + t[best:i]
                if key[2] in "EWSN" and best not in begins and key[:2] + key[3:] in names:
                    key = key[:2] + key[3:]
                return names[key]
    for i in range(len(t) - 2, -1, -1):
        st = t[i : i + 2]
        if st in STATES and (i == len(t) - 2 or i + 2 in begins):
            for j in range(0, i - 7):
                full = sorted((len(k), k) for k in names if k.startswith(st + t[j:i]) and len(k) - 2 - (i - j) <= 4)
                if full:
                    return names[full[0][1]]
    return None


TOWNS = [("York", "PA"), ("New York", "NY"), ("Union", "NJ"), ("Union City", "NJ"), ("Fort Worth", "TX"), ("West Fort Lee", "NJ"), ("Los Angeles", "CA"), ("Saint Paul", "MN"), ("Astoria", "OR"), ("East Orange", "NJ"), ("Orange", "NJ")]
TEXTS = [
    "POS CAFE YORK, PA", "CAFE YORK PA 123", "joe's diner, new york ny", "newyorkny", "UNION CITY NJ", "STORE UNION NJ CARD", "W FT LEE NJ", "SHOP FT. WORTH TX~~99", "LOS ANGEL CA", "LOS ANGELES CARD", "LA LA LA", "NOWHERE ZZ", "", "x", "co id: york pa Co ID: 7",
    "ST PAUL MONTHLY MN", "STORE ORANGE NJ", "STOREORANGENJ", "ASTORIA OR PORTLAND OR", "SAINT PAU MN", "WORTHTX FORT WORTH", "e orange nj",
]


def test_locate_against_brute_force(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    cities = spark.createDataFrame(TOWNS, "canonical_city string, state string")
    got = {r.t: (r.city, r.state) for r in locate(df, "t", cities).collect()}
    assert got == {t: brute_locate(t, TOWNS) for t in TEXTS if brute_locate(t, TOWNS)}
    assert locate(df.limit(0), "t", cities).count() == 0


def test_relink(spark):
    fields = "factual_id string, place_name string, address string, locality string, region string, postcode string"
    old = spark.createDataFrame([("a", "A", "1", "x", "S", "1"), ("b", "B", "1", "x", "S", "1"), ("c", "C", None, "x", "S", "1"), ("g", "G", "", "", "", "")], fields)
    new = spark.createDataFrame([("a", "A", "1", "x", "T", "1"), ("b", "B", "1", "x", "S", "1"), ("c", "C", "", "x", "S", "1"), ("NULL", "N", "", "", "", "")], fields)
    rows = spark.createDataFrame([(1, "a", ""), (2, "b", ""), (3, "c", ""), (4, "g", ""), (5, "NULL", ""), (6, "", ""), (7, None, ""), (8, "b", "z")], "i int, factual_id string, relinked_id string")
    got = {r.i: r.bucket for r in relink.snapshot_difference(rows, "factual_id", old, new, "relinked_id").collect()}
    assert got == {1: "details_changed", 2: "unchanged", 3: "unchanged", 4: "id_changed", 5: "null", 6: "unlinked", 7: "unlinked", 8: "relinked"}
    found = {r.i: (r.found_place_name, r.merchant_found) for r in relink.lookup(rows, new, "factual_id", ["place_name"]).collect()}
    assert found[1] == ("A", True) and found[5] == ("", False) and found[7] == ("", False)
    context = relink.user_context(spark.createDataFrame([("u", "b", 1), ("u", "a", 2), ("u", "b", 3), ("u", "", 0), (None, "z", 0)], "u string, c string, p int"), "u", "c", ["p"]).collect()
    assert [tuple(r) for r in context] == [("u", 2, "b; a")]


def test_top_hits_carry_over_blocks_and_parts(spark, monkeypatch):
    """Many small blocks, several parts of queries and rows of codes for common tags give the rows of scoring everything."""
    monkeypatch.setattr(search, "BLOCK_DOCS", 60)
    monkeypatch.setattr(search, "PART_QUERIES", 12)
    rng = random.Random(7)
    word = lambda: rng.choices(["st", "ave", "north", *(f"w{i}" for i in range(30))], [30, 20, 15, *[1] * 30])[0]
    docs = spark.createDataFrame([(f"d{i:03}", " ".join(word() for _ in range(rng.randint(1, 5)))) for i in range(300)], "id string, name string")
    q = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randint(1, 4)))) for i in range(40)], "k int, t string")
    clauses = search.clause(q, "k", "t", {"name": 2.0})
    rows = lambda df: sorted((r.query, r.doc, round(r.score, 5), r["rank"]) for r in df.collect())
    hits = search.best_hits(clauses, search.index(docs, "id", ["name"]), 5)
    every = search.top_k(search.score(clauses, search.weighted(search.postings(docs, "id", ["name"]), docs, "id", ["name"])), 5).cache()
    assert rows(hits.rows()) == rows(every)
    assert {r.query: (r.n_hits, r.gap) for r in hits.gaps().collect()} == {r.query: (r.n_hits, r.gap) for r in search.gaps(every).collect()}


def test_rare_and_common_tags_of_a_block():
    """A store's 45 best records need no look at the 99,000 records that share a common word with it."""
    rng = np.random.default_rng(3)
    n = 100_000
    rare = np.sort(rng.choice(n, 60, replace=False)).astype(np.int64)
    ids, t = np.r_[np.arange(n), rare], np.r_[np.zeros(n, np.int64), np.ones(len(rare), np.int64)]
    rows = pa.record_batch([pa.array(x) for x in (np.zeros(len(ids), np.int32), ids, t, np.where(t == 0, 0.1, 9.0), np.full(len(ids), 1.2))], names=["block", "id", "t", "idf", "norm"])
    block = searching.Block(next(searching.pack(iter([rows]))).column("piece")[0].as_py())
    part = searching.Part(45)
    part.add(pa.record_batch([pa.array([7]), pa.array([[0, 1]]), pa.array([[1.0, 1.0]])], names=["q", "ts", "boosts"]))
    part.close()
    part.search(block)
    (hits,) = part.hits()
    assert part.looked == len(rare) and hits.column("id").to_pylist() == rare[:45].tolist() and hits.column("rank").to_pylist() == list(range(1, 46))


def test_tags_that_cannot_reach_are_not_looked_at():
    """Once a query's hits are known, documents of a later block that hold only its lesser rare tag are not looked
    at; those that hold a greater one count with both."""
    def block(n, ids, t):
        columns = (np.full(len(ids), n, np.int32), ids, t, np.where(t == 0, 1.0, 9.0), np.full(len(ids), 1.2))
        rows = pa.record_batch([pa.array(x) for x in columns], names=["block", "id", "t", "idf", "norm"])
        return searching.Block(next(searching.pack(iter([rows]))).column("piece")[0].as_py())

    part = searching.Part(3)
    part.add(pa.record_batch([pa.array([7]), pa.array([[0, 1]]), pa.array([[1.0, 1.0]])], names=["q", "ts", "boosts"]))
    part.close()
    part.search(block(0, np.arange(5), np.ones(5, np.int64)))
    part.looked = 0
    part.search(block(1, np.r_[np.arange(10, 110), 10], np.r_[np.zeros(100, np.int64), 1]))
    assert part.looked == 1
    (hits,) = part.hits(2)
    assert hits.column("id").to_pylist() == [10, 0] and hits.column("score").to_pylist() == [10.0, 9.0]
    assert hits.column("n_hits").to_pylist() == [3, 3] and hits.column("second").to_pylist() == [9.0, 9.0]
    assert hits.column("spread").to_pylist() == pytest.approx([np.std([10.0, 9.0, 9.0])] * 2)


def test_first_hits_are_kept_with_the_gaps_of_all(spark):
    docs = spark.createDataFrame([(f"d{i}", "elm " * (i % 3 + 1) + "oak" * (i % 2)) for i in range(9)], "id string, name string")
    clauses = search.clause(spark.createDataFrame([(1, "elm oak"), (2, "elm")], "k int, t string"), "k", "t", {"name": 1.0})
    idx = search.index(docs, "id", ["name"])
    all_, first = search.best_hits(clauses, idx, 5), search.best_hits(clauses, idx, 5, first=1)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert first.best.count() == 2 and rows(first.rows()) == rows(all_.first(1))
    assert rows(first.gaps()) == rows(search.gaps(all_.rows()))


def test_queries_are_told_apart_once(spark):
    """Which distinct query each query is, is kept: neither hits nor gaps join the queries by what they seek again."""
    q = spark.createDataFrame([(i, "elm oak" if i % 2 else "elm") for i in range(6)], "k int, t string")
    clauses = search.clause(q, "k", "t", {"name": 1.0, "street": 2.0}).unionByName(search.clause(q, "k", "t", {"name": 3.0}))
    docs = spark.createDataFrame([(f"d{i}", "elm oak" if i % 3 else "oak", "elm") for i in range(5)], "id string, name string, street string")
    hits = search.best_hits(clauses, search.index(docs, "id", ["name", "street"]), 3)
    assert "Join" not in hits.own._jdf.queryExecution().optimizedPlan().toString()
    every = search.top_k(search.score(clauses, search.weighted(search.postings(docs, "id", ["name", "street"]), docs, "id", ["name", "street"])), 3)
    rows = lambda df: sorted((r.query, r.doc, round(r.score, 5), r["rank"]) for r in df.collect())
    assert rows(hits.rows()) == rows(every)


def test_descriptions_are_cleaned_once_for_all_clauses(spark):
    rows = spark.createDataFrame([(1, "POS Blue Lodge 77", "Tellby", None), (2, "ab", "Marsk", "OR"), (3, None, None, None), (4, "Red Diner", None, "TX")], "k int, d string, c string, s string")
    made = enrich.clauses(rows, "k", "d", "c", "s", boosts={"place_name": 2.0})
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
    got = {(r["query"], r.term, r.field, r.boost) for r in made.collect()}
    assert {(1, "lodge", "place_name", 2.0), (1, "tellby", "locality", 1.0), (4, "tx", "region", 1.0), (4, "diner", "place_name", 2.0)} <= got
    assert {g[0] for g in got} == {1, 4}


def test_stores(spark):
    merchants = spark.createDataFrame([("f1", "Blue Lodge Inn", "1 Elm St", "Tellby", "OR", "97001"), ("f2", "Red Diner", "9 Oak Rd", "Marsk", "TX", "70001"), ("f3", "Green Toys", "8 Ash Rd", "Marsk", "TX", "70001"), ("f4", "Grey Toys", "7 Fir Rd", "Yarl", "ME", "00001"), ("f5", "Pink Shoes", "6 Yew Rd", "Yarl", "ME", "00001"), ("f6", "Teal Shoes", "5 Bay Rd", "Yarl", "ME", "00001")], "factual_id string, place_name string, address string, locality string, region string, postcode string")
    rows = spark.createDataFrame([(1, "blue lodge", "1 Elm St", "Tellby", "OR", "97001-2222", "17"), (2, "zzz", None, None, None, None, "9")], "store_row int, keywords string, address string, city string, state string, zip_code string, aggdata_store_number string")
    m = stores.match_stores(rows, merchants)
    got = {r.store_row: (r.n_hits, r.matched, r.factual_id) for r in m.collect()}
    assert got[2] == (0, False, None) and got[1][0] >= 1
    assert stores.merged_percent(m).count() == 2
    assert {r.factual_id: r.internal_store_number for r in stores.update_directory(merchants, m.withColumn("matched", F.lit(True)).withColumn("factual_id", F.lit("f1")), rows).collect()}["f1"] == "9"


def test_repeated_stores_are_sought_once(spark):
    """Stores that seek the same share one search and one gap, and each counts in the percentage."""
    merchants = spark.createDataFrame([(f"f{i}", f"Blue Lodge {i}", "Tellby" if i else "Marsk") for i in range(5)], "factual_id string, place_name string, locality string")
    rows = spark.createDataFrame([(i, "blue lodge 0" if i else "zzz", "Marsk") for i in range(9)], "store_row int, keywords string, city string")
    clauses = search.clause(rows, "store_row", "keywords", {"place_name": 1.0}).unionByName(search.clause(rows, "store_row", "city", {"locality": 1.0}))
    hits = search.best_hits(clauses, search.index(merchants, "factual_id", ["place_name", "locality"]), 45)
    assert hits.best.select("q").distinct().count() == 2 and hits.own.count() == 9
    assert {(r.query, r.doc) for r in hits.first(1).collect()} == {(i, "f0") for i in range(9)}
    gaps = {r.query: (r.n_hits, r.gap) for r in hits.gaps().collect()}
    assert len(gaps) == 9 and len({gaps[i] for i in range(1, 9)}) == 1 and gaps[0] == (1, None)


def test_shaped_output_searches_once(spark, sf):
    """Rows, places and hits of the shaped records come from one search, whose result is kept."""
    shaped = q_search.debug_shape(spark, sf)
    plan = shaped._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and shaped.count() == shaped.select("transaction_id").distinct().count() > 0


def test_debug_shape_has_every_transaction(spark, sf):
    """One record for each transaction of the table, those without a description unlabelled."""
    ids = [r.transaction_id for r in q_search.debug_shape(spark, sf).select("transaction_id").collect()]
    table = spark.read.parquet(f"{sf}/labeled_transactions.parquet").select("transaction_id").distinct()
    assert sorted(ids) == sorted(r.transaction_id for r in table.collect())


def test_output_shape_has_every_transaction(spark, sf):
    """One record for each transaction of the table, with a merchant for some whose id is not divisible by 50."""
    rows = q_search.output_shape(spark, sf).select("transaction_id", F.get_json_object("json", "$.match_found").alias("m")).collect()
    table = spark.read.parquet(f"{sf}/labeled_transactions.parquet").select("transaction_id").distinct()
    assert sorted(r.transaction_id for r in rows) == sorted(r.transaction_id for r in table.collect())
    assert any(r.m == "true" and r.transaction_id % 50 for r in rows)


def test_texts_of_the_same_known_words_are_one_query(spark):
    """Words count that any document holds, also documents with NULL fields; others tell no queries apart."""
    docs = spark.createDataFrame([("f1", "Blue Lodge", None), ("f2", "Red Diner", "Tellby")], "factual_id string, place_name string, locality string")
    rows = spark.createDataFrame([(1, "blue lodge 555", None, None), (2, "lodge blue 666", None, None), (3, "blue lodge", "Tellby", "OR"), (4, "777", None, None), (5, None, None, None)], "id int, q string, city string, state string")
    got = {r.id: (r.sought, r.words, r.city) for r in enrich._sought(rows, "id", "q", "city", "state", search.index(docs, "factual_id", ["place_name", "locality"])).collect()}
    assert got[1] == got[2] and got[1][1:] == ("blue lodge", "") and got[3][1:] == ("blue lodge", "Tellby")
    assert len({got[i][0] for i in (1, 3, 4)}) == 3 and got[4][1] == "" and 5 not in got


def test_model_reaches_held_out_accuracy(spark):
    rows = spark.createDataFrame([(f"coffee shop {i}", "food") for i in range(60)] + [(f"airline ticket {i}", "travel") for i in range(60)] + [(None, "food"), ("x", None)], "t string, l string")
    model = models.fit(rows, "t", "l", features=1 << 10, rounds=5)
    test = spark.createDataFrame([("the coffee shop", "food"), ("ticket airline", "travel"), (None, "food")], "t string, l string")
    got = [(r.l, r.predicted) for r in models.predict(model, test, "t").collect()]
    assert got[:2] == [("food", "food"), ("travel", "travel")] and len(got) == 3
    soft = models.ensemble_scores([model, model], test, "t")
    assert all(abs(sum(r.scores) - 1) < 1e-6 for r in soft.collect())
