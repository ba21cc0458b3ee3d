import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as tx
from ledgerloom.functions.arrays import first_of_list, score_matrix
from ledgerloom.operators import documents, models, prep, quality, service, tagger, tune
from ledgerloom.operators import evaluate as ev
from ledgerloom.sources import readers, writers

MERCHANTS = [("f1", "Blue Lodge", "Tellby", "OR"), ("f2", "Blue Lodge", "Marsk", "TX"), ("f3", "Red Diner", "Marsk", "TX"), *[(f"g{k}", f"Filler Shop{k}", f"Town{k}", f"S{k}") for k in range(14)]]
ROWS = [
    (1, "POS BLUE LODGE TELLBY OR", "debit", "bank", None), (2, "POS BLUE LODGE TELLBY OR", "debit", "bank", ["cnn_merchant", "bloom_filter"]), (3, "salary", "credit", "bank", None),
    (4, None, "debit", "card", None), (5, "POS RED DINER MARSK TX", "debit", "bank", ["cnn_subtype"]),
]


@pytest.fixture(scope="module")
def fitted(spark):
    rows = [("pos blue lodge", "1", "Travel - Lodging")] * 4 + [("pos red diner", "1", "Food - Dining")] * 4 + [("salary", "0", "Income - Salary"), ("transfer", "0", "Income - Salary")] * 4
    df = spark.createDataFrame(rows, "t string, p string, s string")
    return {"physical": models.fit(df, "t", "p", features=1 << 8, rounds=8), "subtype": models.fit(df.filter("p = '1'"), "t", "s", features=1 << 8, rounds=8)}


def test_plan(spark, fitted):
    merchants = spark.createDataFrame([(i, n, None, None, t, st, None, "US", None, None, None, None, 1.0, 2.0) for i, n, t, st in MERCHANTS], "factual_id string, place_name string, address string, address_extended string, locality string, region string, postcode string, country string, tel string, website string, category_labels string, chain_name string, longitude double, latitude double")
    cities = spark.createDataFrame([("Tellby", "OR"), ("Marsk", "TX")], "canonical_city string, state string")
    rows = spark.createDataFrame(ROWS, "transaction_id long, description string, ledger_entry string, container string, services_list array<string>")
    kinds = {"physical": {"bank": fitted["physical"]}, "subtype": {"bank_debit": fitted["subtype"]}}
    done = service.classify(rows, "transaction_id", kinds, merchants, cities, least_gap=0.5)
    got = {r.transaction_id: r for r in done.collect()}
    assert len(got) == 5 and {i: got[i].is_physical_merchant for i in got} == {1: True, 2: True, 3: False, 4: False, 5: True}
    assert (got[1].merchant_name, got[1].match_found, got[1].city, got[1].country, got[1].txn_type, got[1].txn_sub_type) == ("Blue Lodge", True, "Tellby", "US", "Travel", "Lodging")
    assert (got[2].merchant_name, got[2].match_found, got[2].source, got[2].city, got[2].txn_type) == ("", False, "OTHER", "Tellby", "")  # not searched
    assert (got[3].city, got[3].match_found, got[3].street, got[3].txn_type) == ("", None, None, "")  # no model for credits
    assert (got[5].city, got[5].country, got[5].source) == ("", "", "OTHER") and got[5].txn_type == "Food"
    plain = {r.transaction_id: json.loads(r.json) for r in service.output(done, "transaction_id").collect()}
    assert "street" not in plain[3] and plain[1]["fax_number"] == "" and "search" not in plain[1]
    debug = {r.transaction_id: json.loads(r.json) for r in service.output(done, "transaction_id", debug=True).collect()}
    assert len(debug[1]["search"]) == 15 and "search" not in debug[3] and debug[1]["bloom_filter"] == {"city": "Tellby", "state": "OR"} and set(debug[3]["cnn"]) == {"txn_type", "txn_sub_type", "merchant_name", "category_labels", "merchant_score", "subtype_score", "category_score"}
    assert service.response_faults(service.output(done, "transaction_id"), "transaction_id").count() == 0
    torn = spark.createDataFrame([(1, json.dumps(plain[1] | {"street": None})), (3, json.dumps({k: v for k, v in plain[3].items() if k != "city"}))], "transaction_id long, json string")
    assert {r.transaction_id for r in service.response_faults(torn, "transaction_id").collect()} == {1, 3}
    assert service.classify(rows.limit(0), "transaction_id", {}, merchants, cities).count() == 0


def test_switches(spark):
    lists = [None, [], ["search"], ["cnn_subtype"], ["cnn_merchant", "bloom_filter"], ["bloom_filter", "cnn_merchant", "search"], ["bloom_filter"]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, s array<string>")
    flags = {r.i: tuple(r)[2:] for r in df.withColumns(service.stages(F.col("s"))).orderBy("i").collect()}
    assert flags[0] == flags[1] == (True,) * 5 and flags[2] == (False, True, False, False, False) and flags[3] == (False, False, True, True, False)
    assert [r[0] for r in df.orderBy("i").select(service.allowed_combination(F.col("s"))).collect()] == [True, True, False, True, True, True, False]
    off = [r[0] for r in df.orderBy("i").select(service.stages(F.col("s"), skip_search=True)["runs_search"]).collect()]
    assert off == [False, False, True, False, False, True, False]


def test_documents(spark):
    df = spark.createDataFrame([(1, "a", "", "(541) 555-0123", 1.5, 2.0, " "), (2, None, " x ", "none", None, 2.0, "OR")], "id int, a string, b string, tel string, longitude double, latitude double, region string")
    one, two = documents.dispersed(df, "tel", r"\((?P<area>\d{3})\) \d{3}-(?P<line>\d{4})").orderBy("id").collect()
    assert (one.area, one.line, two.area) == ("541", "0123", None)
    assert [r[0] for r in df.orderBy("id").select(documents.composite("{1}, {0} 100%", ["a", "b"])).collect()] == [", a 100%", "x ,  100%"]
    pin = [r.pin for r in documents.with_point(df).orderBy("id").collect()]
    assert pin[0].coordinates == ["1.500000", "2.000000"] and pin[1] is None
    assert [r.region for r in documents.with_region(df).orderBy("id").collect()] == ["XX", "OR"]
    assert [json.loads(r.document) for r in documents.sparse_json(df, ["a", "b"]).orderBy("id").collect()] == [{"a": "a"}, {"b": " x "}]
    assert documents.without_blanks(df).filter("b is null").count() == 1
    asked = documents.adapted_requests(df, {"id": "transaction_id", "a": "text"}, ["id"], buckets=2).orderBy("request_pos").collect()
    assert [tuple(r) for r in asked] == [(1, 1, "a", "credit"), (2, 2, None, "credit")]


def test_tagger(spark):
    names = ["blue lodge", "red diner", "green toys", "grey shoes"]
    rows = [(i, f"pos {names[i % 4]} {i} or", names[i % 4]) for i in range(80)] + [(90, "salary", None), (91, None, None)]
    df = spark.createDataFrame(rows, "id long, d string, m string")
    model = tagger.fit(df, "id", "d", "m", features=1 << 10)
    tagged = tagger.tag(model, df.filter("d is not null"), "id", "d")
    found = {r.id: r.merchant for r in tagger.merchants_of(tagged, "id").collect()}
    assert all(found[i] == names[i % 4] for i in range(80)) and found[90] == ""
    truth = tagger.token_rows(df.filter("m is not null"), "id", "d", "m").select("id", "pos", F.col("tag").alias("actual"))
    report = tagger.tag_report(truth.join(tagged, ["id", "pos"]), "id").first()
    assert tuple(report) == (400, 80, 1.0, 80, 1.0)
    ids = df.limit(1).select(tagger.character_indices(F.lit("Ab!"), "ab", 6), tagger.character_indices(F.lit("abab" * 9), "ab", 5), tagger.character_indices(F.lit(""), "ab", 3)).first()
    assert [list(x) for x in ids] == [[1, 3, 4, 5, 2, 0], [1, 3, 4, 3, 2], [1, 2, 0]]
    words = tagger.vocabulary(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "n int, w string"), "w", ["n"], 2)
    assert {(r.word, r.word_index) for r in words.collect()} == {("a", 1), ("b", 2)}
    rows = spark.createDataFrame([(1, ["B", "x", "a", "a"]), (2, [])], "id int, ts array<string>")
    assert {r.id: list(r.word_indices) for r in tagger.word_indices(rows, "id", "ts", words, 3).collect()} == {1: [2, 0, 1]}


def test_sources_and_sinks(spark, tmp_path, fitted):
    (tmp_path / "e.txt").write_text("a 1 2\nb 3 4\na 9 0\na 5 6\n")
    assert {r.word: list(r.vector) for r in readers.embeddings(spark, str(tmp_path / "e.txt")).collect()} == {"a": [5.0, 6.0], "b": [3.0, 4.0]}
    for stamp in ("00000000000009", "123", "99x", "20200101000000"):
        (tmp_path / "v" / stamp).mkdir(parents=True)
        (tmp_path / "v" / stamp / "f").write_text("x")
    assert readers.newest_version(spark, str(tmp_path / "v")) == "20200101000000"
    assert readers.exists(spark, str(tmp_path / "e.txt")) and not readers.exists(spark, str(tmp_path / "none"))
    changed, mark = readers.changed_since(spark, str(tmp_path / "e.txt"), None)
    assert changed and readers.changed_since(spark, str(tmp_path / "e.txt"), mark) == (False, mark)
    with pytest.raises(readers.SourceError):
        readers.changed_since(spark, str(tmp_path / "none"), None)
    assert readers.pull_only(spark, str(tmp_path), ".txt").endswith("e.txt") and readers.line_count(spark, str(tmp_path / "e.txt")) == 3
    (tmp_path / "p.csv").write_text("A|b\n1|\n|2\n")
    assert [tuple(r) for r in readers.merged(spark, [str(tmp_path / "p.csv")], ["A", "b"], needed=["b"]).collect()] == [("", "2")]
    assert readers.renamed(spark, str(tmp_path / "p.csv"), {"A": "a"}, {"k": "bank"}).columns == ["a", "b", "k"]
    (tmp_path / "h.json").write_text('{"boost": "1.5", "labels": ["x"]}')
    assert readers.hyperparameters(str(tmp_path / "h.json")) == {"boost": 1.5, "labels": ["x"]}
    with pytest.raises(readers.SourceError):
        readers.hyperparameters(str(tmp_path / "no.json"))
    rows = spark.createDataFrame([("s1", True), ("s2", False), ("s3", True)], "s string, matched boolean")
    assert writers.write_merge_report(rows, str(tmp_path), "report").endswith("report_66.67")
    writers.write_relinked(rows.withColumn("relinked_id", F.lit("n")), ["matched"], ["s", "matched"], str(tmp_path / "saved"))
    assert {tuple(r) for r in readers.piped(spark, str(tmp_path / "saved")).collect()} == {(f"s{i}", "", "n") for i in (1, 2, 3)}
    writers.push(spark, str(tmp_path / "e.txt"), str(tmp_path / "pushed.txt"))
    assert (tmp_path / "pushed.txt").read_text() == (tmp_path / "e.txt").read_text()
    snap = spark.createDataFrame([("f1", "OR", 1)], "k string, r string, v int")
    writers.upsert(None, snap, "k", "v", "r", str(tmp_path / "s1"), files=4)
    old = spark.read.parquet(str(tmp_path / "s1")).select("k", "r", "v")
    writers.upsert(old, spark.createDataFrame([("f1", "OR", 2), ("f2", "TX", 1)], snap.schema), "k", "v", "r", str(tmp_path / "s2"), files=4)
    writers.upsert(None, snap, "k", "v", "r", str(tmp_path / "s2"), mode="ignore")
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "s2")).collect()} == {("f1", 2), ("f2", 1)}
    models.save(fitted["physical"], str(tmp_path / "m"), "bank_sws", "20200101000000")
    assert models.labels_of(models.load(spark, str(tmp_path / "m"), "bank_sws")) == ["0", "1"]
    with pytest.raises(ValueError):
        models.save(fitted["physical"], str(tmp_path / "m"), "other", "1")


def test_small_ones(spark):
    schema = {"n": {"type": int, "least": 1}, "kind": {"allowed": ["a", "b"]}, "names": {"type": list, "items": str, "required": False}}
    assert quality.validate_config({"n": 1, "kind": "a"}, schema) == {"n": 1, "kind": "a"}
    for bad in ({"n": 0, "kind": "a"}, {"n": True, "kind": "a"}, {"kind": "a"}, {"n": 1, "kind": "c"}, {"n": 1, "kind": "a", "x": 1}, {"n": 1, "kind": "a", "names": [1]}):
        with pytest.raises(quality.QualityError):
            quality.validate_config(bad, schema)
    df = spark.createDataFrame([("10",), ("9",), ("x",), ("0100",), ("007",)], "t string")
    assert [r.t for r in df.orderBy(prep.numeric_order(F.col("t"))).collect()] == ["007", "9", "10", "0100", "x"]
    assert sorted(r.position for r in prep.shuffled(df, 3).collect()) == list(range(5))
    assert tuple(ev.chi_square(spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "g string"), "g").first()) == (8, 2, 2.0, 1)
    moved = tune.bounded_step([0.0, 1.0], 0.5, 0.0, 1.0, random.Random(1))
    assert all(0 <= v <= 1 for v in moved) and moved != [0.0, 1.0]
    got = spark.createDataFrame([(-0.001,), (-1.0,), (0.0,), (-20.0,), (-5.5,)], "x double").select(tx.score_text(F.col("x"))).collect()
    assert [r[0] for r in got] == ["0.999", "0.367879", "1", "2.06115e-09", "0.00408677"]
    assert tx.model_path("bank_debit_subtype") == "bank/debit/subtype" and tx.model_name("/bank/debit/") == "bank.debit"
    row = spark.createDataFrame([(["a", "b"], 0.25, 0.75)], "l array<string>, class_1 double, class_2 double").select(first_of_list(F.col("l")), score_matrix(2)).first()
    assert row[0] == "a" and list(row[1]) == [0.25, 0.75]
