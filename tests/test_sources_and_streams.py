import json
import tarfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import enrich
from ledgerloom.operators.locate import STATES
from ledgerloom.sources import readers, writers
from ledgerloom.streaming import classify


def test_piped(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ID|TEXT|LABEL\n1|say "hi|x\n2||\n3|short\n4|too|many|fields\n')
    df = readers.piped(spark, str(tmp_path / "a.csv"))
    assert sorted(tuple(r) for r in df.collect()) == [("1", 'say "hi', "x"), ("2", "", ""), ("3", "short", "")]
    assert readers.piped(spark, str(tmp_path / "a.csv"), ["LABEL"]).columns == ["LABEL"]
    (tmp_path / "b.csv").write_text("ID|TEXT|LABEL\n9|b|y\n|none|z\n")
    assert readers.merged(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], ["ID", "LABEL"]).count() == 4


def test_other_scans(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Keywords,city,\n"Joe, Inc",X,\n')
    assert [tuple(r) for r in readers.quoted(spark, str(tmp_path / "s.csv"), {"Keywords": "keywords"}).collect()] == [("Joe, Inc", "X")]
    (tmp_path / "m.tab").write_text("id\tname\tcity\nf1\tA\tX\nf2\tB\nf3\tC\tX\tmore\n")
    good, bad = readers.tabbed_documents(spark, str(tmp_path / "m.tab"))
    assert sorted(tuple(r) for r in good.collect()) == [("f1", "A", "X"), ("f2", "B", "")] and bad.first().n_fields == 4
    (tmp_path / "g.tab").write_text("0\t0\tTellby\t0\tor\n0\t0\t123\t0\tor\n0\t0\tNowhere\t0\tzz\n")
    assert [tuple(r) for r in readers.gazetteer_tabbed(spark, str(tmp_path / "g.tab"), STATES).collect()] == [("Tellby", "OR")]
    (tmp_path / "g.json").write_text(json.dumps({"aggregations": {"states": {"buckets": [{"key": "or", "localities": {"buckets": [{"key": "tellby"}, {"key": "marsk"}]}}]}}}))
    assert sorted(tuple(r) for r in readers.gazetteer_nested(spark, str(tmp_path / "g.json")).collect()) == [("marsk", "OR"), ("tellby", "OR")]
    (tmp_path / "e.txt").write_text("The 1 2\nthe 3 4\na 5 6\n")
    assert {r.word: r.vector for r in readers.embeddings(spark, str(tmp_path / "e.txt"), True).collect()} == {"the": [3.0, 4.0], "a": [5.0, 6.0]}


def test_archives_and_versions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("x.csv", "y.csv", "map.json"):
        (tmp_path / "in" / n).write_text("a|b\n1|2\n")
    writers.check_upload(str(tmp_path / "in"))
    writers.pack([str(p) for p in sorted((tmp_path / "in").iterdir())], str(tmp_path / "p.tar.gz"))
    assert len(readers.unpack(str(tmp_path / "p.tar.gz"), str(tmp_path / "out"))) == 3
    assert readers.only_file(str(tmp_path / "p.tar.gz"), r"\.json$", str(tmp_path / "o2")).name == "map.json"
    with pytest.raises(readers.SourceError):
        readers.only_file(str(tmp_path / "p.tar.gz"), r"\.csv$", str(tmp_path / "o3"))
    (tmp_path / "in" / "notes.txt").write_text("")
    with pytest.raises(readers.SourceError):
        writers.check_upload(str(tmp_path / "in"))
    with tarfile.open(tmp_path / "evil.tar", "w") as tar:
        tar.add(tmp_path / "in" / "x.csv", arcname="../../evil.csv")
    with pytest.raises(readers.SourceError):
        readers.unpack(str(tmp_path / "evil.tar"), str(tmp_path / "out"))
    for v in ("20200101000000", "20210101000000"):
        (tmp_path / "v" / v).mkdir(parents=True)
        (tmp_path / "v" / v / "input.tar").write_text("x")
    assert readers.newest_version(spark, str(tmp_path / "v")) == "20210101000000" and readers.listing(spark, str(tmp_path / "v"), "input.tar").count() == 2


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, t string, u string")
    writers.write_piped(df, str(tmp_path / "w"), ["u", "id", "missing"])
    assert sorted(tuple(r) for r in readers.piped(spark, str(tmp_path / "w")).collect()) == [("", "1"), ("x", "2")]
    writers.write_piped(df.limit(0), str(tmp_path / "none"))
    assert readers.piped(spark, str(tmp_path / "none")).count() == 0
    writers.write_soft_targets(df.select("id", F.array(F.lit(0.25), F.lit(0.75)).alias("s")), "s", 2, str(tmp_path / "soft"))
    assert readers.piped(spark, str(tmp_path / "soft")).columns == ["id", "class_1", "class_2"]
    rows = spark.createDataFrame([("f1", "A", "OR", 1), ("f1", "B", "OR", 2), ("f2", "C", "TX", 1)], "factual_id string, name string, region string, v int")
    writers.upsert(None, rows, "factual_id", "v", "region", str(tmp_path / "snap"))
    assert {(r.factual_id, r["name"]) for r in spark.read.parquet(str(tmp_path / "snap")).collect()} == {("f1", "B"), ("f2", "C")}


def request(**more):
    t = {"transaction_id": 1, "description": "d", "amount": 1.5, "ledger_entry": "debit", "date": "2020-01-01"}
    return {"cobrand_id": 1, "user_id": 2, "container": "bank", "transaction_list": [t, t | {"transaction_id": 2}]} | more


def test_requests(spark):
    bad = {"transaction_id": 1, "description": "d", "amount": 1.5, "date": "2020-01-01"}
    bodies = [request(), request(container="cash"), request(transaction_list=[]), request(transaction_list=[bad]), request(transaction_list=[request()["transaction_list"][0]] * 2), {"x": 1}]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(99, "not json"), (98, None)], "request_id long, value string")
    rows, refused = readers.request_rows(df)
    assert sorted((r.request_id, r.pos, r.transaction_id) for r in rows.collect()) == [(0, 0, 1), (0, 1, 2)]
    assert {r.request_id for r in refused.collect()} == {1, 2, 3, 4, 5, 98, 99}


def test_stream_equals_batch(spark, tmp_path):
    merchants = spark.createDataFrame(
        [(f"f{i:02d}", n, f"{i} Elm St", None, t, st, "97001", "US", None, None, None, None, 1.0, 2.0) for i, (n, t, st) in enumerate([("Blue Lodge", "Tellby", "OR"), ("Blue Lodge", "Marsk", "TX"), ("Red Diner", "Marsk", "TX"), ("Green Toys", "Yarl", "ME"), ("Grey Shoes", "Yarl", "ME"), ("Pink Hats", "Yarl", "ME"), *[(f"Filler Shop{k}", f"Town{k}", f"S{k}") for k in range(14)]])],
        "factual_id string, place_name string, address string, address_extended string, locality string, region string, postcode string, country string, tel string, website string, category_labels string, chain_name string, longitude double, latitude double",
    )
    cities = spark.createDataFrame([("Tellby", "OR"), ("Marsk", "TX"), ("Yarl", "ME")], "canonical_city string, state string")
    texts = ["POS BLUE LODGE TELLBY OR", "RED DINER MARSK TX", "x", "GREEN TOYS", "BLUE LODGE"]
    body = request(transaction_list=[{"transaction_id": i, "description": t, "amount": 1.0, "ledger_entry": "debit", "date": "d"} for i, t in enumerate(texts)])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.json").write_text(json.dumps(body) + "\n")
    seen = []
    run = classify.classify_stream(classify.request_stream(spark, str(tmp_path / "in")), merchants, cities, lambda df, n: seen.extend(df.collect()), str(tmp_path / "check"))
    run.awaitTermination()
    batch = spark.createDataFrame(list(enumerate(texts)), "row_key long, description string")
    want = enrich.find_merchants(batch, "row_key", "description", merchants, cities, least_gap=0.5).collect()
    plain = lambda rows: sorted((r.description, r.match_found, r.merchant, r.city, r.state, r.country) for r in rows)
    assert plain(seen) == plain(want) and len(seen) == len(texts)
    first = next(r for r in want if r.description == texts[0])
    assert first.match_found and first.merchant == "Blue Lodge" and (first.city, first.state) == ("Tellby", "OR")
    short = next(r for r in want if r.description == "x")
    assert (short.n_hits, short.merchant, short.country) == (0, "", "US")


def test_user_state_stream(spark, tmp_path):
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "a.json").write_text("\n".join(json.dumps({"u": u, "c": c}) for u, c in [("a", "x"), ("a", "y"), ("a", "x"), ("b", "")]) + "\n")
    rows = spark.readStream.schema("u string, c string").json(str(tmp_path / "u"))
    run = classify.user_cities(rows, "u", "c").writeStream.format("memory").queryName("users").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert {tuple(r) for r in spark.table("users").collect()} == {("a", 2, 3), ("b", 0, 1)}
