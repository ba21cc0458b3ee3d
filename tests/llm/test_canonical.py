import pytest

from ledgerloom.llm.canonical import CITY, MERCHANT, Businesses, Entry, Towns, found, map_to_list, misses
from ledgerloom.llm.textkit import DeleteDictionary, distance, shortens

SHOPS = [Entry(1, "Brandlow Lodge", "Lodge"), Entry(2, "Skerrit's Auto Parts", "Auto Parts"), Entry(3, "The Dornick Optical", "Optical"), Entry(4, "Dornick Toys", "Toys")]
TOWNS = [Entry(1, "Port Halvern", "OR"), Entry(2, "Marsk Falls", "TX"), Entry(3, "Tellby", "OR"), Entry(4, "Tellby", "ME"), Entry(5, "Tellby Park", "ME")]


@pytest.mark.parametrize(
    "typed, want",
    [
        ("BRANDLOW LODGE", 1), ("brandlow ldg", 1), ("Lodge, Brandlow", 1), ("Brandlw Lodge #12", 1), ("TPV* Brandlow", 1), ("Brandlow Lodge - Tellby", 1),
        ("skerrits autoparts", 2), ("Skerrit Auto Pts LLC", 2), ("SKERRÍT'S", 2), ("skerritsautoparts.example", 2),
        ("The Dornick Opt", 3), ("Dornick Toys Inc", 4), ("Dornick", 3),
        ("Brandlow Daycare", 0), ("Brandlow & Sons Lodge", 0), ("Vexhall Lodge", 0), ("n/a", 0), ("?", 0), ("x" * 5000, 0),
    ],
)
def test_businesses(typed, want):
    hit = Businesses(SHOPS, Towns(TOWNS).names()).resolve(typed)
    assert (hit.ref_id if hit else 0) == want


@pytest.mark.parametrize(
    "typed, state, want",
    [
        ("Pt Halvern", "", 1), ("PRT  HALVERN, OR", "", 1), ("port_halvren", "OR", 1), ("City of Port Halvern 97001", "", 1),
        ("Marsk Fls", "TX", 2), ("Marsk ", "TX", 2), ("MARSK FALLS (TX)", "", 2),
        ("tellby", "OR", 3), ("tellby", "ME", 4), ("Tellby Prk", "ME", 5), ("tellby", "", 3),
        ("Lake Halvern", "OR", 0), ("Old Marrowby Ridge", "TX", 0), ("", "", 0), ("online", "", 0),
    ],
)
def test_towns(typed, state, want):
    hit = Towns(TOWNS).resolve(typed, state)
    assert (hit.ref_id if hit else 0) == want


def test_dictionary_equals_brute_force():
    entries = ["halvern", "halven", "tellby", "marsk", "telby"]
    book = DeleteDictionary()
    for e in entries:
        book.add(e)
    for text in ("halvren", "tellbyy", "msrak", "hlvrn", "zzzzz"):
        near = {e for e in book.near(text) if distance(text, e, 1.0) <= 1.0}
        assert near == {e for e in entries if distance(text, e, 1.0) <= 1.0}
    assert shortens("phcy", "pharmacy") and not shortens("cy", "pharmacy")
    assert distance("b0b", "bob") == pytest.approx(0.3)


def test_queries_on_awkward_tables(spark):
    shops = spark.createDataFrame([(e.ref_id, e.name, e.extra) for e in SHOPS], "merchant_id long, canonical_name string, trade string")
    towns = spark.createDataFrame([(e.ref_id, e.name, e.extra) for e in TOWNS], "city_id long, canonical_city string, state string")
    rows = [
        (1, "brandlow ldg", "Tellby", "OR", "x"), (1, "brandlow ldg", "Tellby", "OR", "y"), (2, None, " ", None, "x"), (3, "Brandlow Lodge", "tellby", None, "x"),
        (None, "cash", None, "TX", "x"), (4, "z" * 20_000, "PT HALVERN", "OR", None),
    ]
    df = spark.createDataFrame(rows, "transaction_id long, merchant_name string, city string, state string, ref_id string")
    fields = [(MERCHANT, shops), (CITY, towns)]
    got = {(r.transaction_id, r.field_name): r.ref_id for r in found(df, "transaction_id", fields).collect()}
    assert got == {(1, "merchant_name"): 1, (3, "city"): 3, (None, "merchant_name"): 0, (4, "merchant_name"): 0, (4, "city"): 1}
    assert {r.value for r in misses(df, "transaction_id", fields).collect()} == {"cash", "z" * 20_000}
    assert found(df.limit(0), "transaction_id", fields).count() == 0
    assert {r.ref_id for r in found(df, "transaction_id", [(MERCHANT, shops.limit(0)), (CITY, towns.limit(0))]).collect()} == {0}
    blocks = map_to_list(df, "transaction_id", fields, block=2)
    assert {(r.transaction_id, r.field_name): r.ref_id for r in blocks.collect()} == got


def test_towns_of_all_blocks_are_stripped_from_names(spark):
    shops = spark.createDataFrame([(e.ref_id, e.name, e.extra) for e in SHOPS], "merchant_id long, canonical_name string, trade string")
    names = ["Ashvale", "Birchmoor", "Cedarholm", "Dunwick", "Elmstead", "Foxbury", "Gorsley", "Hartwell"]
    towns = spark.createDataFrame([(i, n, "OR") for i, n in enumerate(names, 1)], "city_id long, canonical_city string, state string")
    df = spark.createDataFrame([(i, f"{SHOPS[0].name} of {n}", None, "OR") for i, n in enumerate(names, 1)], "transaction_id long, merchant_name string, city string, state string")
    fields = [(MERCHANT, shops), (CITY, towns)]
    got = lambda **how: {r.transaction_id: r.ref_id for r in map_to_list(df, "transaction_id", fields, **how).collect()}
    assert got(block=2) == got() == {i: SHOPS[0].ref_id for i in range(1, 9)}


def test_blocks_change_nothing(spark):
    """Town suffixes, repeated rows, exact and near spellings, words run together and ties, in blocks of one entry."""
    shops = spark.createDataFrame([(e.ref_id, e.name, e.extra) for e in [*SHOPS, Entry(5, "Brandlov Lodge", "Lodge"), Entry(6, "Brandlow Inn", "Inn")]], "merchant_id long, canonical_name string, trade string")
    towns = spark.createDataFrame([(e.ref_id, e.name, e.extra) for e in [*TOWNS, Entry(6, "Tellbi", "OR"), Entry(7, "Marks Falls", "TX")]], "city_id long, canonical_city string, state string")
    names = ["brandlow ldg", "Brandlov Ldg - Tellby", "brandlowlodge.example", "skerritsautoparts", "brandl0w lodge of Marsk Falls", "Dornick", "Brandlow", "z-pay Dornick Toys", "nothing", None, ""]
    cities = ["tellby", "TELLBY", "Telby", "tellbi ", "marsk fls", "Mraks Falls", "Port Halvren", "none", None, "Tellby Prk", "tellby, ME"]
    rows = [(i % 9, n, c, st) for i, (n, c) in enumerate(zip(names * 3, cities * 3)) for st in ("OR", "ME", None)]
    df = spark.createDataFrame(rows + rows[:7], "transaction_id long, merchant_name string, city string, state string")
    fields = [(MERCHANT, shops), (CITY, towns)]
    got = lambda **how: sorted(map(repr, map(tuple, map_to_list(df, "transaction_id", fields, **how).collect())))
    one = got()
    assert got(block=1) == one == got(block=3) and len(one) > 100
    assert sum(r.n_rows for r in misses(df, "transaction_id", fields).collect()) == sum("ref_id" not in r and r.endswith("0, None)") for r in one)


def test_join_back_without_broadcast(spark, monkeypatch):
    from ledgerloom.llm import canonical

    shops = spark.createDataFrame([(e.ref_id, e.name, e.extra) for e in SHOPS], "merchant_id long, canonical_name string, trade string")
    df = spark.createDataFrame([(i, "brandlow ldg" if i % 2 else f"cash {i}") for i in range(40)], "transaction_id long, merchant_name string")
    got = lambda: sorted(map(tuple, found(df, "transaction_id", [(MERCHANT, shops)]).collect()))
    one = got()
    monkeypatch.setattr(canonical, "MAPPED_ROWS", 3)
    monkeypatch.setattr(canonical, "HEAVY_SHARE", 4)
    assert got() == one and len(one) == 40


def test_conventions_are_an_argument():
    from ledgerloom.llm.canonical import Conventions

    shop = [Entry(1, "Brandlow Lodge", "Lodge")]
    assert Businesses(shop).resolve("xyzpay Brandlow Lodge") is None
    assert Businesses(shop, usual=Conventions(payment_marks=frozenset(("xyzpay",)))).resolve("xyzpay Brandlow Lodge").ref_id == 1
