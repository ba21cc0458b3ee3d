import itertools

import numpy as np
import pytest

from ledgerloom.llm.addresses import address_classes, same_address_pairs
from ledgerloom.llm.canonical import Entry, Towns
from ledgerloom.llm.linkage import LabelModel, link
from ledgerloom.llm.names import compare
from ledgerloom.llm.places import read_place, same_location

CITIES = [(1, "Port Halvern", "OR"), (2, "Marsk Falls", "TX"), (3, "Tellby", "OR"), (4, "Tellby", "ME")]
TOWNS = Towns([Entry(*c) for c in CITIES])


@pytest.mark.parametrize(
    "a, b, want",
    [
        (("12 North Gallow Street", "Port Halvern", "OR", "97001"), ("12 N. GALLOW ST", "Pt Halvern", None, "97001-1234"), True),
        (("12 Gallow St., Ste 4", "Port Halvern", "OR", None), ("#4 12 gallow str (Elm Plaza)", "port halvren", "or", None), True),
        (("Gallow Ave 12", "Port Halvern", "OR", ""), ("12 Galow Avenue, Port Halvern OR 97001", None, None, None), True),
        (("12 Gallow No.", "Port Halvern", "OR", ""), ("No. 12 North Gallow", "Port Halvern", "OR", ""), True),
        (("12 N Gallow St", "Port Halvern", "OR", ""), ("12 S Gallow St", "Port Halvern", "OR", ""), False),
        (("12 Gallow St", "Port Halvern", "OR", ""), ("12 Gallow Rd", "Port Halvern", "OR", ""), False),
        (("12 Gallow St Ste 4", "Port Halvern", "OR", ""), ("12 Gallow St Unit 5", "Port Halvern", "OR", ""), False),
        (("12 Gallow St", "Port Halvern", "OR", ""), ("13 Gallow St", "Port Halvern", "OR", ""), False),
        (("12 Gallow St", "Tellby", "OR", ""), ("12 Gallow St", "Tellby", "ME", ""), False),
        (("12 Gallow St", "Port Halvern", "OR", ""), ("12 Brunswick St", "Port Halvern", "OR", ""), False),
        (("12 Gallow North Port Halvern OR 97001", None, "OR", None), ("12 N Gallow St", "P0rt Halvern OR, OR", "OR", ""), True),
        (("", "Port Halvern", "OR", ""), ("", "Port Halvern", "OR", ""), False),
    ],
)
def test_same_location(a, b, want):
    assert same_location(read_place(*a, TOWNS), read_place(*b, TOWNS)) is want


ROWS = [
    (1, "12 North Gallow Street", "Port Halvern", "OR", "97001", "Brandlow Lodge"), (2, "12 N. GALLOW ST", None, None, "97001", "brandlow ldg"), (3, "12 Gallow Street", "Pt. Halvern", "OR", "97001", "Kestrel Diner"),
    (4, "12 S Gallow St", "Port Halvern", "OR", "97001", "Brandlow Lodge"), (5, None, None, None, None, None), (6, "", "", "", "", ""), (7, "x " * 3000, "Tellby", "OR", "97002", "Long"), (8, "12 Gallow St", "Tellby", "OR", "97002", "Brandlow Lodge"),
    (1, "12 North Gallow Street", "Port Halvern", "OR", "97001", "Brandlow Lodge"),
]


def _tables(spark):
    stores = spark.createDataFrame([(*r, "clash") for r in ROWS], "store_row long, address string, city string, state string, zip_code string, keywords string, town string")
    return stores, spark.createDataFrame(CITIES, "city_id long, canonical_city string, state string")


def test_pairs(spark):
    stores, cities = _tables(spark)
    got = {tuple(r) for r in same_address_pairs(stores, cities).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (3, 4)}
    classes = {r.store_row: (r.n_copies, r.n_links) for r in address_classes(stores, cities).collect()}
    assert classes[1] == (1, 2) and classes[3] == (1, 3) and 5 not in classes
    assert same_address_pairs(stores.limit(0), cities).count() == 0


def test_links(spark):
    stores, cities = _tables(spark)
    rows = [
        ("f1", "Brandlow Lodge", "12 No Gallow St", "Port Halvern", "OR", "97001", None, None, "2020-01-02"), ("f1", "Old Name", "99 Old Road", "Tellby", "OR", None, None, None, "2019-01-02"),
        ("f2", "Kestrel Dnr", "12 Gallow", "Port Halvern", "OR", None, "Kestrel Diner", "https://www.kestreldiner.example", "2020-01-02"), ("f3", "Vexhall Toys", "12 N Gallow St", "Port Halvern", "OR", "97001", None, None, None),
        (None, "Brandlow Lodge", "12 Gallow St", "Tellby", "OR", None, None, None, None), ("f4", None, None, None, None, None, None, None, None),
    ]
    merchants = spark.createDataFrame(rows, "factual_id string, place_name string, address string, locality string, region string, postcode string, chain_name string, website string, updated_at string")
    got = {r.store_row: r.factual_id for r in link(stores, merchants, cities).collect()}
    assert got == {1: "f1", 2: "f1", 3: "f2"}
    assert link(stores, merchants.limit(0), cities).count() == 0 and link(stores.limit(0), merchants, cities).count() == 0


def test_label_model_learns_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.3
    flip = lambda acc: np.where(rng.random(4000) < acc, truth, ~truth) * 2 - 1
    votes = np.column_stack([flip(0.95), flip(0.9), flip(0.85), flip(0.9) * (rng.random(4000) < 0.7), flip(0.55)]).astype(int)
    votes = np.column_stack([votes, votes[:, 4]])  # two functions that say the same
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = LabelModel().fit(patterns, counts)
    got = model.posterior(votes) > 0.5
    assert (got == truth).mean() > 0.95
    assert model.parent[5] == 4 or model.parent[4] == 5
    assert all(0 <= p <= 1 for p in model.posterior(np.array(list(itertools.product((-1, 0, 1), repeat=6)))))


def test_names():
    assert compare("Brandlow Lodge", "BRANDLOW LDG")[0] == 1 and compare("Brandlow Lodge", "brandlowlodge.example")[0] == 1
    assert compare("Brandlow Lodge", "Brandlow Daycare") == (1, -1) and compare("Brandlow Lodge", "Kestrel Diner")[0] == -1
    assert compare("Brandlow Hdwe", "Brandlow Hardwr", ("hardware",)) == (1, 1) and compare("", "x") == (0, 0)


def test_a_parted_possessive_is_no_word_of_the_name():
    from ledgerloom.llm.names import compare

    assert compare("Heanebith's Garden", "heanebith s gdn") == (1, 1)
    assert compare("Paizprid's Cinemas", "paizprid s") == (1, 0)
    assert compare("Mabouvib Market", "palfib s market")[1] == -1


def test_pairs_of_streets_with_two_typing_errors(spark):
    spelt = [("bicagi", "bucago"), ("nipeba", "nimeda"), ("rocade", "racada"), ("patoco", "paloko")]
    rows = [(10 * i + j, f"{i} {name} St", "Port Halvern", "OR", "97001") for i, pair in enumerate(spelt, 1) for j, name in enumerate(pair)]
    stores = spark.createDataFrame(rows, "store_row long, address string, city string, state string, zip_code string")
    got = {tuple(r) for r in same_address_pairs(stores, _tables(spark)[1]).collect()}
    assert got == {(10 * i, 10 * i + 1) for i in range(1, 5)}


def test_bands_lose_no_pair(spark, sf):
    """All pairs of one town and number, compared one by one, give the rows of the operator."""
    from ledgerloom.llm.addresses import _place, located_rows

    stores, cities = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("store_numbers", "city_ref"))
    groups: dict = {}
    for r in located_rows(stores, cities).collect():
        p = _place(r.loc)
        groups.setdefault((p.town, p.number), []).append((r._k, p))
    want = {(min(i, j), max(i, j)) for g in groups.values() for (i, p), (j, q) in itertools.combinations(g, 2) if same_location(p, q)}
    assert {tuple(r) for r in same_address_pairs(stores, cities).collect()} == want and len(want) > 100


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("12 Gallow Highway", "12 Gallow Hwy", True), ("12 N Gallow St", "12 Gallow Street North", True), ("12 Wind Stoot Rd", "12 Windstoot Road", True),
        ("12 Gallow Highway", "12 Gallow Parkway", False), ("12 Martin King St", "12 Martin Luther King St", False), ("12 Oak St", "12 Oar St", False),
    ],
)
def test_the_alignment_decides(a, b, want):
    read = lambda line: read_place(line, "Port Halvern", "OR", "", TOWNS)
    assert same_location(read(a), read(b)) is want


def test_only_the_dictionary_of_abbreviations_joins(monkeypatch):
    """Without the short forms in the cost of a substitution the pair costs too much."""
    from ledgerloom.llm import places

    a, b = (read_place(line, "Port Halvern", "OR", "", TOWNS) for line in ("12 North Gallow Parkway", "12 N Gallow Pky"))
    assert places.address_cost(a, b) == pytest.approx(2 * places.SHORT_FORM)
    monkeypatch.setattr(places, "SHORT_FORM", places.APART)
    places.swap.cache_clear()
    assert not same_location(a, b)
    monkeypatch.undo()
    places.swap.cache_clear()
    assert same_location(a, b)


def test_postcodes_tell_towns(spark):
    stores = spark.createDataFrame([(1, "12 Gallow St", None, "OR", "97001"), (2, "12 Gallow Street", "Port Halvern", "OR", None), (3, "9 Elm Rd", None, None, "97555"), (4, "9 ELM ROAD", None, None, "97555-0001")], "store_row long, address string, city string, state string, zip_code string")
    cities = _tables(spark)[1]
    assert {tuple(r) for r in same_address_pairs(stores, cities).collect()} == {(3, 4)}
    told = spark.createDataFrame([("Pt Halvern", "OR", "97001"), (None, None, None)], "locality string, region string, postcode string")
    assert {tuple(r) for r in same_address_pairs(stores, cities, further=told).collect()} == {(1, 2), (3, 4)}


def test_the_model_decides(spark, monkeypatch):
    """Without what the model learned other pairs come out: no rule stands beside it."""
    from ledgerloom.llm import linkage

    folder = "/root/testdata/sf0.01"
    stores, merchants, cities = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("store_numbers", "merchants", "city_ref"))
    links = lambda: {tuple(r)[:2] for r in linkage.link(stores, merchants, cities).collect()}
    with_model = links()
    monkeypatch.setattr(linkage.LabelModel, "posterior", lambda self, patterns: (patterns.mean(axis=1) > 0.2).astype(float))
    assert len(with_model) > 500 and links() != with_model


def test_records_of_one_number_are_compared_without_joins_of_bands(spark, monkeypatch):
    """Only towns and numbers of very many records are tables of bands; both ways give the same rows, also
    where only some are, and repeated store rows count once."""
    from pyspark.sql import functions as F

    from ledgerloom.llm import linkage

    folder = "/root/testdata/sf0.001"
    stores, merchants, cities = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("store_numbers", "merchants", "city_ref"))
    stores = stores.union(stores.limit(20)).withColumn("store_row", F.col("store_row") + (1 << 60))
    links = lambda: {tuple(r) for r in linkage.link(stores, merchants, cities).collect()}
    asked, by_bands = [], linkage.candidates
    monkeypatch.setattr(linkage, "candidates", lambda *sides: asked.append(1) or by_bands(*sides))
    together = links()
    assert len(together) > 30 and not asked and min(r[0] for r in together) > 1 << 60
    for most in (0, 1):
        monkeypatch.setattr(linkage, "BLOCK_PAIRS", most)
        assert links() == together and len(asked) == most + 1


def test_pairs_of_blocks_whole():
    from ledgerloom.llm import linkage

    rows = [(b, s) for b, (n, m) in enumerate([(2, 3), (0, 4), (3, 0), (1, 1), (40, 30)]) for s in [0] * n + [1] * m]
    blocks, side = (np.array(x) for x in zip(*rows))
    want = {(i, j) for i, (b, s) in enumerate(rows) for j, (c, t) in enumerate(rows) if b == c and s < t}
    got = [(int(i), int(j)) for x, y in linkage._pairs(blocks, side) for i, j in zip(x, y)]
    assert set(got) == want and len(got) == len(want)
    frame = linkage.pd.DataFrame({"block": blocks, "n": range(len(blocks))})
    for size in (1, 3, 50):
        whole = list(linkage._whole_blocks(iter([frame.iloc[k : k + size] for k in range(0, len(frame), size)])))
        assert [n for f in whole for n in f["n"]] == list(range(len(rows)))
        assert all(not set(f["block"]) & set(g["block"]) for f, g in itertools.combinations(whole, 2))


def test_votes_of_many_pairs_are_those_of_each(spark):
    from ledgerloom.llm import linkage, places
    from ledgerloom.llm.addresses import _place, located_rows

    stores, cities = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("store_numbers", "city_ref"))
    told = [(r.loc, _place(r.loc)) for r in located_rows(stores, cities).limit(60).collect()]
    told += [(f"t:1|5|{d}|{s}|{k}|{u}", _place(f"t:1|5|{d}|{s}|{k}|{u}")) for d, s, k, u in (("n", "wind stoot", "rd", ""), ("north", "windstoot", "road", "4"), ("s", "windstoot", "rd", ""), ("", "windstott", "ave", "5"), ("", "martin luther king", "", ""), ("", "martin king", "", "5"))]
    frame = linkage.pd.DataFrame({"loc": [x for x, _ in told], "name": "a", "zip5": "", "chain": "", "site": "", "category": ""})
    i, j = (x.ravel() for x in np.meshgrid(range(len(told)), range(len(told))))
    got = linkage.Records(frame).votes(i, j, ())
    for a, b, votes in zip(i, j, got.tolist()):
        p, q = told[a][1], told[b][1]
        part = lambda role: 0 if not getattr(p, role) or not getattr(q, role) else 1 if places.swap(role, getattr(p, role), getattr(q, role)) < places.APART else -1  # noqa: E731, B023
        street = places.swap("street", p.street.replace(" ", ""), q.street.replace(" ", ""))
        assert votes[7:12] == [1 if places.address_cost(p, q) <= places.SAME else -1, 1 if street == 0 else 0 if street <= places.SAME else -1, part("direction"), part("kind"), part("unit")]
    assert (linkage.decoded(linkage.encoded(got)) == got).all()


def test_distances_of_many_pairs_are_those_of_each():
    from ledgerloom.llm.textkit import bags, distance, distances

    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("aeo0l1is5bé"), size=n)) for n in rng.integers(0, 9, 400)]
    pairs = list(zip(texts, texts[1:] + texts[:1])) + [(t, t[1:2] + t[:1] + t[2:]) for t in texts]
    full, bag = distances(pairs), bags([t for p in pairs for t in p])
    more = bag[::2] - bag[1::2]
    assert (np.maximum(more, 0).sum(axis=1) * 0.6 <= full + 1e-9).all()
    for most in (0.8, 2.0, 2.9, 99.0):
        near = [distance(a, b, most) for a, b in pairs]
        assert all(f == n if min(f, n) <= most else n > most for f, n in zip(full.tolist(), near))
