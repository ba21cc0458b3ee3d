import pytest

from ledgerloom.llm import leaks, mixture, pieces, tokens


def test_leaks_against_brute_force(spark):
    item = "One two three four five six seven eight nine ten eleven, twelve!"
    items = spark.createDataFrame([(1, item), (2, "short item"), (3, None), (4, "a b c d e f g h i j")], "item_id long, text string")
    docs = [
        (1, "xx ONE--two three four\nfive six seven eight nine ten yy"), (2, "one two three four five six seven eight nine"), (3, None), (4, ""), (5, item), (5, item),
        (6, "w " * 50_000 + item), (7, "A b c d e f g h i j k a b c d e f g h i j"), (8, "one two three four five SIX seven ate nine ten eleven twelve"),
    ]
    df = spark.createDataFrame([(d, t, "q") for d, t in docs], "doc_id long, text string, item_id string")
    got = sorted((r.doc_id, r.item_id, r.longest) for r in leaks.leaks(df, items).collect())
    assert got == [(1, 1, 10), (5, 1, 12), (5, 1, 12), (6, 1, 12), (7, 4, 10)]
    clean = {r.doc_id: r.text for r in leaks.cleaned(df, items).collect()}
    assert clean[1] == "xx  yy" and clean[7] == " k " and clean[3] is None and clean[2] == docs[1][1] and clean[5] == "!"
    assert leaks.leaks(df.limit(0), items).count() == 0 and leaks.leaks(df, items.limit(0)).count() == 0


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    """Two texts under one id, overlapping passages of several items, and items that share a passage."""
    ws = [f"w{i}" for i in range(30)]
    texts = [(1, " ".join(ws[:12])), (2, " ".join(ws[4:16])), (3, " ".join(ws[8:20])), (1, " ".join(ws[18:30])), (4, " ".join(ws[:11]))]
    items = spark.createDataFrame(texts, "item_id long, text string")
    docs = spark.createDataFrame([(7, "a " + " ".join(ws[:20]) + " b"), (8, " ".join(ws)), (9, "nothing"), (10, None), (11, " ".join(ws[18:30]) + " x " + " ".join(ws[:12]))], "doc_id long, text string")

    def all_of():
        found = sorted(map(tuple, leaks.leaks(docs, items).collect()))
        return found, sorted(map(tuple, leaks.leaked_items(docs, items).collect())), sorted(map(tuple, leaks.cleaned(docs, items).collect()))

    one = all_of()
    assert dict((r[0], r[1]) for r in one[2]) == {7: "a  b", 8: "", 9: "nothing", 10: None, 11: " x "}
    assert (7, 1, 1, 12, 0) in [(d, i, n, k, f - 1) for d, i, n, k, f in one[0]] and (11, 1, 2, 12, 0) in one[0]
    monkeypatch.setattr(leaks, "BLOCK_ITEMS", 1)
    assert leaks._blocks(items, "item_id", "text")[0] == 5 and all_of() == one


def test_mixture(spark):
    rows = [(i, "big", "some words of text " * 5) for i in range(400)] + [(1000 + i, "small", "few words here") for i in range(40)] + [(5000, "big", None), (5001, "small", ""), (5002, "other", "text"), (5003, None, "text")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.4, 3), ("absent", 0.1, 5)], "source string, target_share double, max_repeats long")
    out = mixture.mix(docs, targets).collect()
    assert {r.source for r in out} == {"big", "small"}
    assert max(r.copy_no for r in out if r.source == "small") <= 3 and all(r.text for r in out)
    share = {r.source: r for r in mixture.shares(docs, targets).collect()}
    assert share["small"].share == pytest.approx(4 / 9, abs=0.01) and share["small"].max_copies == 3 and share["absent"].tokens is None
    assert sum(r.n_emitted or 0 for r in share.values()) == len(out)
    assert mixture.mix(docs.limit(0), targets).count() == 0 and mixture.mix(docs, targets.limit(0)).count() == 0
    assert mixture.repetition_rates({"a": 100, "b": 50}, {"a": (0.5, 9), "b": (0.5, 1)}, total=120) == {"a": 0.6, "b": 1.0}
    miss = lambda n: sum(abs(r.share - t) for r, t in ((r, {"big": 5 / 9, "small": 4 / 9}[r.source]) for r in mixture.shares(docs, targets, draws=n).collect() if r.share))
    assert miss(16) <= miss(1)
    wanted = {r.source: r for r in mixture.shares(docs, targets, total=900).collect()}
    assert wanted["big"].mixed_tokens + wanted["small"].mixed_tokens == pytest.approx(900, rel=0.1)
    assert mixture.repetition_rates({"a": 100, "b": 50}, {"a": (0.5, 1), "b": (0.5, 1)}) == {"a": 0.5, "b": 1.0}


TEXTS = ["Short one.", "", "A sentence here, with clauses; and more. " * 60, "\n\n".join("Paragraph words and words." * 9 for _ in range(12)), "x" * 5000, "日本語の文章です。" * 200, "line of words\n" * 150, "é" * 900 + " 🙂" * 300]


def test_pieces_round_trip(spark):
    encoding = tokens.encoder(tokens.DEFAULT_VOCABULARY)
    for text in TEXTS:
        total, parts = pieces.split_text(text, encoding, 200, 20)
        assert "".join(text[o:e] for _, o, e, _ in parts) == text
        assert all(n <= 200 for *_, n in parts) and (len(parts) == 1) == (total <= 200)
        for (_, _, e, _), (s, o, _, _) in zip(parts, parts[1:]):
            assert e == o and 14 <= len(encoding.encode_ordinary(text[s:o])) <= 26
    total, parts = pieces.split_text(TEXTS[3], encoding, 200, 20)
    assert all(TEXTS[3][o:e].strip().endswith(".") for _, o, e, _ in parts)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(99, None, 1)], "doc_id long, text string, n_tokens int")
    want = {i for i, t in enumerate(TEXTS) if len(encoding.encode_ordinary(t)) > 200}
    assert {r.doc_id for r in pieces.oversized(df, limit=200, overlap=20).collect()} == want
    every = pieces.pieces(df, limit=200, overlap=20, whole=True).collect()
    assert {r.doc_id for r in every} == {i for i, t in enumerate(TEXTS) if t} and all(r.piece == TEXTS[r.doc_id] for r in every if r.n_pieces == 1)
    assert {r.doc_id for r in every if r.n_pieces > 1} == want
    assert pieces.pieces(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pieces.pieces(df, limit=100, overlap=50)
