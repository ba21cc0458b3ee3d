import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import arrays as ar
from ledgerloom.functions import geo
from ledgerloom.functions import text as tx


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "f, given, want",
    [
        (tx.clean_query, "Weekend at Bernie's[]{}/:", "weekend at bernie s"), (tx.clean_query, 'a""b', "a b"), (tx.clean_query, "", ""), (tx.clean_query, None, None),
        (tx.clean_panel, "ab'cd", "ab cd"), (tx.clean_panel, "ab*<cd", "ab cd"),
        (tx.strip_noise, "ach pos ", ""), (tx.strip_noise, "pos 12/34abcd", "ABCD"), (tx.strip_noise, "ab~~12345~~1234567890123456~~12345~~1~~~~1234cd", "AB CD"),
        (tx.replace_synonyms, "qt", " QUICKTRIP "), (tx.replace_synonyms, "wal-mart", " WALMART "), (tx.replace_synonyms, "macy's east", " MACY'S "), (tx.replace_synonyms, "exxonmobil", " EXXONMOBIL EXXON MOBIL "),
        (tx.replace_synonyms, "uspsamsclub", " US POST OFFICE AMSCLUB"), (tx.replace_synonyms, "loweshell oil x", " LOWE'S HELL OIL X"),
        (tx.capitalise_label, "ab cd", "Ab Cd"), (tx.capitalise_label, "ab in cd", "Ab in Cd"), (tx.capitalise_label, "aB Cd", "AB Cd"),
        (tx.capwords_if_upper, "JOE'S DINER", "Joe's Diner"), (tx.capwords_if_upper, "Joe's DINER", "Joe's DINER"),
        (tx.bare_upper, "a b-c, d!", "ABCD"), (tx.container_of, "x/BANK_1.csv", "bank"), (tx.container_of, "my Card", "card"),
        (tx.accuracy_literal, "0.966", 0.966), (tx.accuracy_literal, "", 0.0), (tx.accuracy_literal, "1", 0.0),
        (tx.city_long_form, "W FT WORTH", "West Fort Worth"), (tx.coordinate, "1.5", "1.500000"), (tx.coordinate, None, None),
    ],
)
def test_text(spark, f, given, want):
    assert value(spark, f(F.lit(given).cast("string"))) == want


def test_text_lists(spark):
    assert value(spark, tx.token_starts(F.lit("ab's c-d"))) == [0, 3, 4, 5]
    assert sorted(value(spark, tx.city_short_forms(F.lit("West Fort Worth")))) == ["WESTFORTWORTH", "WESTFTWORTH", "WFORTWORTH", "WFTWORTH"]
    kind, sub = tx.split_label(F.lit("joseph - rules"), F.lit("credit"), F.lit("bank"))
    assert (value(spark, kind), value(spark, sub)) == ("joseph", "rules")
    kind, sub = tx.split_label(F.lit("other"), F.lit("credit"), F.lit("card"))
    assert (value(spark, kind), value(spark, sub)) == ("Bank Adjustment", "Adjustment")


def brute_tags(text, tagged, most=35):
    wanted = [w for w in tagged.lower().replace(",", " ").split() if w != "null"]
    out = []
    for token in text.lower().split()[:most]:
        hit = bool(wanted) and wanted[0] in token
        out.append((token, "merchant" if hit else "background"))
        wanted = wanted[1:] if hit else wanted
    return out


@pytest.mark.parametrize("text, tagged", [("pos joe's diner 12", "joe's diner"), ("a b c", ""), ("a b c", "Null"), ("Foo bar foo", "foo,foo"), ("123 4 5123", "123, 512"), ("x " * 50 + "joe", "joe"), ("", "joe")])
def test_tags(spark, text, tagged):
    got = value(spark, tx.merchant_tags(F.lit(text), F.lit(tagged)))
    assert [(t.token, t.tag) for t in got] == brute_tags(text, tagged)
    assert value(spark, tx.merchant_of_tags(tx.merchant_tags(F.lit(text), F.lit(tagged)))) == " ".join(t for t, g in brute_tags(text, tagged) if g == "merchant")


def test_arrays(spark):
    vec = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert [round(x, 2) for x in value(spark, ar.softmax(vec(0.1, 0.2, 0.7), 2))] == [0.29, 0.31, 0.40]
    assert [round(x, 2) for x in value(spark, ar.clipped_log(vec(0.29, 0.31, 0.4)))] == [-1.24, -1.17, -0.92]
    assert round(value(spark, ar.clipped_log(vec(-1)))[0], 2) == -23.03
    assert value(spark, ar.first_argmax(vec(1, 3, 3))) == 2
    assert value(spark, ar.one_hot(F.lit(2), 3)) == [0, 1, 0]
    assert value(spark, ar.char_one_hot(F.lit("abc"), "abc", 3)) == [[0, 0, 1], [0, 1, 0], [1, 0, 0]]
    assert value(spark, ar.char_one_hot(F.lit("a"), "abc", 3)) == [[1, 0, 0], [0, 0, 0], [0, 0, 0]]
    assert value(spark, ar.char_one_hot(F.lit("ABCdef"), "abc", 3)) == value(spark, ar.char_one_hot(F.lit("abc"), "abc", 3))
    assert value(spark, ar.char_indices(F.lit("a?b"), "abc", 3)) == [2, 0, 1]
    assert value(spark, ar.category_list(F.lit('[["b","a"],["c","a"]]'))) == ["a", "b", "c"]
    assert value(spark, ar.category_list(F.lit("  "))) == [] and value(spark, ar.category_list(F.lit('["x"]'))) == ["x"]
    assert value(spark, ar.mean_vectors([vec(1, 2), vec(3, 6)])) == [2.0, 4.0]
    assert value(spark, ar.label_or_default(F.lit(5), F.lit(-3.0), F.lit(0.2))) == 1
    assert value(spark, ar.label_or_default(F.lit(5), F.lit(-3.0), F.lit(None).cast("double"))) == 5


def test_geo(spark):
    square, hole = [(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)]
    inside = lambda x, y: value(spark, geo.in_polygon(F.lit(float(x)), F.lit(float(y)), [square, hole]))
    assert inside(1, 1) and inside(9, 5) and not inside(5, 5) and not inside(11, 5)
    assert value(spark, geo.in_multipolygon(F.lit(21.0), F.lit(1.0), [[square], [[(20, 0), (25, 0), (22, 9)]]]))


def test_char_onehot_reads_whole_descriptions(spark, sf, tmp_path):
    from ledgerloom.plans import q_arrays

    def indices(text):
        return None if text is None else ",".join(str(q_arrays.ALPHABET.find(c) + 1) for c in reversed(text.lower()[:123]))

    rows = spark.read.parquet(f"{sf}/labeled_transactions.parquet").select("transaction_id", "description_unmasked").collect()
    key = lambda r: (r[0], r[1] or "", r[1] is None)
    got = q_arrays.char_onehot(spark, sf).collect()
    assert any(len(t or "") > 12 for _, t in rows) and sorted(map(tuple, got), key=key) == sorted(((i, indices(t)) for i, t in rows), key=key)
    long = [(1, "Ab-9 é" * 40), (2, ""), (3, None)]
    spark.createDataFrame(long, "transaction_id long, description_unmasked string").write.parquet(f"{tmp_path}/labeled_transactions.parquet")
    got = {r.transaction_id: r.indices for r in q_arrays.char_onehot(spark, str(tmp_path)).collect()}
    assert got == {i: indices(t) for i, t in long} and got[1].count(",") == 122
