import random

from pyspark.sql import functions as F

from ledgerloom.llm import collapse, splits


def _sets(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    by = {}
    for r, m in pairs:
        if r is not None and m is not None:
            by.setdefault(r, set()).add(m)
    for members in by.values():
        for m in members:
            a, b = root(m), root(min(members))
            if a != b:
                up[max(a, b)] = min(a, b)
    return {(root(x), x) for x in up if root(x) != x}


def test_components_against_union_find(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randrange(60), f"m{rnd.randrange(90):03d}") for _ in range(120)] + [(900 + i, f"c{j:02d}") for i in range(20) for j in (i, i + 1)] + [(1, None), (None, "m001"), (1, None)]
    df = spark.createDataFrame(pairs, "transaction_id int, unique_mem_id string")
    got = {tuple(r) for r in splits.tied_members(df).collect()}
    assert got == _sets(pairs)
    assert splits.tied_members(df.limit(0)).count() == 0


def test_splits_hold_sets_together_and_reach_proportions(spark):
    rnd = random.Random(6)
    rows = [(i, f"m{rnd.randrange(300):03d}") for i in range(3000)] + [(i, f"m{rnd.randrange(300):03d}") for i in range(40)] + [(9000 + i, None) for i in range(50)]
    df = spark.createDataFrame(rows, "transaction_id int, unique_mem_id string")
    table, assigned = splits.assign_splits(df)
    of = {r.transaction_id: r.split for r in assigned.collect()}
    assert set(of) == {r for r, _ in rows}
    by_member = {}
    for r, m in rows:
        if m:
            by_member.setdefault(m, set()).add(of[r])
    assert all(len(s) == 1 for s in by_member.values())
    share = {r.split: r.share for r in splits.split_shares(df, assigned).collect()}
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["test"] - 0.1) < 0.03


def test_known_components_keep_their_split_and_conflicts_are_set_apart(spark):
    known = spark.createDataFrame([("a", "a", "train", "new"), ("b", "b", "test", "new"), ("c", "c", "test", "new"), ("d", "d", "test", "new")], "node string, root string, split string, state string")
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d"), (3, "c"), (3, "e"), (4, "f"), (5, None)], "transaction_id int, unique_mem_id string")
    table, assigned = splits.assign_splits(df, known=known)
    got = {r.node: (r.root, r.split, r.state) for r in table.collect()}
    assert got["a"] == got["b"] == ("a", "quarantine", "quarantined")
    assert got["c"] == got["d"] == got["e"] == ("c", "test", "kept")
    assert got["f"][2] == "new"
    assert {r.transaction_id for r in assigned.collect()} == {1, 2, 3, 4, 5}


def test_copies(spark):
    rows = [
        (3, "m", 1.0, "d", "debit", "Pos Buy-X~~Ref 9", "a"), (1, "m", 1.0, "d", "debit", "ref9 | posbuy x", "b"), (2, "m", 1.0, "d", "debit", "~~POS BUY X;;REF 9", "c"), (2, "m", 1.0, "d", "debit", "pos buy x;ref 9", "c"),
        (4, "m", 1.0, "d", "debit", "pos buy xr;ef 9", "d"), (5, None, 1.0, "d", "debit", "pos buy x;ref 9", "e"), (6, "m", 2.0, "d", "debit", "pos buy x;ref 9", "f"),
        (7, "m", 1.0, None, "debit", "~~--", "g"), (8, "m", 1.0, None, "debit", "", "h"), (9, "m", 1.0, None, "debit", None, "i"),
        (10, "n", 0.0, "d", None, "ab " * 30_000, "j"), (11, "n", -0.0, "d", None, "AB" * 30_000, "k"),
    ]
    df = spark.createDataFrame(rows, "transaction_id long, unique_mem_id string, amount double, transaction_date string, ledger_entry string, description_unmasked string, n_rows string")
    assert {tuple(r) for r in collapse.copy_pairs(df).collect()} == {(1, 2), (1, 3), (10, 11)}
    assert {tuple(r) for r in collapse.collapsed(df).collect()} == {(1, 3, 4), (10, 2, 2), *((i, 1, 1) for i in range(4, 10))}
    assert collapse.copy_pairs(df.limit(0)).count() == 0


def test_rows_delivered_again_are_collapsed(spark):
    """Copies under one id count too, and the pairs of ids stay as they are."""
    same = ("m", 1.0, "d", "debit", "pos buy x;ref 9")
    rows = [(1, *same), (1, *same), (2, "m", 2.0, "d", "debit", "other"), (3, "m", 3.0, "d", "debit", "a b|c"), (3, "m", 3.0, "d", "debit", "C;ab"), (4, "m", 3.0, "d", "debit", "ab~~c"), (5, None, 1.0, "d", "debit", "x"), (5, None, 1.0, "d", "debit", "x")]
    rows += [(6, "m", 6.0, "d", "debit", "y"), (6, "m", 6.0, "d", "debit", "y"), (6, "n", 6.0, "d", "debit", "y"), (6, "n", 6.0, "d", "debit", "y"), (7, "m", 6.0, "e", "debit", "y"), (7, "n", 6.0, "e", "debit", "y")]
    df = spark.createDataFrame(rows, "transaction_id long, unique_mem_id string, amount double, transaction_date string, ledger_entry string, description_unmasked string")
    assert {tuple(r) for r in collapse.collapsed(df).collect()} == {(1, 1, 2), (2, 1, 1), (3, 2, 3), (5, 2, 2), (6, 2, 4), (7, 2, 2)}
    assert {tuple(r) for r in collapse.copy_pairs(df).collect()} == {(3, 4)}
    assert collapse.collapsed(df.limit(0)).count() == 0


def test_a_persisted_table_is_taken_up_again(spark, tmp_path):
    first = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "transaction_id int, unique_mem_id string")
    path = splits.save_table(splits.assign_splits(first)[0], str(tmp_path))
    known = splits.load_table(spark, path)
    before = {r.node: r.split for r in known.collect()}
    later = spark.createDataFrame([(4, "b"), (4, "e"), (5, "f"), (6, None)], "transaction_id int, unique_mem_id string")
    table, assigned = splits.assign_splits(later, known=known)
    again = splits.load_table(spark, splits.save_table(table, str(tmp_path)))
    after = {r.node: (r.root, r.split, r.state) for r in again.collect()}
    assert all(after[n][1:] == (before[n], "kept") for n in before) and after["e"] == ("a", before["a"], "kept") and after["f"][2] == "new"
    assert {r.transaction_id for r in assigned.collect()} == {4, 5, 6}
    assert tuple(splits.violations(later, assigned).first()) == (3, 0, 0, 0)
    torn = assigned.withColumn("split", F.when(F.col("transaction_id") == 4, "x").otherwise("y")).unionByName(assigned.limit(1))
    assert splits.violations(later.union(spark.createDataFrame([(5, "b")], later.schema)), torn).first().n_members_apart >= 1
    assert splits.merge_conflicts(again).count() == 0


def test_a_member_of_very_many_records(spark, monkeypatch):
    monkeypatch.setattr(splits, "PART_ROWS", 7)
    rows = [(i, "hot") for i in range(50)] + [(i, f"m{i}") for i in range(40, 60)] + [(100 + i, None) for i in range(30)]
    df = spark.createDataFrame(rows, "transaction_id int, unique_mem_id string")
    assigned = splits.assign_splits(df)[1]
    assert assigned.count() == 90 and tuple(splits.violations(df, assigned).first()) == (90, 0, 0, 0)
