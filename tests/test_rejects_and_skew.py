import datetime
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.operators import rejects, skew

ID = "0123abcd-0123-4567-89ab-0123456789ab"


def brute(line):
    fields, i = [], 0
    line = line or ""
    while True:
        if line[i : i + 1] == '"':
            j, buf = i + 1, ""
            while True:
                if j >= len(line):
                    return "quoting"
                if line[j] == '"':
                    if line[j + 1 : j + 2] == '"':
                        buf, j = buf + '"', j + 2
                        continue
                    break
                buf, j = buf + line[j], j + 1
            j += 1
            if j < len(line) and line[j] != "|":
                return "quoting"
            fields.append(buf)
        else:
            j = line.find("|", i)
            j = len(line) if j < 0 else j
            if '"' in line[i:j]:
                return "quoting"
            fields.append(line[i:j])
        if j >= len(line):
            break
        i = j + 1
    if len(fields) != 7:
        return "column_count"
    a, b, c, d, e, f, g = fields
    try:
        datetime.date.fromisoformat(d)
        day = bool(re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", d))
    except ValueError:
        day = False
    good = re.fullmatch("[0-9]+", a) and re.fullmatch("[0-9]*", b) and re.fullmatch(r"-?[0-9]+(\.[0-9]{1,2})?", c) and day and e in ("credit", "debit")
    good = good and f.strip() and not re.search("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f�]", f) and re.fullmatch(r"(NULL|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})?", g)
    return None if good else "value"


LINES = [
    f"1|2|3.50|2020-02-29|debit|coffee|{ID}", f'"1"|"2"|"3"|"2020-01-01"|"credit"|"a ""b"" | c\nd"|"{ID}"', "1||-3|2020-01-01|debit|x|NULL", "1||3|2020-01-01|debit|x|",
    "1|2|3|2019-02-29|debit|x|", "1|2|3|2020-01-01|Debit|x|", "1|2|3.|2020-01-01|debit|x|", "1|2|3.123|2020-01-01|debit|x|", "1|2|3|2020-01-01|debit|  |", "1|2|3|2020-01-01|debit|a\x01|", "1|2|3|2020-01-01|debit|a\tb|",
    f"1|2|3|2020-01-01|debit|x|{ID.upper()}", "x|2|3|2020-01-01|debit|x|", "١|2|3|2020-01-01|debit|x|", "1|2|3|2020-01-01\n|debit|x|", "1|2|3", "", None, '1|2|3|2020-01-01|debit|"x|', '1|2|3|2020-01-01|debit|"x"y|', '1|2|3|2020-01-01|debit|x"y|', '1|2|3|2020-01-01|debit|x||',
    '"', '""', '"""', '""""', "\\p|\\s|\\", "1|2|3|2020-01-01|debit|\\p\\s|", "99999999999999999999|2|3|2020-01-01|debit|" + "long " * 20_000 + "|", '1|2|3|2020-01-01|debit|"' + '""' * 5_000 + '"|',
]


def test_rejects_against_brute_force(spark):
    rows = [(i, x, "clash", "clash") for i, x in enumerate(LINES)]
    df = spark.createDataFrame(rows, "line_id long, raw_line string, reason string, _cells string")
    got = {r.line_id: r.reason for r in rejects.rejected(df, "line_id").collect()}
    want = {i: brute(x) for i, x in enumerate(LINES) if brute(x)}
    assert got == want
    clean = {r.line_id: r for r in rejects.accepted(df, "line_id").collect()}
    assert set(clean) == set(range(len(LINES))) - set(want)
    assert clean[1].description_unmasked == 'a "b" | c\nd' and clean[0].transaction_date == datetime.date(2020, 2, 29) and clean[27].description_unmasked == "\\p\\s" and clean[28].transaction_id is None
    assert rejects.rejected(df.limit(0), "line_id").count() == 0
    twice = df.unionAll(df).filter("line_id = 4")
    assert rejects.rejected(twice, "line_id").count() == 1


def test_rejects_random(spark):
    seen = []

    @settings(max_examples=400, database=None, deadline=None)
    @given(st.text(alphabet='a"|\\ps1\n', max_size=14))
    def gather(x):
        seen.append(x)

    gather()
    df = spark.createDataFrame(list(enumerate(seen)), "line_id long, raw_line string")
    got = {r.line_id: r.reason for r in rejects.rejected(df, "line_id").collect()}
    assert got == {i: brute(x) for i, x in enumerate(seen) if brute(x)}


@pytest.mark.parametrize("partitions", [2, 7])
def test_per_key_against_brute_force(spark, partitions):
    rnd = random.Random(4)
    day = datetime.date(2020, 1, 1)
    rows = [(i, rnd.choice(["hot"] * 12 + ["a", "b", "", None, " ", "z" * 3000]), day + datetime.timedelta(days=rnd.randrange(400)) if rnd.random() > 0.02 else None, float(rnd.randrange(100)) if rnd.random() > 0.05 else None) for i in range(3000)]
    rows += rows[:50]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, name string, at date, amount double, pid int").repartition(5)
    got = {r.name: r for r in skew.per_key(df, "name", "at", "amount", ["id"], partitions).collect()}
    for name in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == name]
        days = sorted(r[2] for r in mine if r[2])
        gaps = [(b - a).days for a, b in zip(days, days[1:])]
        g = got[name]
        assert g.n == len(mine) and g.total == sum(r[3] or 0 for r in mine) and g.longest_gap_days == (max(gaps) if gaps else None)
        assert g.first_at.date() == days[0] and g.last_at.date() == days[-1]
    assert got["hot"].pieces > 1 and len(got) == len({r[1] for r in rows})


def test_heavy_keys(spark):
    df = spark.createDataFrame([("x", 1)] * 3 + [("y", 1)] * 2 + [("", 1)] * 40 + [(None, 1)] * 55, "name string, amount int").withColumn("at", F.lit("2020-01-01").cast("date"))
    assert {r.name for r in skew.heavy_keys(df, "name", "at", "amount", []).collect()} == {"x"}
    assert skew.heavy_keys(df.limit(0), "name", "at", "amount", []).count() == 0


def test_records_without_a_key_and_with_repeated_keys(spark):
    good = "1|2|3.50|2024-02-29|debit|shop|NULL"
    df = spark.createDataFrame([(None, "garbage"), (None, good), (7, good), (7, "x|2|3.50|2024-02-29|debit|shop|NULL"), (7, good), (8, None)], "line_id long, raw_line string")
    clean, bad = rejects.split_feed(df, "line_id")
    assert sorted(str(r.line_id) for r in clean.collect()) == ["7", "7", "None"]
    assert sorted((str(r.line_id), r.reason, r.bad_columns) for r in bad.collect()) == [("7", "value", "transaction_id"), ("8", "column_count", ""), ("None", "column_count", "")]
    assert rejects.accepted(df.limit(0), "line_id").count() == 0
    assert {(r.line_id, r.reason) for r in rejects.rejected(df, "line_id").collect()} == {(None, "column_count"), (7, "value"), (8, "column_count")}
