"""Train, validation and test splits that keep related records together (problem 2).

Members tied by a shared transaction form components. Components are kept in a persisted table
(member, component, split, state); a new delivery adds its ties to those of the table. Merging works on
the roots only: every root hooks onto the smallest root that it is tied to, and pointer jumping
flattens the chains that arise, until no tie joins two roots. Components that the table already
knows keep their split; new ones fill the deficits of the splits; a merge of components that were
given different splits is set apart as quarantined, as no split would be free of leakage.

The table is written by save_table() and read by load_table(); it lies in the shared folder or wherever
the caller keeps it, and is handed to the next call as `known`.

Every round works on distinct ties between roots, of which there are fewer each time, and is cut by a
reliable checkpoint. Nothing that grows with the records is gathered on the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import bounded_rows, cut, shared_folder

#: Components smaller than 1/HEAVY of all rows are dealt out in buckets by hash, heavier ones singly.
HEAVY = 1_000
BUCKETS = 4_096
QUARANTINED = "quarantine"
PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Rows of one member above which their join with the members' table is spread over parts.
PART_ROWS = 1_000_000


def save_table(table: DataFrame, folder: str | None = None) -> str:
    """Writes a component table and returns where. Each call writes a new version beside the others, so that
    a table may be saved that was made from an earlier version; a version is complete or not listed."""
    path = f"{folder or shared_folder(table.sparkSession) + '/components'}/{uuid.uuid4().hex}"
    table.select("node", "root", "split", "state").write.parquet(path)
    return path


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """(node, root, split, state) as it was saved."""
    return spark.read.schema("node string, root string, split string, state string").parquet(path)


def ties(rows: DataFrame, record: str, member: str) -> DataFrame:
    """Distinct (a, b), a > b: each member of a record beside the smallest member of that record.
    Rows without record or member tie nothing. A record of n members gives n - 1 ties, never all
    pairs, and records of one member are dropped before the join."""
    pairs = rows.select(F.col(record).alias("r"), F.col(member).cast("string").alias("a")).filter(F.col("r").isNotNull() & F.col("a").isNotNull())
    least = pairs.groupBy("r").agg(F.min("a").alias("b"), F.max("a").alias("z")).filter("b < z").select("r", "b")
    return pairs.join(least, "r").filter("a > b").select("a", "b").distinct()


def jump(hooks: DataFrame) -> DataFrame:
    """Pointer jumping over (node, up) until every node points at a root. Nodes absent from the table
    are roots. up < node always, so that there are no cycles and the depth halves each time. Only
    nodes that still move are joined again."""
    done, moving = None, hooks
    while True:
        above = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
        stepped = cut(moving.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
        still = stepped.filter(~F.col("moved")).select("node", "up")
        done = still if done is None else done.unionByName(still)
        moving = stepped.filter("moved").select("node", "up")
        if moving.isEmpty():
            return done
        hooks = done.unionByName(moving)


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, root) for every node of edges (a, b) and of the known (node, root) table, root being the
    smallest node of the component. Self ties and repeated ties do no harm."""
    edges = cut(edges)  # used several times below; without this the records would be read each time
    label = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node"))
    if known is not None:
        old = known.select("node", "root")
        label = label.select("node").union(old.select("node")).union(old.select(F.col("root").alias("node"))).distinct().join(old, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        a = edges.join(label.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").select("b", "ra")
        edges = a.join(label.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    label = cut(label)
    live = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not live.isEmpty():
        hooks = cut(live.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")))
        hooks = jump(hooks)
        to = lambda side, out: hooks.select(F.col("node").alias(side), F.col("up").alias(out))
        label = cut(label.join(to("root", "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        moved = live.join(to("a", "ua"), "a", "left").join(to("b", "ub"), "b", "left").select(F.coalesce("ua", "a").alias("a"), F.coalesce("ub", "b").alias("b"))
        live = cut(moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return label


def tied_members(rows: DataFrame, record: str = "transaction_id", member: str = "unique_mem_id") -> DataFrame:
    """(first_mem_id, unique_mem_id) for each member of a set of two or more but its smallest."""
    found = components(ties(rows, record, member)).filter("node <> root")
    return found.select(F.col("root").alias("first_mem_id"), F.col("node").alias("unique_mem_id"))


def _deal(parts: DataFrame, held: dict[str, int], proportions: dict[str, float]) -> DataFrame:
    """Gives each (unit, n) a split so that the deficits against the proportions are filled. Heavy
    units, of which there are at most HEAVY, are dealt singly, largest first; the others go by
    BUCKETS hash buckets. Only those counts reach the driver."""
    spark = parts.sparkSession
    total = (parts.agg(F.sum("n").alias("n")).first().n or 0) + sum(held.values())
    wanted = {s: p * total for s, p in proportions.items()}
    have = {s: held.get(s, 0) for s in proportions}
    bucket = F.when(F.col("n") * HEAVY > total, F.lit(None)).otherwise(F.pmod(F.xxhash64("unit"), F.lit(BUCKETS))).cast("int")
    placed = parts.withColumn("bucket", bucket)
    heavy = bounded_rows(placed.filter("bucket is null").select("unit", "n"), HEAVY, "the heavy units")
    light = bounded_rows(placed.filter("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")), BUCKETS, "the buckets")

    def fill(items: list[tuple]) -> list[tuple]:
        out = []
        for unit, n in sorted(items, key=lambda x: (-x[1], str(x[0]))):
            best = max(proportions, key=lambda s: (wanted[s] - have[s], s))
            have[best] += n
            out.append((unit, best))
        return out

    singly = fill([(r.unit, r.n) for r in heavy])
    by_bucket = fill([(r.bucket, r.n) for r in light])
    heavy_table = spark.createDataFrame(singly, "unit string, s1 string")
    light_table = spark.createDataFrame(by_bucket, "bucket int, s2 string")
    joined = placed.join(F.broadcast(heavy_table), "unit", "left").join(F.broadcast(light_table), "bucket", "left")
    return joined.select("unit", "n", F.coalesce("s1", "s2").alias("split"))


def assign_splits(rows: DataFrame, record: str = "transaction_id", member: str = "unique_mem_id", proportions: dict[str, float] | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns (table, assigned).

    table is the component table to persist: (node, root, split, state) for every member, state being
    kept, new or quarantined; for quarantined components split is 'quarantine'. assigned is
    (record, split), one row per distinct record.

    All rows of one member and all rows of one record get the same split. Rows without member are a
    unit by their record, unless other rows of that record have a member; rows without record go by
    their member, or, without either, are left out of `assigned`. Repeated rows count each towards the
    proportions. An empty table gives empty results. Other columns are not read. `known` is a table
    of an earlier call; members of it that rows lacks stay in the table.
    """
    proportions = proportions or PROPORTIONS
    slim = rows.select(F.col(record).alias("r"), F.col(member).cast("string").alias("m"))
    singles = slim.filter("m is not null").select("m").distinct()
    found = components(ties(rows, record, member), None if known is None else known.select("node", "root"))
    label = cut(singles.select(F.col("m").alias("node")).union(found.select("node")).distinct().join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    # a record's unit: the root of any of its members (all have the same), else the record itself. Rows are
    # counted by (record, member) first and rows without a member do not take part in the join; the rows of
    # a member with very many records are spread over parts
    counted = slim.filter("m is not null").groupBy("r", "m").agg(F.count(F.lit(1)).alias("n"))
    heavy = cut(counted.groupBy("m").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") > PART_ROWS).select("m", F.ceil(F.col("_k") / PART_ROWS).cast("int").alias("_parts")))
    named = label.select(F.col("node").alias("m"), "root").join(heavy, "m", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    placed = counted.join(heavy, "m", "left").withColumn("_part", F.pmod(F.xxhash64("r"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    of_rows = placed.join(named, ["m", "_part"]).select("r", "root", "n").unionByName(slim.filter("m is null").groupBy("r").agg(F.count(F.lit(1)).alias("n")).select("r", F.lit(None).cast("string").alias("root"), "n"))
    of_record = of_rows.groupBy("r").agg(F.min("root").alias("root"), F.sum("n").alias("n"))
    of_record = of_record.filter(F.col("r").isNotNull()).select("r", F.coalesce("root", F.concat(F.lit("record:"), F.col("r").cast("string"))).alias("unit"), "n")
    units = of_record.groupBy("unit").agg(F.sum("n").alias("n"))
    lost = label.select(F.col("root").alias("unit")).distinct().join(units, "unit", "left_anti").withColumn("n", F.lit(0).cast("long"))
    units = units.unionByName(lost)
    held: dict[str, int] = {}
    if known is not None:
        before = label.join(known.select("node", F.col("split").alias("old")), "node").groupBy(F.col("root").alias("unit")).agg(F.min("old").alias("lo"), F.max("old").alias("hi"))
        fixed = cut(units.join(before, "unit").select("unit", "n", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(QUARANTINED).alias("split")))
        held = {r.split: r.n for r in fixed.groupBy("split").agg(F.sum("n").alias("n")).collect() if r.split in proportions}
        fresh = _deal(cut(units.join(fixed.select("unit"), "unit", "left_anti")), held, proportions)
        states = fixed.withColumn("state", F.when(F.col("split") == QUARANTINED, "quarantined").otherwise("kept")).unionByName(fresh.withColumn("state", F.lit("new")))
    else:
        states = _deal(cut(units), held, proportions).withColumn("state", F.lit("new"))
    states = cut(states)
    table = label.join(states.select(F.col("unit").alias("root"), "split", "state"), "root").select("node", "root", "split", "state")
    assigned = of_record.join(states.select("unit", "split"), "unit").select(F.col("r").alias(record), "split")
    return table, assigned


def merge_conflicts(table: DataFrame) -> DataFrame:
    """(root, n_members) of the quarantined components of a component table."""
    return table.filter(F.col("state") == "quarantined").groupBy("root").agg(F.count(F.lit(1)).alias("n_members"))


def violations(rows: DataFrame, assigned: DataFrame, record: str = "transaction_id", member: str = "unique_mem_id") -> DataFrame:
    """(n_records, n_unassigned, n_twice, n_members_apart): the records of rows, those that have no split,
    those that have several, and the members whose records are in more than one split."""
    slim = rows.select(F.col(record).alias("r"), F.col(member).cast("string").alias("m")).filter("r is not null").distinct()
    given = slim.join(assigned.select(F.col(record).alias("r"), "split"), "r", "left")
    by_record = given.groupBy("r").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("lo").isNull()).alias("n_unassigned"), F.count_if(F.col("lo") < F.col("hi")).alias("n_twice"))
    apart = given.filter("m is not null").groupBy("m").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).agg(F.count_if(F.col("lo") < F.col("hi")).alias("n_members_apart"))
    return by_record.withColumn("n_members_apart", apart.scalar())


def split_shares(rows: DataFrame, assigned: DataFrame, record: str = "transaction_id") -> DataFrame:
    """(split, n_rows, share) reached."""
    counts = rows.groupBy(record).agg(F.count(F.lit(1)).alias("n")).join(assigned, record).groupBy("split").agg(F.sum("n").alias("n_rows"))
    return counts.withColumn("share", F.round(F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(F.lit(1))), 6))
