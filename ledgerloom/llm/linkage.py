"""Matching entities across sources without keys (problem 4) by a label model.

Candidates are pairs of records of one town and number whose streets share a MinHash band (see
addresses) and whose names share one. The records of one town and number come to one worker, which
compares the bands of all pairs and votes on those that share them; a town and number of very many
records is a table of bands of its own that is joined. Many heuristic matching functions each vote match, no match or
nothing on every candidate. The votes of all candidates are counted by pattern; a generative model with
one latent class is fitted to the counts by expectation maximisation: it learns how accurate each
function is and, by a tree of the strongest dependences among them (Chow and Liu), which of them say
the same thing twice. The posterior of the pattern is the confidence of the pair and alone decides. The
number of patterns is bounded by the functions, not by the data, so that the fit sees all candidates at
any size.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bounded_rows, cut, sized_broadcast
from .addresses import _place, gazetteer, location_candidates, read_places, reading, with_towns, zip_towns
from .names import compare, letters, name_words, trades_agree
from .places import APART, DIRECTIONS, SAME, aligned, street_bands, street_type
from .textkit import bags, distances, fold, words

VOTES = ("core", "trade", "spelling", "letters", "chain", "website", "category", "address", "street", "direction", "kind", "unit", "postcode")
#: What the functions vote on: the same business, the same location.
FACETS = (tuple(range(7)), tuple(range(7, 13)))
#: Most vote patterns: three values for each function.
PATTERNS = 3 ** len(VOTES)  # 1.6 million; some thousands occur
#: Pairs and records that a town and number may have to be compared by one worker; those beyond go by joins of bands.
BLOCK_PAIRS, BLOCK_ROWS = 250_000, 20_000
#: Pairs whose bands are compared at once.
PAIRS_AT_ONCE = 100_000
#: Postcodes of five digits.
ZIPS = 100_000
NAME_BANDS = 28
_RNG = np.random.default_rng(20_140_507)
_A = _RNG.integers(1, 2**31 - 1, NAME_BANDS, dtype=np.int64) | 1
_B = _RNG.integers(0, 2**31 - 1, NAME_BANDS, dtype=np.int64)


@lru_cache(maxsize=20_000)
def _hashed(gram: str) -> np.ndarray:
    return (zlib.crc32(gram.encode()) * _A + _B) % ((1 << 61) - 1) % ((1 << 31) - 1)


@lru_cache(maxsize=100_000)
def name_bands(name: str) -> tuple[int, ...]:
    """MinHash of the 2-grams of the words of a name, one hash per band."""
    grams = {f" {w}"[i : i + 2] for w in name_words(name) for i in range(len(w))} or {""}
    return tuple(np.minimum.reduce([_hashed(g) for g in grams]).tolist())


@lru_cache(maxsize=200_000)
def _joined(name: str) -> str:
    return "".join(name_words(name))


def _telling(name: str, chain: str, trades: tuple[str, ...]) -> int:
    return compare(name, chain, trades)[0] if chain else 0


def _hosted(name: str, site: str) -> int:
    host = "".join(words(fold(site).split("//")[-1].removeprefix("www."))) if site else ""
    ws = name_words(name)
    return 0 if not host or not ws else 1 if ws[0][:5] in host else -1


def _labelled(name: str, category: str, trades: tuple[str, ...]) -> int:
    label, rest = "".join(words(fold(category))) if category else "", "".join(name_words(name)[1:])
    return 0 if label not in trades or not rest else 1 if trades_agree(rest, label, trades) else -1


def name_votes(names: list[tuple[str, str]], trades: tuple[str, ...]) -> list[tuple[int, ...]]:
    """core, trade, spelling, letters of pairs of names."""
    pairs = [(_joined(a), _joined(b)) for a, b in names]
    apart = distances(pairs) / np.array([max(len(a), len(b), 1) for a, b in pairs])
    spelt = np.where(apart <= 0.2, 1, np.where(apart > 0.5, -1, 0)).tolist()
    shared = [letters(a, b) for a, b in pairs]
    return [(*compare(a, b, trades), v, 1 if s >= 0.75 else -1 if s < 0.5 else 0) for (a, b), v, s in zip(names, spelt, shared)]


def _street_votes(streets: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """street, and whether the whole addresses may be the same: streets of one word must stand for each other."""
    pairs = [(a.replace(" ", ""), b.replace(" ", "")) for a, b in streets]
    out = []
    for (a, b), (x, y), cost in zip(streets, pairs, distances(pairs).tolist()):
        longer = max(len(x), len(y))
        cost = 0.0 if x == y else cost * max(1.0, 6.0 / longer) if longer >= 4 and cost <= SAME else APART  # swap()
        out.append((1 if cost == 0 else 0 if cost <= SAME else -1, int(cost < APART or " " in a or " " in b)))
    return out


class Records:
    """The columns loc, name, zip5, chain, site and category of a frame, every value of a column told once."""

    def __init__(self, f: pd.DataFrame):
        self.loc, self.name, self.zip5, self.chain, self.site, self.category = (pd.factorize(f[c]) for c in ("loc", "name", "zip5", "chain", "site", "category"))
        places = [_place(x) for x in self.loc[1]]
        streets, self.streets = pd.factorize(np.array([p.street for p in places], dtype=object))
        self.street = streets[self.loc[0]]
        glued = [x.replace(" ", "") for x in self.streets]
        self.length = np.array([len(x) for x in glued])
        self.bags = bags(glued)
        forms = ([DIRECTIONS.get(p.direction, p.direction) for p in places], [p.kind and f"{street_type(p.kind)}." for p in places], [p.unit for p in places])
        self.number = self._numbers([p.number for p in places])[self.loc[0]]
        # direction, kind, unit and postcode as numbers, 0 where they are not given
        self.parts = [self._numbers(x)[self.loc[0]] for x in forms] + [self._numbers(self.zip5[1])[self.zip5[0]]]

    @staticmethod
    def _numbers(values) -> np.ndarray:
        known = {"": 0}
        return np.array([known.setdefault(v, len(known)) for v in values], dtype=np.int64)

    def votes(self, i: np.ndarray, j: np.ndarray, trades: tuple[str, ...]) -> np.ndarray:
        """The votes of all functions on the pairs of a store at i and a merchant at j."""
        pairs = lambda tell: lambda x: [(tell(a, b),) for a, b in x]
        name = [
            _told(self.name, i, self.name, j, lambda x: name_votes(x, trades), 4),
            _told(self.name, i, self.chain, j, pairs(lambda a, b: _telling(a, b, trades)), 1),
            _told(self.name, i, self.site, j, pairs(_hosted), 1),
            _told(self.name, i, self.category, j, pairs(lambda a, b: _labelled(a, b, trades)), 1),
        ]
        parts = [np.where((x[i] == 0) | (x[j] == 0), 0, np.where(x[i] == x[j], 1, -1)) for x in self.parts]
        # street, and whether the address may be the same
        street, address = np.full((2, len(i)), -1, dtype=np.int64)
        # streets that differ by so many letters are far apart, however their words are aligned
        more = self.bags[self.street[i]] - self.bags[self.street[j]]
        ahead = np.maximum(more, 0).sum(axis=1)
        near = np.maximum(ahead, ahead - more.sum(axis=1)) * 0.6 <= SAME + 1e-6
        coded = (self.street, self.streets)
        street[near], possible = _told(coded, i[near], coded, j[near], _street_votes, 2).T
        near[near] = possible == 1
        # parts left out or shortened cost less than SAME together
        plain = near & (self.street[i] == self.street[j]) & (self.number[i] == self.number[j])
        address[plain & (np.min(parts[:3], axis=0) >= 0)] = 1
        near &= ~plain
        address[near] = _told(self.loc, i[near], self.loc, j[near], lambda x: [(1 if aligned(_place(a), _place(b)) else -1,) for a, b in x], 1)[:, 0]
        return np.column_stack([*name, address, street, *parts])


def _told(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, tell, wide: int) -> np.ndarray:
    """What `tell` says on the pairs of values of two coded columns, each pair asked once."""
    if not len(i):
        return np.zeros((0, wide), dtype=np.int64)
    many = len(b[1])
    asked, place = np.unique(a[0][i].astype(np.int64) * many + b[0][j], return_inverse=True)
    said = tell([(a[1][x], b[1][y]) for x, y in zip((asked // many).tolist(), (asked % many).tolist())])
    return np.array(said, dtype=np.int64).reshape(-1, wide)[place]


class LabelModel:
    """A pair is a match if it is one in every facet (the same business; at the same location). Each facet is
    a latent class of its own that the votes of its functions depend on; each vote depends besides on one
    other vote of the facet, its parent in a tree. How often the facets hold together is learned as
    well. Before any vote is seen functions are taken to be right more often than wrong, the first one of a
    facet above all; that weighs as much as one candidate does."""

    #: Counts of votes -1, 0 and 1 that every function starts with, where the facet does not hold and where it does.
    BELIEVED = np.array([[0.8, 0.5, 0.2], [0.2, 0.5, 0.8]])
    BELIEVED_FIRST = np.array([[1.0, 0.3, 0.2], [0.02, 0.3, 1.2]])

    def __init__(self, facets: tuple[tuple[int, ...], ...] | None = None, rounds: int = 60, smooth: float = 0.5):
        self.facets, self.rounds, self.smooth = facets, rounds, smooth

    def fit(self, patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
        self.facets = self.facets or (tuple(range(patterns.shape[1])),)
        x = patterns + 1  # 0, 1, 2
        w = counts.astype(float)
        held = [1 / (1 + np.exp(-(2 * patterns[:, f[0]] + 4 * (patterns[:, list(f)].mean(axis=1) - 0.1)))) for f in self.facets]
        states = self._states()
        belief = np.prod([[h if s else 1 - h for s in col] for h, col in zip(held, zip(*states))], axis=0)
        self.parents = [[-1] * len(f) for f in self.facets]
        for step in range(self.rounds):
            if step == self.rounds // 3:
                self.parents = [self._tree(x[:, list(f)], w, self._held(belief, k)) for k, f in enumerate(self.facets)]
            self._maximise(x, w, belief)
            belief = self._belief(x)
        return self

    def _states(self) -> list[tuple[int, ...]]:
        return list(itertools.product((0, 1), repeat=len(self.facets)))

    def _held(self, belief: np.ndarray, k: int) -> np.ndarray:
        """How likely facet k holds, whatever the others."""
        return sum(b for s, b in zip(self._states(), belief) if s[k])

    @property
    def parent(self) -> list[int]:
        """For each function the one that it leans on, or -1."""
        out = [-1] * sum(map(len, self.facets))
        for f, parents in zip(self.facets, self.parents):
            for i, p in zip(f, parents):
                out[i] = f[p] if p >= 0 else -1
        return out

    def _maximise(self, x: np.ndarray, w: np.ndarray, belief: np.ndarray) -> None:
        total = np.array([(w * b).sum() for b in belief]) + self.smooth
        self.prior = total / total.sum()
        self.tables = []
        for k, f in enumerate(self.facets):
            held, own = self._held(belief, k), x[:, list(f)]
            for j, parent in enumerate(self.parents[k]):
                up = own[:, parent] if parent >= 0 else np.zeros(len(x), dtype=int)
                table = np.repeat((self.BELIEVED if j else self.BELIEVED_FIRST)[:, None, :], 3, axis=1)
                for c, weight in ((1, w * held), (0, w * (1 - held))):
                    np.add.at(table[c], (up, own[:, j]), weight)
                self.tables.append(table / table.sum(axis=2, keepdims=True))

    def _tree(self, x: np.ndarray, w: np.ndarray, held: np.ndarray) -> list[int]:
        """Parents by a maximum spanning tree over conditional mutual information given the class."""
        k = x.shape[1]
        info = np.zeros((k, k))
        for i in range(k):
            for j in range(i):
                for weight in (w * held, w * (1 - held)):
                    joint = np.full((3, 3), 1e-6)
                    np.add.at(joint, (x[:, i], x[:, j]), weight)
                    share = joint.sum() / max(w.sum(), 1e-9)
                    joint /= joint.sum()
                    alone = joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True)
                    info[i, j] += share * float((joint * np.log(joint / alone)).sum())
                info[j, i] = info[i, j]
        parent, inside = [-1] * k, {0}
        while len(inside) < k:
            i, j = max(((i, j) for i in inside for j in range(k) if j not in inside), key=lambda e: (info[e], -e[1]))
            if info[i, j] > 0.01:
                parent[j] = i
            inside.add(j)
        return parent

    def _belief(self, x: np.ndarray) -> np.ndarray:
        """The posterior of every state of the facets."""
        log = np.log(self.prior)[:, None] + np.zeros((len(self.prior), len(x)))
        tables = iter(self.tables)
        for k, f in enumerate(self.facets):
            own = x[:, list(f)]
            each = np.zeros((2, len(x)))
            for j, parent in enumerate(self.parents[k]):
                up = own[:, parent] if parent >= 0 else np.zeros(len(x), dtype=int)
                table = next(tables)
                for c in (0, 1):
                    each[c] += np.log(table[c, up, own[:, j]])
            for n, s in enumerate(self._states()):
                log[n] += each[s[k]]
        log -= log.max(axis=0)
        return np.exp(log) / np.exp(log).sum(axis=0)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """How likely all facets hold."""
        return self._belief(patterns + 1)[-1]


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(la, na, lb, nb) of records (loc, name) whose locations and names share a band. Records of one
    location and name are one class until the candidates are known; only names at locations that have
    a partner are banded."""
    sides = left.select("loc", F.lit(0).alias("side")).union(right.select("loc", F.lit(1).alias("side"))).distinct()
    near = cut(location_candidates(sides))
    classes = lambda x, loc, name, ident: cut(x.select(F.col("loc").alias(loc), F.col("name").alias(name)).distinct().join(near.select(loc).distinct(), loc, "left_semi").withColumn(ident, F.monotonically_increasing_id()))
    a, b = classes(left, "la", "na", "i"), classes(right, "lb", "nb", "j")
    bands = F.pandas_udf(lambda s: pd.Series([list(name_bands(x)) for x in s]), "array<bigint>")
    spread = lambda x, name, *cols: x.withColumn("_bands", bands(name)).select(*cols, F.posexplode("_bands").alias("_n", "_h"))
    asked = spread(a.join(near, "la"), "na", "i", "lb").select("i", F.xxhash64("lb", "_n", "_h").alias("band_key"))
    given = spread(b, "nb", "j", "lb").select("j", F.xxhash64("lb", "_n", "_h").alias("band_key"))
    return asked.join(given, "band_key").select("i", "j").distinct().join(a, "i").join(b, "j").select("la", "na", "lb", "nb")


def _plain_names(names: pd.Series, towns: frozenset[str]) -> list[str | None]:
    """Names without the town that is written after them."""
    out: list[str | None] = []
    for name in names:
        ws = words(fold(name)) if isinstance(name, str) else []
        for n in (3, 2, 1):
            if len(ws) > n and "".join(ws[-n:]) in towns:
                ws = ws[:-n]
                name = " ".join(ws[:-1] if len(ws) > 1 and ws[-1] == "of" else ws)
                break
        out.append(name if isinstance(name, str) else None)
    return out


def _prepare(df: DataFrame, key: str, name: str, columns: tuple[str, str, str, str], entries, keep: tuple[str, ...] = ()) -> DataFrame:
    towns = frozenset("".join(words(fold(e.name))) for e in entries)

    def plain(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(_keep0=_plain_names(rows["_keep0"], towns))

    return cut(read_places(df, key, *columns, entries, keep=(name, *keep), tidy=plain))


def link(
    stores: DataFrame,
    merchants: DataFrame,
    cities: DataFrame,
    store_key: str = "store_row",
    store_name: str = "keywords",
    store_place: tuple[str, str, str, str] = ("address", "city", "state", "zip_code"),
    merchant_key: str = "factual_id",
    merchant_name: str = "place_name",
    merchant_place: tuple[str, str, str, str] = ("address", "locality", "region", "postcode"),
    chain: str = "chain_name",
    website: str = "website",
    category: str = "category_labels",
    updated: str = "updated_at",
    least: float = 0.5,
) -> DataFrame:
    """(store_key, merchant_key, confidence) of the pairs that are the same business at the same
    location with a posterior of at least `least`; a store has at most one merchant, the one of the
    highest confidence, ties going to the smaller merchant key.

    Of several deliveries of one merchant the latest counts. Records without number, street or town,
    and records without a name, are no candidates. NULLs in other columns, and a chain, website or category
    column that merchants lack, make functions abstain. A
    model is fitted to whatever candidates there are; without any there are no rows. Repeated store
    rows are matched alike; other columns are not read.
    """
    voted = cut(ballots(stores, merchants, cities, store_key, store_name, store_place, merchant_key, merchant_name, merchant_place, chain, website, category, updated))
    believed = voted.join(F.broadcast(beliefs(voted)), "votes").filter(F.col("confidence") >= least)  # as many rows as vote patterns
    best = believed.groupBy(store_key).agg(F.min_by(F.struct(merchant_key, "confidence"), F.struct(-F.round("confidence", 9), F.col(merchant_key))).alias("_b"))
    return best.select(store_key, f"_b.{merchant_key}", "_b.confidence")


def ballots(stores: DataFrame, merchants: DataFrame, cities: DataFrame, store_key: str, store_name: str, store_place: tuple, merchant_key: str, merchant_name: str, merchant_place: tuple, chain: str, website: str, category: str, updated: str) -> DataFrame:
    """(store_key, merchant_key, votes) of every candidate; its votes are one number (encoded())."""
    entries = gazetteer(cities)
    more = (chain, website, category)
    merchants = merchants.withColumns({c: F.lit(None).cast("string") for c in more if c not in merchants.columns})
    newest = merchants.groupBy(F.col(merchant_key).alias("_mk")).agg(F.max_by(F.struct(*[F.col(c) for c in dict.fromkeys((merchant_name, *merchant_place, *more))]), F.struct(F.coalesce(F.col(updated).cast("timestamp"), F.timestamp_micros(F.lit(0))), F.col(merchant_name))).alias("_m")).filter("_mk is not null").select("_mk", "_m.*")
    s = _prepare(stores, store_key, store_name, store_place, entries)
    m = _prepare(newest, "_mk", merchant_name, merchant_place, entries, keep=more)
    by_zip = sized_broadcast(cut(zip_towns(s.select("zip5", "town").union(m.select("zip5", "town")))), ZIPS)
    base = lambda x, *cols: with_towns(x, by_zip).filter("town <> '' and number <> '' and street <> '' and trim(_keep0) <> ''").select("_k", F.xxhash64("town", "number").alias("block"), reading().alias("loc"), F.col("_keep0").alias("name"), "zip5", *cols)
    s = base(s)
    m = base(m, *[F.coalesce(f"_keep{i}", F.lit("")).alias(n) for i, n in enumerate(("chain", "site", "category"), 1)])
    trades = common_trades(m)
    kinds = f"_sk {dict(s.dtypes)['_k']}, _mk {dict(m.dtypes)['_k']}, votes bigint"
    named = lambda x: x.select(F.col("_sk").alias(store_key), F.col("_mk").alias(merchant_key), "votes")
    heavy = heavy_blocks(s, m)
    if heavy.isEmpty():
        return named(_by_blocks(s, m).mapInPandas(_voting_on_blocks(trades), kinds))
    heavy = sized_broadcast(heavy)
    light = [x.join(heavy, "block", "left_anti") for x in (s, m)]
    s, m = cut(s.join(heavy, "block", "left_semi").distinct()), cut(m.join(heavy, "block", "left_semi"))
    # postcode, chain and website belong to the records
    stores_in = s.select(F.col("loc").alias("la"), F.col("name").alias("na"), F.col("zip5").alias("za"), F.col("_k").alias("_sk"))
    merchants_in = m.select(F.col("loc").alias("lb"), F.col("name").alias("nb"), F.col("zip5").alias("zb"), "chain", "site", "category", F.col("_k").alias("_mk"))
    wide = candidates(s, m).join(stores_in, ["la", "na"]).join(merchants_in, ["lb", "nb"])
    return named(_by_blocks(*light).mapInPandas(_voting_on_blocks(trades), kinds).union(wide.mapInPandas(_voting(trades), kinds)))


def heavy_blocks(s: DataFrame, m: DataFrame) -> DataFrame:
    """(block) of the towns and numbers with more records, or pairs of them, than one worker compares."""
    sides = s.select("block", F.lit(1).alias("a"), F.lit(0).alias("b")).union(m.select("block", F.lit(0).alias("a"), F.lit(1).alias("b")))
    counted = sides.groupBy("block").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return cut(counted.filter((F.col("a") * F.col("b") > BLOCK_PAIRS) | (F.col("a") + F.col("b") > BLOCK_ROWS)).select("block"))


def _by_blocks(s: DataFrame, m: DataFrame) -> DataFrame:
    """The records of both sides, those of a block one after the other, stores first."""
    none = lambda x: F.lit(0 if isinstance(x.schema["_k"].dataType, T.NumericType) else None).cast(x.schema["_k"].dataType)  # noqa: E731  # a NULL would make floats of whole numbers
    more = ("chain", "site", "category")
    both = s.select("block", F.lit(0).alias("side"), F.col("_k").alias("_sk"), none(m).alias("_mk"), "loc", "name", "zip5", *[F.lit("").alias(c) for c in more])
    both = both.unionByName(m.select("block", F.lit(1).alias("side"), none(s).alias("_sk"), F.col("_k").alias("_mk"), "loc", "name", "zip5", *more))
    return both.repartition("block").sortWithinPartitions("block", "side")


def encoded(votes: np.ndarray) -> np.ndarray:
    """A pattern of votes as one number."""
    return (votes + 1) @ 3 ** np.arange(len(VOTES), dtype=np.int64)


def decoded(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(VOTES), dtype=np.int64) % 3 - 1


def beliefs(voted: DataFrame) -> DataFrame:
    """(votes, confidence) of every pattern of votes."""
    counts = bounded_rows(voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), PATTERNS, "the vote patterns")
    belief = []
    if counts:
        codes = np.array([r.votes for r in counts], dtype=np.int64)
        patterns = decoded(codes)
        posterior = LabelModel(FACETS).fit(patterns, np.array([r.n for r in counts])).posterior(patterns)
        belief = [(int(c), float(q)) for c, q in zip(codes, posterior)]
    return voted.sparkSession.createDataFrame(belief, "votes bigint, confidence double")


def common_trades(merchants: DataFrame, share: float = 0.002) -> tuple[str, ...]:
    """The endings of one or two words that at least `share` of all names have: at most 2 / share."""
    counts = cut(merchants.select(F.coalesce("name", F.lit("")).alias("name")).mapInPandas(_tails, "t string, n bigint").groupBy("t").agg(F.sum("n").alias("n")))
    rows = counts.filter("t = ''").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    found = bounded_rows(counts.filter((F.col("n") >= rows * F.lit(share)) & (F.col("t") != "")).select("t"), int(2 / share) + 1, "the common endings of names")
    return tuple(sorted((r.t for r in found if len(r.t) >= 4), key=lambda t: (-len(t), t)))


def _tails(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(t, n): the endings of names, counted within a batch, and as '' all names."""
    for f in frames:
        counted = Counter({"": len(f)})
        for name in f["name"]:
            ws = name_words(name)
            counted.update(t for t in ("".join(ws[-1:]) if len(ws) > 1 else "", "".join(ws[-2:]) if len(ws) > 2 else "") if t)
        yield pd.DataFrame({"t": list(counted), "n": np.array(list(counted.values()), dtype=np.int64)})


def _voting(trades: tuple[str, ...]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            stores = f[["la", "na", "za"]].set_axis(["loc", "name", "zip5"], axis=1).assign(chain="", site="", category="")
            merchants = f[["lb", "nb", "zb", "chain", "site", "category"]].set_axis(stores.columns, axis=1)
            place = np.arange(len(f))
            votes = Records(pd.concat([stores, merchants], ignore_index=True)).votes(place, place + len(f), trades)
            yield pd.DataFrame({"_sk": f["_sk"], "_mk": f["_mk"], "votes": encoded(votes)})

    return run


def _whole_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of sorted batches, so that no block is parted."""
    held: list[pd.DataFrame] = []
    for f in frames:
        if not len(f):
            continue
        blocks = f["block"].to_numpy()
        last = int(np.flatnonzero(blocks != blocks[-1])[-1]) + 1 if blocks[0] != blocks[-1] else 0
        if last or (held and held[-1]["block"].iloc[-1] != blocks[0]):
            yield pd.concat([*held, f.iloc[:last]], ignore_index=True)
            held = []
        held.append(f.iloc[last:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _pairs(blocks: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of a store and a merchant of one block, some at a time. Rows are sorted by block and side."""
    n = len(blocks)
    starts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
    ends = np.append(starts[1:], n)
    middle = starts + np.add.reduceat((side == 0).astype(np.int64), starts)
    of = np.repeat(np.arange(len(starts)), ends - starts)
    stores = np.flatnonzero(side == 0)
    first, many = middle[of[stores]], (ends - middle)[of[stores]]
    stores, first, many = (x[many > 0] for x in (stores, first, many))
    total = np.cumsum(many)
    at = 0
    while at < len(stores):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        size = many[at:to]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        yield np.repeat(stores[at:to], size), np.repeat(first[at:to], size) + within
        at = to


def _voting_on_blocks(trades: tuple[str, ...]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _whole_blocks(frames):
            f = f[(f["side"] == 1) | ~f.duplicated(["side", "_sk", "loc", "name", "zip5"])]  # repeated store rows
            side, blocks = f["side"].to_numpy(), f["block"].to_numpy()
            told = Records(f)
            street_band, name_band = (np.array([of(x) for x in values], dtype=np.int32) for of, values in ((street_bands, told.streets), (name_bands, told.name[1])))
            sk, mk = f["_sk"].to_numpy(), f["_mk"].to_numpy()
            for i, j in _pairs(blocks, side):
                near = np.abs(told.length[told.street[i]] - told.length[told.street[j]]) * 0.6 <= SAME
                for of, band in ((told.street, street_band), (told.name[0], name_band)):
                    i, j = i[near], j[near]
                    near = (of[i] == of[j]) | (band[of[i]] == band[of[j]]).any(axis=1)
                i, j = i[near], j[near]
                votes = told.votes(i, j, trades)
                yield pd.DataFrame({"_sk": pd.Series(sk[i], dtype=f["_sk"].dtype), "_mk": pd.Series(mk[j], dtype=f["_mk"].dtype), "votes": encoded(votes)})

    return run
