"""Mapping freely typed values to the entries of a reference list (problem 1).

A symmetric-delete dictionary over the distinguishing part of every entry's name gives the entries
within two edits of what was typed; candidates are ranked by weighted Damerau-Levenshtein distance,
then by how often the entry is spelled exactly in the data, then by id. What is typed around that part
must be explained by the entry (an abbreviation of its trade, its direction or landform) or be dirt
of a known kind (shop numbers, legal forms, a town after a business); otherwise the value stands for
another business or town and is reported as a miss.

Distinct values are resolved, once each, and joined back to the rows. The dictionary is built once and
broadcast. A list longer than BLOCK_ENTRIES is taken in blocks, one dictionary after the other; every
value is sought in every block and the best match kept by one rank that holds across blocks, so that
the result does not depend on the size of a block.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_rows, cut, sized_broadcast
from .textkit import DeleteDictionary, allowed, distance, fold, shortens, words

#: Entries of which one dictionary is made. Beyond that the list is matched in blocks.
BLOCK_ENTRIES = 20_000
#: Different states (or other regions) that a list of towns may have.
MOST_STATES = 10_000
#: Resolved values a worker remembers.
MEMORY = 200_000
#: Resolved values that are broadcast for the join with the rows; beyond that they are shuffled, but for
#: those that more than one row in HEAVY_SHARE holds.
MAPPED_ROWS, HEAVY_SHARE = 100_000, 2_000

LEGAL_FORMS = frozenset(("inc", "ltd", "llc", "corp", "co", "plc", "gmbh", "store", "shop", "www", "com", "example"))
PAYMENT_MARKS = frozenset(("tpv", "payx", "zpay", "z-pay", "sq", "pos", "www"))
ARTICLES = frozenset(("the",))

#: Words before and after the distinguishing part of a town's name, with their short forms.
BEFORE = {
    "north": ("n", "no", "nth"),
    "south": ("s", "so", "sth"),
    "east": ("e",),
    "west": ("w",),
    "saint": ("st", "snt"),
    "mount": ("mt", "mnt"),
    "fort": ("ft",),
    "lake": ("lk",),
    "port": ("pt", "prt"),
    "new": (),
}
AFTER = {
    "falls": ("fls",),
    "heights": ("hts", "hgts"),
    "springs": ("spgs", "sprs", "spg"),
    "grove": ("grv",),
    "beach": ("bch",),
    "junction": ("jct", "jctn"),
    "city": ("cty",),
    "park": ("pk", "prk"),
}
#: Other words for a trade.
TRADE_WORDS = {"coffee": ("cafe", "coffeehouse"), "grill": ("grille",), "pharmacy": ("drugs", "drugstore"), "cinemas": ("cinema",)}
AROUND_TOWN = (("city", "of"), ("downtown",), ("greater",))


@dataclass(frozen=True)
class Conventions:
    """What is written around names. The defaults are common in feeds of payments; a reference table of
    another feed is passed in its place, e.g. Conventions(payment_marks=frozenset(...))."""

    legal_forms: frozenset[str] = LEGAL_FORMS
    payment_marks: frozenset[str] = PAYMENT_MARKS
    articles: frozenset[str] = ARTICLES
    trade_words: dict[str, tuple[str, ...]] = field(default_factory=lambda: TRADE_WORDS)


USUAL = Conventions()


@dataclass(frozen=True)
class Entry:
    ref_id: int
    name: str
    extra: str  # the trade of a business, the state of a town
    seen: int = 0


@dataclass(frozen=True)
class Match:
    """An entry with its rank among all matches of a value: smaller is better, in whatever block it was found."""

    ref_id: int
    cost: float
    rank: tuple


def business_words(value: str, usual: Conventions = USUAL) -> list[str]:
    """The words of a typed business without shop number, payment mark, legal form and article."""
    text = re.sub(r"#\s*[\w-]+", " ", fold(value))
    text = re.sub(r"^\s*[\w-]{1,8}\s*\*", " ", text)
    first = text.split(None, 1)
    if len(first) > 1 and first[0] in usual.payment_marks:
        text = first[1]
    ws = [w for w in words(re.sub(r"'s?\b", " ", text) if "'" in text else text)]
    while len(ws) > 1 and ws[0] in usual.payment_marks:
        ws = ws[1:]
    while len(ws) > 1 and (ws[-1] in usual.legal_forms or ws[-1].isdigit()):
        ws = ws[:-1]
    return [w for w in ws if w not in usual.articles]


def tails(value: str, usual: Conventions = USUAL) -> list[str]:
    """The last one, two and three words of a business, where words are left before them: what may be a town."""
    ws = business_words(value, usual)
    return ["".join(ws[-n:]) for n in (1, 2, 3) if len(ws) > n]


class Businesses:
    """Resolves names of businesses: entries have a name and the trade that it ends with."""

    def __init__(self, entries: list[Entry], towns: frozenset[str] = frozenset(), usual: Conventions = USUAL):
        self.cores = DeleteDictionary()
        self.by_core: dict[str, list[tuple[Entry, str]]] = defaultdict(list)
        self.towns, self.usual = towns, usual
        for e in entries:
            trade = "".join(words(fold(e.extra or "")))
            ws = [w for w in words(fold(e.name).replace("'s", "")) if w not in usual.articles]
            tail = len(words(fold(e.extra or "")))
            core = "".join(ws[:-tail] if tail and "".join(ws[-tail:]) == trade and len(ws) > tail else ws)
            self.by_core[core].append((e, trade if len(core) < len("".join(ws)) else ""))
            self.cores.add(core)
        self.shortest = min((len(c) for c in self.by_core), default=1)
        self.longest = max((len(c) for c in self.by_core), default=1) + 3
        self.core_costs = lru_cache(maxsize=MEMORY)(self._core_costs)

    def _core_costs(self, token: str) -> dict[str, float]:
        found: dict[str, float] = {}
        forms = {token: 0.0}
        if token.endswith("s"):
            forms[token[:-1]] = 0.0
        for form in forms:
            if allowed(len(form)) == 0 and form not in self.by_core:
                continue
            for core in self.cores.near(form):
                most = min(allowed(len(core)), allowed(len(form)))
                cost = distance(form, core, most)
                if cost <= most:
                    found[core] = min(cost, found.get(core, 9.0))
        return found

    def _trade_cost(self, rest: list[str], trade: str) -> float | None:
        """What it costs to take the rest of the words for the trade, or None if they are not it."""
        text = "".join(rest)
        if not text:
            return 0.2
        if text == trade or text == trade + "s":
            return 0.0
        if shortens(text, trade):
            return 0.1
        if text in self.usual.trade_words.get(trade, ()):
            return 0.1
        cost = distance(text, trade, 2.0)
        return 0.1 + cost if cost <= min(2.0, allowed(len(trade)), allowed(len(text))) else None

    def _without_town(self, ws: list[str], towns: frozenset[str]) -> Iterator[list[str]]:
        yield ws
        for n in (1, 2, 3):
            if len(ws) > n and "".join(ws[-n:]) in towns:
                yield ws[: -n - (len(ws) > n + 1 and ws[-n - 1] == "of")]

    def resolve(self, value: str, hint: str | None = None, towns: frozenset[str] | None = None) -> Match | None:
        """The best match. `towns` are those of the value's tails that are towns; by default they are told by
        the towns given at first. Matches of whole words go before those in words run together."""
        best: tuple | None = None
        for form in self._without_town(business_words(value, self.usual), self.towns if towns is None else towns):
            for glued, cost, entry in self._candidates(form):
                rank = (glued, round(cost, 3), False, -entry.seen, entry.ref_id)
                best = min(best, rank) if best else rank
        return Match(best[-1], best[1], best) if best else None

    def _candidates(self, ws: list[str]) -> Iterator[tuple[bool, float, Entry]]:
        hit = False
        for i, token in enumerate(ws):
            for core, cost in self.core_costs(token).items():
                rest = ws[:i] + ws[i + 1 :]
                for entry, trade in self.by_core[core]:
                    more = self._trade_cost(rest, trade)
                    if more is not None:
                        hit = True
                        yield False, cost + more, entry
        if hit or not ws:
            return
        # words run together, or a core of several words: cut the squeezed text after every letter
        whole = "".join(ws)
        for text in {whole, whole[3:] if whole.startswith("the") else whole}:
            for n in range(max(1, self.shortest - 2), min(len(text), self.longest) + 1):
                for core, cost in self.core_costs(text[:n]).items():
                    for entry, trade in self.by_core[core]:
                        rest = text[n:]
                        more = self._trade_cost([rest] if rest else [], trade)
                        if more is not None and (rest or len(ws) > 1 or n == len(text)):
                            yield True, cost + more + 0.05, entry


def _town_parts(name: str) -> tuple[str, str, str]:
    ws = words(fold(name))
    before = after = ""
    if len(ws) > 1 and ws[0] in BEFORE:
        before, ws = ws[0], ws[1:]
    if len(ws) > 1 and ws[-1] in AFTER:
        after, ws = ws[-1], ws[:-1]
    return before, "".join(ws), after


class Towns:
    """Resolves names of towns. A town is told by the whole of its name: landform words are part of
    it, in full, in a short form or cut off. Towns of one name are told apart by the state."""

    def __init__(self, entries: list[Entry], states: frozenset[str] = frozenset()):
        self.forms = DeleteDictionary()
        self.by_form: dict[str, list[tuple[Entry, str, str, float]]] = defaultdict(list)
        for e in entries:
            before, core, after = _town_parts(e.name)
            heads = [(before, 0.0), *((s, 0.0) for s in BEFORE.get(before, ()))] if before else [("", 0.0)]
            tails = [(after, 0.0)] if after else [("", 0.0)]
            if after:
                cut = {after[:n] for n in range(1, len(after))}
                tails += [(s, 0.0) for s in AFTER[after]] + [(s, 0.1) for s in sorted(cut - set(AFTER[after]))] + [("", 0.3)]
            for head, _ in heads:
                for tail, cost in tails:
                    form = head + core + tail
                    self.by_form[form].append((e, before, after, cost))
                    self.forms.add(form)
        # of the whole list, where the entries are a block of it
        self.states = (states | frozenset((e.extra or "").lower() for e in entries)) - {""}
        self.long_before = {s: k for k, v in BEFORE.items() for s in (k, *v)}
        self.long_after = {s: k for k, v in AFTER.items() for s in (k, *v)}
        self.search = lru_cache(maxsize=MEMORY)(self._search)  # the same towns are typed over and over

    def names(self) -> frozenset[str]:
        return frozenset(self.by_form)

    def clean(self, value: str) -> tuple[list[str], str]:
        """The words of a typed town without postcode and state, and the state that was typed."""
        ws = words(fold(value).replace("'", ""))
        while len(ws) > 1 and ws[-1].isdigit():
            ws = ws[:-1]
        state = ""
        while len(ws) > 1 and ws[-1] in self.states:
            state, ws = ws[-1], ws[:-1]
        while len(ws) > 1 and ws[-1].isdigit():
            ws = ws[:-1]
        for lead in AROUND_TOWN:
            if len(ws) > len(lead) and tuple(ws[: len(lead)]) == lead:
                ws = ws[len(lead) :]
        return ws, state

    def _search(self, value: str, hint: str | None = None) -> list[tuple[float, Entry]]:
        """Every entry that the value may stand for, nearest first."""
        return [(rank[1], entry) for rank, entry in self.ranked(value, hint)]

    def ranked(self, value: str, hint: str | None = None) -> list[tuple[tuple, Entry]]:
        """(rank, entry), best first. Forms that are spelled exactly go before all others."""
        ws, typed = self.clean(value)
        state = (hint or "").strip().lower() or typed
        text = "".join(ws)
        if not text:
            return []
        head = self.long_before.get(ws[0], "") if len(ws) > 1 else ""
        tail = self.long_after.get(ws[-1], "") if len(ws) > 1 else ""
        found: dict[int, tuple[float, Entry]] = {}
        exact = text in self.by_form
        for form in {text} if exact else self.forms.near(text):
            most = min(allowed(len(form)), allowed(len(text)))
            cost = distance(text, form, most)
            if cost > most:
                continue
            for entry, before, after, more in self.by_form[form]:
                if (head and head != before) or (tail and tail != after):
                    continue
                if more and cost and text[-1:] != form[-1:]:
                    continue
                total = cost + more + (0.35 if state and (entry.extra or "").lower() != state else 0.0)
                if entry.ref_id not in found or total < found[entry.ref_id][0]:
                    found[entry.ref_id] = (total, entry)
        ranks = [((not exact, round(cost, 3), (entry.extra or "").lower() != state, -entry.seen, entry.ref_id), entry) for cost, entry in found.values()]
        return sorted(ranks, key=lambda x: x[0])

    def resolve(self, value: str, hint: str | None = None, towns: frozenset[str] | None = None) -> Match | None:
        ranks = self.ranked(value, hint)
        return Match(ranks[0][1].ref_id, ranks[0][0][1], ranks[0][0]) if ranks else None


@dataclass(frozen=True)
class Field:
    """A typed column, the reference list that it is mapped to and the column that decides ties."""

    column: str
    ref_id: str
    ref_name: str
    ref_extra: str
    hint: str | None = None
    kind: str = "business"


MERCHANT = Field("merchant_name", "merchant_id", "canonical_name", "trade")
CITY = Field("city", "city_id", "canonical_city", "state", hint="state", kind="town")


def _resolver(kind: str, entries: list[Entry], states: frozenset[str], usual: Conventions) -> Businesses | Towns:
    return Towns(entries, states) if kind == "town" else Businesses(entries, usual=usual)


def typed_values(df: DataFrame, key: str, fields: list[Field]) -> DataFrame:
    """(key, field_name, value, hint) of every value that is neither NULL nor blank. NULL hints are ''."""
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(f.column).alias("field_name"), F.col(f.column).cast("string").alias("value"), F.coalesce(F.col(f.hint).cast("string"), F.lit("")).alias("hint") if f.hint else F.lit("").alias("hint"))
                for f in fields
            ]
        )
    )
    return df.select(F.col(key).alias("_key"), cells.alias("_c")).select("_key", "_c.*").filter(F.col("value").rlike(r"(?U)\S"))


def _town_tails(values: DataFrame, towns: list[DataFrame], usual: Conventions) -> DataFrame:
    """Adds _towns: those of the tails of a business that are the name of a town in any form. The forms are
    made where the lists are and joined; no list is gathered."""
    if not towns:
        return values.withColumn("_towns", F.array().cast("array<string>"))

    def forms_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"form": [form for i, n, e in zip(f["ref_id"], f["name"], f["extra"]) for form in Towns([Entry(i, n, e)]).names()]})

    forms = None
    for t in towns:
        one = t.select("ref_id", "name", "extra").mapInPandas(forms_of, "form string")
        forms = one if forms is None else forms.unionByName(one)
    ends = F.pandas_udf(lambda s: pd.Series([tails(v, usual) for v in s]), "array<string>")
    tailed = values.filter("_kind <> 'town'").select("field_name", "value", "hint", F.explode(ends("value")).alias("form"))
    told = tailed.join(sized_broadcast(cut(forms.distinct())), "form").groupBy("field_name", "value", "hint").agg(F.collect_list("form").alias("_towns"))  # three at most
    return values.join(told, ["field_name", "value", "hint"], "left").withColumn("_towns", F.coalesce("_towns", F.array().cast("array<string>")))


def resolved(values: DataFrame, lists: list[tuple[Field, DataFrame]], block: int, usual: Conventions) -> DataFrame:
    """(field_name, value, hint, ref_id, cost) of distinct values, sought in every block of their list
    (ref_id, name, extra, seen). At any time one block is held on the driver and by the workers."""
    spark = values.sparkSession
    ranks = {"_glued": "boolean", "_cost": "double", "_off": "boolean", "_seen": "bigint", "_ref": "bigint"}  # as Match.rank
    blank = {"_found": F.lit(False), **{n: F.lit(0).cast(t) for n, t in ranks.items()}}
    out = values.select("field_name", "value", "hint", "_kind", "_towns", *[c.alias(n) for n, c in blank.items()])
    schema = "field_name string, value string, hint string, _kind string, _towns array<string>, _found boolean, " + ", ".join(f"{n} {t}" for n, t in ranks.items())
    for field_, listed in lists:
        blocks = max(1, -(-listed.count() // block))
        part = F.pmod(F.xxhash64("ref_id"), F.lit(blocks))
        states = frozenset(r.extra.lower() for r in bounded_rows(listed.filter("extra is not null").select("extra").distinct(), MOST_STATES, "the states of the towns")) if field_.kind == "town" else frozenset()
        for b in range(blocks):
            rows = bounded_rows(listed.filter(part == b), 2 * block + 100, f"a block of the reference list of {field_.column}")
            entries = sorted((Entry(r.ref_id, r.name, r.extra, r.seen) for r in rows), key=lambda e: e.ref_id)
            shared = spark.sparkContext.broadcast((field_.column, field_.kind, entries, states, usual))

            def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                column, resolver = _shared_resolver(shared)
                for f in frames:
                    best = []
                    for name, value, hint, towns, found_, *old in zip(f["field_name"], f["value"], f["hint"], f["_towns"], f["_found"], *(f[n] for n in ranks)):
                        hit = resolver.resolve(value, hint, frozenset(towns)) if name == column else None
                        known = [r for r in (tuple(old) if found_ else None, hit.rank if hit else None) if r is not None]
                        best.append((True, *min(known)) if known else (False, False, 0.0, False, 0, 0))
                    done = pd.DataFrame(best, columns=["_found", *ranks], index=f.index)
                    yield pd.concat([f[["field_name", "value", "hint", "_kind", "_towns"]], done], axis=1)

            out = out.mapInPandas(run, schema)
    return out.select("field_name", "value", "hint", F.when(F.col("_found"), F.col("_ref")).otherwise(F.lit(0).cast("long")).alias("ref_id"), F.when(F.col("_found"), F.col("_cost")).alias("cost"))


_MADE: dict[int, tuple] = {}


def _shared_resolver(shared) -> tuple[str, Businesses | Towns]:
    """The dictionary of a broadcast block, made once per worker process."""
    key = id(shared.value)
    if key not in _MADE:
        if len(_MADE) > 1:  # no more than two blocks at a time
            _MADE.clear()
        column, kind, entries, states, usual = shared.value
        _MADE[key] = (shared.value, column, _resolver(kind, entries, states, usual))
    return _MADE[key][1:]


def map_to_list(df: DataFrame, key: str, fields: list[tuple[Field, DataFrame]], block: int | None = None, usual: Conventions = USUAL) -> DataFrame:
    """Every typed value that is not spelled exactly as an entry, with the entry that it stands for:
    (key, field_name, value, hint, ref_id, cost), ref_id 0 where it stands for none.

    NULL and blank values are left out, as are values spelled exactly; a row whose key is NULL keeps
    that key. Repeated rows give repeated results (found() keeps one). Ties go to the entry spelled
    exactly most often in df, then to the smaller id. Very long values cost no more than their edits
    allow: beyond two edits nothing is computed. With an empty reference list every value is a miss;
    an empty table gives no rows. Only key, value and hint columns are read, so other columns of df,
    of whatever name, do not matter.
    """
    values = typed_values(df, key, [f for f, _ in fields])
    slims, lists = [], []
    exact = None
    for field_, ref in fields:
        slim = ref.select(F.col(field_.ref_id).cast("long").alias("ref_id"), F.col(field_.ref_name).alias("name"), F.col(field_.ref_extra).alias("extra")).filter(F.col("ref_id").isNotNull() & F.col("name").isNotNull())
        names = slim.select(F.lit(field_.column).alias("field_name"), F.col("name").alias("value")).distinct()
        slims.append((field_, slim))
        exact = names if exact is None else exact.unionByName(names)
    exact = sized_broadcast(exact)
    # counts combine before they are shuffled: distinct values, of which those spelled exactly only give ranks
    distinct = cut(values.groupBy("field_name", "value", "hint").agg(F.count(F.lit(1)).alias("_n")).join(exact.withColumn("_exact", F.lit(True)), ["field_name", "value"], "left"))
    for field_, slim in slims:
        seen = distinct.filter(F.col("_exact") & (F.col("field_name") == field_.column)).groupBy(F.col("value").alias("name")).agg(F.sum("_n").alias("seen"))
        lists.append((field_, cut(slim.join(seen, "name", "left").select("ref_id", "name", "extra", F.coalesce("seen", F.lit(0)).alias("seen")))))
    kinds = F.create_map(*[F.lit(x) for f, _ in fields for x in (f.column, f.kind)])
    asked = distinct.filter("_exact is null").select("field_name", "value", "hint", F.element_at(kinds, F.col("field_name")).alias("_kind"))
    asked = _town_tails(asked, [t for f, t in slims if f.kind == "town"], usual)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mapped = cut(resolved(asked.repartition(n, "value"), lists, block or BLOCK_ENTRIES, usual))
    return _joined_back(values.join(exact, ["field_name", "value"], "left_anti"), mapped, distinct).select(F.col("_key").alias(key), "field_name", "value", "hint", "ref_id", "cost")


def _joined_back(rows: DataFrame, mapped: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows with what their values stand for: by broadcast if that is of a bounded size, or else by a
    shuffle, from which values that very many rows hold are kept out (at most HEAVY_SHARE of them)."""
    on = ["field_name", "value", "hint"]
    hinted = sized_broadcast(mapped, MAPPED_ROWS)
    if hinted is not mapped:
        return rows.join(hinted, on)
    total = counts.agg(F.sum("_n")).scalar()
    heavy = F.broadcast(counts.filter(F.col("_n") * HEAVY_SHARE > total).select(*on))
    often = rows.join(F.broadcast(mapped.join(heavy, on, "left_semi")), on)
    return often.unionByName(rows.join(heavy, on, "left_anti").join(mapped, on))


def found(df: DataFrame, key: str, fields: list[tuple[Field, DataFrame]]) -> DataFrame:
    """One row per key and field: (key, field_name, ref_id). Where the rows of one key disagree, the
    smallest entry that any of them stands for is kept."""
    mapped = map_to_list(df, key, fields)
    return mapped.groupBy(key, "field_name").agg(F.coalesce(F.min(F.when(F.col("ref_id") > 0, F.col("ref_id"))), F.lit(0)).cast("long").alias("ref_id"))


def misses(df: DataFrame, key: str, fields: list[tuple[Field, DataFrame]]) -> DataFrame:
    """The values that stand for no entry, with the number of rows that hold each."""
    return map_to_list(df, key, fields).filter(F.col("ref_id") == 0).groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n_rows"))
