"""Evaluation passages inside training texts (problem 8).

The n-grams of normalised words of all items form a hash set that is broadcast; every text is scanned
once, window by window. A window can hit only where so many words running belong to the items'
vocabulary, so that most windows are passed over without hashing. Hits are verified word by word (the
set holds the words, not hashes of them) and joined to the longest passages.

The items are a test set, small by nature; larger ones are taken in blocks of bounded size. All blocks
are sought in one scan of the texts, and what they find in a text is put together before anything is
reported or cut, so that the rows do not depend on the size of a block.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_rows

WORDS = 10
#: Characters of items in one broadcast set, and the most items of it.
BLOCK_CHARS, BLOCK_ITEMS = 16_000_000, 200_000
_WORD = re.compile(r"[^\W_]+")


def normal_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(items: list[tuple], n: int) -> tuple[dict[str, int], dict[tuple, tuple]]:
    """The vocabulary of the items that have n words, and the ids of the items that hold each n-gram."""
    vocabulary: dict[str, int] = {}
    grams: dict[tuple, set] = {}
    for item, text in items:
        ws = normal_words(text or "")
        if len(ws) < n:
            continue
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in ws]
        for i in range(len(ids) - n + 1):
            grams.setdefault(tuple(ids[i : i + n]), set()).add(item)
    return vocabulary, {g: tuple(sorted(s)) for g, s in grams.items()}


def windows(text: str, vocabulary: dict[str, int], grams: dict[tuple, tuple], n: int) -> list[tuple[int, tuple]]:
    """(index of its first word, items) of every window of n words that is an n-gram of an item."""
    get = vocabulary.get
    ids = [get(w, -1) for w in normal_words(text)]
    out = []
    run = 0
    for i, x in enumerate(ids):
        run = run + 1 if x >= 0 else 0
        if run >= n:
            hit = grams.get(tuple(ids[i - n + 1 : i + 1]))
            if hit:
                out.append((i - n + 1, hit))
    return out


def passages(hits: list[tuple[int, tuple]], n: int) -> dict:
    """For each item the (first word, words) of its passages: windows that touch are one passage."""
    out: dict = {}
    for i, items in hits:
        for item in items:
            runs = out.setdefault(item, [])
            if runs and i <= runs[-1][0] + runs[-1][1] - n + 1:
                runs[-1][1] = i + n - runs[-1][0]
            else:
                runs.append([i, n])
    return out


def without(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the words of the (first word, words) spans and what stands between them, the number
    of spans after those that touch or overlap became one, and the characters removed."""
    at = [(m.start(), m.end()) for m in _WORD.finditer(text.lower() if len(text.lower()) == len(text) else text)]
    merged: list[list[int]] = []
    for first, size in sorted(spans):
        if merged and first <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], first + size)
        else:
            merged.append([first, first + size])
    left, last = [], 0
    for first, end in merged:
        left.append(text[last : at[first][0]])
        last = at[end - 1][1]
    left.append(text[last:])
    out = "".join(left)
    return out, len(merged), len(text) - len(out)


def _blocks(items: DataFrame, item: str, text: str) -> tuple[int, Callable[[int], list[tuple]]]:
    """The number of blocks of the items, and what gathers one of them: all texts of an item are in one."""
    slim = items.select(F.col(item).alias("i"), F.col(text).alias("t")).filter(F.col("i").isNotNull() & F.col("t").isNotNull())
    size = slim.agg(F.sum(F.length("t")).alias("c"), F.count(F.lit(1)).alias("n")).first()
    parts = max(1, -(-(size.c or 0) // BLOCK_CHARS), -(-size.n // BLOCK_ITEMS))

    def gather(b: int) -> list[tuple]:
        share = slim.filter(F.pmod(F.xxhash64("i"), F.lit(parts)) == b) if parts > 1 else slim
        return [(r.i, r.t) for r in bounded_rows(share, 2 * BLOCK_ITEMS, "a block of the items")]

    return parts, gather


def leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = WORDS) -> DataFrame:
    """(doc, item, n_passages, longest, first_word): every document that holds n or more words running
    of an item, with the number of such passages, the length in words of the longest and where the first
    begins.

    Words are runs of letters or digits in lower case; what stands between them does not count. NULL
    and empty texts hold nothing; items of fewer than n words cannot leak; repeated documents are
    reported once per row, repeated items once. Texts are read whole, whatever their length. Empty
    tables give no rows, and other columns are not read.
    """
    kind_d, kind_i = dict(docs.dtypes)[doc], dict(items.dtypes)[item]
    kinds = f"`_d` {kind_d}, _i array<{kind_i}>, _n array<bigint>"  # of each item found three numbers
    out = docs.select(F.col(doc).alias("_d"), F.array().cast(f"array<{kind_i}>").alias("_i"), F.array().cast("array<bigint>").alias("_n"), F.col(text).alias("_t")).filter(F.col("_t").isNotNull())
    blocks, gather = _blocks(items, item, item_text)
    for block in range(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(grams_of(gather(block), n))

        def scan(frames: Iterator[pd.DataFrame], shared=shared, final=block == blocks - 1) -> Iterator[pd.DataFrame]:
            vocabulary, grams = shared.value
            for frame in frames:
                rows = []
                for d, i, k, t in zip(frame["_d"], frame["_i"], frame["_n"], frame["_t"]):
                    hits = passages(windows(t, vocabulary, grams, n), n)
                    if hits:
                        i, k = [*i, *hits], [*k, *(x for r in hits.values() for x in (len(r), max(y[1] for y in r), r[0][0]))]
                    if not final:
                        rows.append((d, i, k, t))
                    elif len(i):
                        rows.append((d, i, k))  # the text is needed no more
                yield pd.DataFrame(rows, columns=["_d", "_i", "_n", "_t"][: 4 - final])

        out = out.mapInPandas(scan, kinds if block == blocks - 1 else f"{kinds}, _t string")
    each = out.select("_d", "_n", F.posexplode("_i").alias("_p", "_i"))
    number = lambda k: F.get("_n", 3 * F.col("_p") + k)
    return each.select(F.col("_d").alias(doc), F.col("_i").alias(item), number(0).alias("n_passages"), number(1).alias("longest"), number(2).alias("first_word"))


def leaked_items(docs: DataFrame, items: DataFrame, item: str = "item_id", **how) -> DataFrame:
    """(item, n_docs, longest) of the items that leaked."""
    return leaks(docs, items, item=item, **how).groupBy(item).agg(F.count(F.lit(1)).alias("n_docs"), F.max("longest").alias("longest"))


def cleaned(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = WORDS) -> DataFrame:
    """All documents with the leaked passages cut out: (doc, text, n_spans, n_cut), n_cut being the
    characters removed. NULL texts stay NULL; documents without a leak are unchanged."""
    kind = dict(docs.dtypes)[doc]
    out = docs.select(F.col(doc).alias("_d"), F.col(text).alias("_t"), F.array().cast("array<bigint>").alias("_f"))
    blocks, gather = _blocks(items, item, item_text)
    for block in range(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(grams_of(gather(block), n))

        def scan(frames: Iterator[pd.DataFrame], shared=shared, final=block == blocks - 1) -> Iterator[pd.DataFrame]:
            vocabulary, grams = shared.value
            for frame in frames:
                rows = []
                for d, t, f in zip(frame["_d"], frame["_t"], frame["_f"]):
                    hits = windows(t, vocabulary, grams, n) if t else []
                    if hits:
                        f = [*f, *(x for span in passages([(i, (0,)) for i, _ in hits], n)[0] for x in span)]
                    if not final:
                        rows.append((d, t, f))
                    else:
                        rows.append((d, *(without(t, list(zip(f[::2], f[1::2]))) if len(f) else (t, 0, 0))))
                yield pd.DataFrame(rows, columns=["_d", "_t", "n_spans", "n_cut"] if final else ["_d", "_t", "_f"])

        out = out.mapInPandas(scan, f"`_d` {kind}, `_t` string, " + ("n_spans bigint, n_cut bigint" if block == blocks - 1 else "_f array<bigint>"))
    return out.select(F.col("_d").alias(doc), F.col("_t").alias(text), "n_spans", "n_cut")
