"""Splitting oversized texts at natural boundaries (problem 10) by recursive bisection.

A text above the limit is cut at the strongest boundary near its midpoint: a paragraph break before a
line break before the end of a sentence before a clause before a blank before any token. Halves that
still exceed the limit less the overlap are cut again, and at last every piece but the first is given
the last tokens of the one before. A text has at least as many bytes as tokens, so that short texts
are passed by without being tokenized.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import DEFAULT_VOCABULARY, encoder

LIMIT, OVERLAP = 2_000, 100
_BLANKS = re.compile(r"\s+|(?<=[。！？])")
_CLOSERS = "\"')]}»”’"


def _starts(text: str, ids: list[int], single) -> np.ndarray:
    """The character at which each token starts, and len(text) at last; -1 inside a character."""
    length = {i: len(single(i)) for i in set(ids)}
    sizes = np.fromiter((length[i] for i in ids), dtype=np.int64, count=len(ids))
    at = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    begins = (raw & 0xC0) != 0x80
    order = np.cumsum(begins) - 1
    out = np.full(len(at), -1, dtype=np.int64)
    inner = at < len(raw)
    good = inner.copy()
    good[inner] = begins[at[inner]]
    out[good] = order[at[good]]
    out[~inner] = len(text)
    return out


def _strengths(text: str, starts: np.ndarray) -> np.ndarray:
    """The strength of a cut before each token: 5 paragraph, 4 line, 3 sentence, 2 clause, 1 blank, 0
    any token, -1 none (inside a character)."""
    out = np.where(starts >= 0, 0, -1)
    valid = np.flatnonzero(starts >= 0)
    places = starts[valid]
    spans: list[tuple[int, int]] = []
    marks: list[int] = []
    for m in _BLANKS.finditer(text):
        a, b = m.span()
        if b - a == 1 and text[a] == " ":
            lines = 0
        else:
            lines = text.count("\n", a, b)
        k = a - 1
        while k > 0 and text[k] in _CLOSERS:
            k -= 1
        before = text[k] if k >= 0 else " "
        spans.append((a, b))
        marks.append(5 if lines > 1 else 4 if lines else 3 if before in ".!?。！？" else 2 if before in ",;:" else 1)
    if spans:
        ends = np.array(spans)
        lo, hi = np.searchsorted(places, ends[:, 0], "left"), np.searchsorted(places, ends[:, 1], "right")
        many = hi - lo
        first = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        np.maximum.at(out, valid[first], np.repeat(np.array(marks), many))
    return out


def _bisect(strength: np.ndarray, lo: int, hi: int, cap: int) -> list[tuple[int, int]]:
    """Ranges of at most cap tokens, by repeated cuts at the strongest boundary of the middle half."""
    done, todo = [], [(lo, hi)]
    while todo:
        a, b = todo.pop()
        if b - a <= cap:
            done.append((a, b))
            continue
        cut = _cut(strength, a, b)
        if cut is None:
            done.append((a, b))
            continue
        todo += [(cut, b), (a, cut)]
    return done


def _cut(strength: np.ndarray, a: int, b: int) -> int | None:
    middle, quarter = (a + b) // 2, (b - a) // 4
    for lo, hi in ((a + max(1, quarter), b - max(1, quarter) + 1), (a + 1, b)):
        part = strength[lo:hi]
        if len(part) and part.max() >= 0:
            best = np.flatnonzero(part == part.max()) + lo
            return int(best[np.argmin(np.abs(best - middle))])
    return None


def split_text(text: str, encoding, limit: int, overlap: int) -> tuple[int, list[tuple[int, int, int, int]]]:
    """The number of tokens of the text, and (start of the piece, start of its own part, end, tokens)
    in characters for each piece. Own parts laid end to end give the text."""
    ids = encoding.encode_ordinary(text)
    if len(ids) <= limit:
        return len(ids), [(0, 0, len(text), len(ids))]
    starts = _starts(text, ids, encoding.decode_single_token_bytes)
    strength = _strengths(text, starts)
    todo = _bisect(strength, 0, len(ids), limit - overlap)
    out: list[tuple[int, int, int, int]] = []
    todo.reverse()
    while todo:
        a, b = todo.pop()
        start = max(0, a - overlap)
        while starts[start] < 0:
            start += 1
        piece = text[starts[start] : starts[b]]
        n = len(encoding.encode_ordinary(piece))
        if n > limit and b - a > 1 and (cut := _cut(strength, a, b)) is not None:
            todo += [(cut, b), (a, cut)]  # cut off from its context the piece takes more tokens
            continue
        out.append((int(starts[start]), int(starts[a]), int(starts[b]), n))
    return len(ids), out


def pieces(docs: DataFrame, doc: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = DEFAULT_VOCABULARY, whole: bool = False) -> DataFrame:
    """(doc, doc_tokens, n_pieces, piece_no, start_char, own_char, end_char, n_tokens, piece) for every
    piece of every text of more than `limit` tokens, pieces numbered from 1.

    NULL and empty texts give no rows. Texts within the limit need no cutting and give none either,
    unless `whole` asks for them: then they are one piece each. Each piece
    but the first begins with the last `overlap` tokens of the part before it (fewer by at most three
    where those would begin inside a character). Texts without any boundary are cut between tokens,
    never inside a character. Repeated rows are cut alike; texts are read whole. Other columns are not
    read; an empty table gives no rows.
    """
    if overlap < 0 or limit < 32 or overlap * 5 > limit:
        raise ValueError("limit must be 32 tokens or more and the overlap at most a fifth of it")
    kind = dict(docs.dtypes)[doc]
    long_enough = docs.select(F.col(doc).alias("_d"), F.col(text).cast("string").alias("_t")).filter(F.octet_length("_t") > (0 if whole else limit))
    schema = f"`_d` {kind}, doc_tokens bigint, n_pieces bigint, piece_no bigint, start_char bigint, own_char bigint, end_char bigint, n_tokens bigint, piece string"
    names = [c.split()[0].strip("`") for c in schema.split(", ")]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = encoder(vocabulary)
        for frame in frames:
            rows = []
            for d, t in zip(frame["_d"], frame["_t"]):
                total, parts = split_text(t, encoding, limit, overlap)
                if whole or total > limit:
                    rows += [(d, total, len(parts), k, s, o, e, n, t[s:e]) for k, (s, o, e, n) in enumerate(parts, 1)]
            yield pd.DataFrame(rows, columns=names)

    return long_enough.mapInPandas(cut, schema).withColumnRenamed("_d", doc)


def oversized(docs: DataFrame, doc: str = "doc_id", **how) -> DataFrame:
    """The documents that had to be cut."""
    return pieces(docs, doc, **how).filter("n_pieces > 1").select(doc).distinct()
