"""Comparing names of businesses that no list holds."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

from .canonical import ARTICLES, LEGAL_FORMS, PAYMENT_MARKS, TRADE_WORDS
from .textkit import allowed, distance, fold, shortens, words


@lru_cache(maxsize=200_000)
def name_words(name: str) -> tuple[str, ...]:
    """The words of a name without article, possessive, legal form, shop number and web address parts."""
    text = re.sub(r"^\s*(https?://)?(www\.)?", "", fold(name))
    text = re.sub(r"^\s*[\w-]{1,8}\s*\*", " ", re.sub(r"#\s*\w+", " ", text))
    first = text.split(None, 1)
    text = first[1] if len(first) > 1 and first[0] in PAYMENT_MARKS else text
    ws = words(re.sub(r"'s?\b", " ", text))
    ws = [w for i, w in enumerate(ws) if i == 0 or w != "s"]  # a possessive whose apostrophe is lost
    while len(ws) > 1 and ws[0] in PAYMENT_MARKS:
        ws = ws[1:]
    while len(ws) > 1 and (ws[-1] in LEGAL_FORMS or ws[-1].isdigit()):
        ws = ws[:-1]
    ws = [w for w in ws if w not in ARTICLES] or ws
    return tuple(ws)


def near(a: str, b: str) -> bool:
    """Within the edits that two typed spellings of one name may be apart: both may be misspelt."""
    shorter = min(len(a), len(b))
    most = 2.6 if shorter >= 8 else allowed(shorter)
    return a == b or (most > 0 and distance(a, b, most) <= most)


@lru_cache(maxsize=200_000)
def trades_agree(a: str, b: str, trades: tuple[str, ...] = ()) -> bool:
    """Whether two words for a trade mean the same: one shortens the other, or both shorten one of the
    known trades."""
    if any((a == t or shortens(a, t)) and (b == t or shortens(b, t)) for t in trades):
        return True
    if a == b or shortens(a, b) or shortens(b, a) or near(a, b):
        return True
    return any((x in TRADE_WORDS.get(y, ())) or shortens(x, y) for x, y in ((a, b), (b, a)))


@lru_cache(maxsize=200_000)
def is_trade(word: str, trades: tuple[str, ...]) -> bool:
    """Whether a word is a trade of the list, or is short for one."""
    return any(word == t or (len(word) > 2 and shortens(word, t)) for t in trades)


@lru_cache(maxsize=200_000)
def likeness(a: str, b: str) -> int:
    """1 for two spellings of one telling word, 0 where they may be, -1 where they are too far apart."""
    if near(a, b) or (a.endswith("s") and near(a[:-1], b)) or (b.endswith("s") and near(a, b[:-1])):
        return 1
    most = min(3.0, 0.42 * max(len(a), len(b)))
    return 0 if min(len(a), len(b)) >= 4 and distance(a, b, most) <= most else -1


@lru_cache(maxsize=200_000)
def compare(a: str, b: str, trades: tuple[str, ...] = ()) -> tuple[int, int]:
    """(core, trade), each 1 for agreeing, -1 for differing, 0 for one of them left out, or for cores that
    may be misspelt. The core is the word that tells a business from others; the rest is its trade."""
    wa, wb = name_words(a), name_words(b)
    if not wa or not wb:
        return 0, 0
    sa, sb = "".join(wa), "".join(wb)
    if sa == sb or (min(len(sa), len(sb)) >= 8 and near(sa, sb)):
        return 1, 1
    best = (-1, -1)
    for x, rest_x in _cores(wa, trades):
        for y, rest_y in _cores(wb, trades):
            trade = 0 if not rest_x or not rest_y else 1 if trades_agree(rest_x, rest_y, trades) else -1
            best = max(best, (likeness(x, y), trade))
    if best[0] == 1:
        return best
    # words run together in one of the names
    for one, other in ((wa, wb), (wb, wa)):
        if len(one) == 1:
            glued = one[0][3:] if one[0].startswith("the") else one[0]
            for core, rest in _cores(other, trades):
                for n in range(max(4, len(core) - 2), min(len(glued), len(core) + 2) + 1):
                    if near(glued[:n], core):
                        tail = glued[n:]
                        tail = tail[1:] if tail[:1] == "s" and not (tail == rest or shortens(tail, rest)) else tail
                        best = max(best, (1, 0 if not tail or not rest else 1 if trades_agree(tail, rest, trades) else -1))
    return best


def _cores(ws: tuple[str, ...], trades: tuple[str, ...]) -> list[tuple[str, str]]:
    """The words that may be the core, with the rest: the first one, and the last one, as names are
    also written the other way round; a trade is no core where there is another word."""
    out = [(ws[0], "".join(ws[1:]))]
    if len(ws) > 1:
        out.append((ws[-1], "".join(ws[:-1])))
    return [x for x in out if not is_trade(x[0], trades)] or out


def core_of(name: str) -> str:
    ws = name_words(name)
    return ws[0] if ws else ""


def letters(a: str, b: str) -> float:
    """The share of the letters of two names, with their numbers, that they have in common."""
    common = sum((Counter(a) & Counter(b)).values())
    return 2 * common / max(1, len(a) + len(b))
