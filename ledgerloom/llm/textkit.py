"""Text folding, weighted Damerau-Levenshtein distance and symmetric-delete dictionaries."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np

#: Pairs that are often mistaken for one another when typed or scanned.
LOOKALIKES = {frozenset(p) for p in ("0o", "1i", "1l", "il", "5s", "3e", "8b", "6g", "2z", "9g")}
VOWELS = frozenset("aeiouy")
_WORD = re.compile(r"[a-z0-9]+")


@lru_cache(maxsize=200_000)
def fold(text: str) -> str:
    """Lower case without diacritics; typographic quotes and dashes become ASCII."""
    if text.isascii():
        return text.lower()
    flat = unicodedata.normalize("NFKD", text.casefold())
    return "".join(c for c in flat if not unicodedata.combining(c)).replace("’", "'").replace("‘", "'").replace("–", "-").replace("—", "-")


def words(text: str) -> list[str]:
    return _WORD.findall(text)


def swap_cost(a: str, b: str) -> float:
    if a == b:
        return 0.0
    if frozenset((a, b)) in LOOKALIKES:
        return 0.3
    return 0.8 if a in VOWELS and b in VOWELS else 1.0


def _costs() -> dict[str, dict[str, float]]:
    """For each character the others that it is exchanged for at less than 1."""
    known = "abcdefghijklmnopqrstuvwxyz0123456789"
    return {x: {y: c for y in known if (c := swap_cost(x, y)) < 1.0} for x in known}


_CHEAP = _costs()
#: One letter for each group of look-alikes, so that exchanging them changes no bag of letters.
_GROUPS = str.maketrans("01l5386927", "oiisebggz7")


@lru_cache(maxsize=200_000)
def letter_mask(text: str) -> int:
    """The letters of a text, look-alikes taken as one, as bits; letters that no text of ours has share one."""
    mask = 0
    for c in text.translate(_GROUPS):
        n = ord(c) - 97
        mask |= 1 << (n if 0 <= n < 26 else 26 + n % 64)
    return mask


def distance(a: str, b: str, most: float = 3.0) -> float:
    """Weighted Damerau-Levenshtein distance (adjacent transpositions), or a value above `most` as
    soon as no alignment can stay within it. Look-alike characters cost 0.3, a vowel for a vowel 0.8,
    a transposition 0.8, doubling or undoubling a letter 0.6, every other edit 1. Letters that changed
    places may have got another one between them.

    A letter that only one of the texts has costs 0.6 at least, as does every step away from the
    diagonal, so that cells further away than `most` allows are not looked at."""
    if a == b:
        return 0.0
    la, lb = len(a), len(b)
    if abs(la - lb) * 0.6 > most:
        return most + 1
    ma, mb = letter_mask(a), letter_mask(b)
    if ma != mb and max((ma & ~mb).bit_count(), (mb & ~ma).bit_count()) * 0.6 > most + 1e-6:
        return most + 1
    inf = float("inf")
    wide = int(most / 0.6 + 1e-6) + 1
    earlier: list[float] = []
    before: list[float] = []
    row = [0.0]
    for j in range(1, lb + 1):
        row.append(row[-1] + (0.6 if j > 1 and b[j - 1] == b[j - 2] else 1.0))
    adds = [1.0] + [0.6 if j and b[j] == b[j - 1] else 1.0 for j in range(lb)]
    low_row = low_before = 0.0
    w = ""
    for i in range(1, la + 1):
        v, w, x = (a[i - 3] if i > 2 else ""), (a[i - 2] if i > 1 else ""), a[i - 1]
        drop = 0.6 if x == w else 1.0
        cheap = _CHEAP.get(x) or {x: 0.0}
        first, last = max(1, i - wide), min(lb, i + wide)
        new = [inf] * (lb + 1)
        if first == 1:
            new[0] = row[0] + drop
        left = low = new[first - 1]
        for j in range(first, last + 1):
            y = b[j - 1]
            c = row[j - 1] + cheap.get(y, 1.0)
            if (d := row[j] + drop) < c:
                c = d
            if (d := left + adds[j]) < c:
                c = d
            if x != y:
                if i > 1:
                    if j > 1 and w == y and x == b[j - 2] and (d := before[j - 2] + 0.8) < c:
                        c = d
                    if j > 2 and w == y and x == b[j - 3] and (d := before[j - 3] + 1.8) < c:
                        c = d
                if i > 2 and j > 1 and v == y and x == b[j - 2] and (d := earlier[j - 2] + 1.8) < c:
                    c = d
            new[j] = left = c
            if c < low:
                low = c
        if low > most and low_row > most and low_before > most:
            return most + 1
        low_before, low_row = low_row, low
        earlier, before, row = before, row, new
    return row[-1] if row[-1] < inf else most + 1


def bags(texts: list[str]) -> np.ndarray:
    """How often each text has each letter, look-alikes taken as one. A letter that one of two texts has more often than
    the other costs 0.6 at least."""
    places: dict[str, int] = {}
    counted = [Counter(places.setdefault(c, len(places)) for c in t.translate(_GROUPS)) for t in texts]
    out = np.zeros((len(texts), max(len(places), 1)), dtype=np.int16)
    for row, letters in zip(out, counted):
        for c, n in letters.items():
            row[c] = n
    return out


def distances(pairs: list[tuple[str, str]], at_once: int = 4096) -> np.ndarray:
    """distance() of many pairs, in full, by one pass over the cells of all of them."""
    out = np.zeros(len(pairs))
    order = sorted(range(len(pairs)), key=lambda p: (max(map(len, pairs[p])), len(pairs[p][0])))
    for start in range(0, len(order), at_once):
        part = order[start : start + at_once]
        out[part] = _distances([pairs[p] for p in part])
    return out


def _distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    chars = {c: n for n, c in enumerate(sorted(set("".join(map("".join, pairs)))), 1)}
    swaps = np.ones((len(chars) + 1, len(chars) + 1))
    for x, i in chars.items():
        for y, j in chars.items():
            swaps[i, j] = swap_cost(x, y)
    la, lb = (np.array([len(p[s]) for p in pairs]) for s in (0, 1))
    a, b = (np.zeros((max(n.max(), 1), len(pairs)), dtype=np.intp) for n in (la, lb))
    for k, (x, y) in enumerate(pairs):
        a[: len(x), k] = [chars[c] for c in x]
        b[: len(y), k] = [chars[c] for c in y]
    doubled = lambda t: np.concatenate([np.ones((1, len(pairs))), np.where(t[1:] == t[:-1], 0.6, 1.0)])
    drops, adds = doubled(a), doubled(b)
    out = np.zeros(len(pairs))
    rows = [np.concatenate([np.zeros((1, len(pairs))), np.cumsum(adds, axis=0)])]
    out[la == 0] = rows[0][lb, np.arange(len(pairs))][la == 0]
    for i in range(1, la.max(initial=0) + 1):
        x, row = a[i - 1], rows[-1]
        new = np.empty_like(row)
        new[0] = row[0] + drops[i - 1]
        for j in range(1, len(row)):
            y = b[j - 1]
            c = np.minimum(np.minimum(row[j - 1] + swaps[x, y], row[j] + drops[i - 1]), new[j - 1] + adds[j - 1])
            apart = x != y
            if i > 1 and j > 1:
                turned = apart & (a[i - 2] == y)
                np.minimum(c, rows[-2][j - 2] + 0.8, out=c, where=turned & (x == b[j - 2]))
                if j > 2:
                    np.minimum(c, rows[-2][j - 3] + 1.8, out=c, where=turned & (x == b[j - 3]))
            if i > 2 and j > 1:
                np.minimum(c, rows[-3][j - 2] + 1.8, out=c, where=apart & (a[i - 3] == y) & (x == b[j - 2]))
            new[j] = c
        rows = [*rows[-2:], new]
        done = la == i
        out[done] = new[lb[done], np.flatnonzero(done)]
    return out


def deletes(text: str, depth: int) -> set[str]:
    """The text and every string that comes of it by at most `depth` deletions."""
    all_of, last = {text}, {text}
    for _ in range(depth):
        last = {s[:i] + s[i + 1 :] for s in last for i in range(len(s))}
        all_of |= last
    return all_of


class DeleteDictionary:
    """Finds the entries within `depth` edits of a string: two strings are that near only if they
    share a string that comes of each by at most `depth` deletions."""

    def __init__(self, depth: int = 2):
        self.depth = depth
        self.index: dict[str, list[str]] = defaultdict(list)
        self.known: set[str] = set()

    def add(self, text: str) -> None:
        if text not in self.known:
            self.known.add(text)
            for d in deletes(text, self.depth):
                self.index[d].append(text)

    def near(self, text: str, depth: int | None = None) -> set[str]:
        found: set[str] = set()
        for d in deletes(text, self.depth if depth is None else depth):
            found.update(self.index.get(d, ()))
        return found


def allowed(length: int) -> float:
    """Edits that a name of so many characters may have."""
    return 0.0 if length < 4 else 1.0 if length < 6 else 2.0


def shortens(short: str, full: str) -> bool:
    """Whether short is an abbreviation of full: the same first letter, and its letters in order."""
    if not short or not full or short[0] != full[0]:
        return False
    rest = iter(full)
    return all(c in rest for c in short)
