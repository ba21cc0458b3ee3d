"""Reading postal addresses: building number, direction, street, street type, unit and town out of one
written line and the columns beside it."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from .canonical import Towns
from .textkit import allowed, distance, fold, words

#: Directions with their short forms.
DIRECTION_FORMS = {"north": ("n", "no"), "south": ("s", "so"), "east": ("e",), "west": ("w",), "northeast": ("ne",), "northwest": ("nw",), "southeast": ("se",), "southwest": ("sw",)}
DIRECTIONS = {s: k for k, v in DIRECTION_FORMS.items() for s in (k, *v)}
#: Street types with their short forms.
STREET_TYPES = {
    "street": ("st", "str"),
    "avenue": ("ave", "av", "aven"),
    "road": ("rd",),
    "lane": ("ln",),
    "drive": ("dr", "drv"),
    "boulevard": ("blvd", "bl", "boul"),
    "court": ("ct", "crt"),
    "place": ("pl",),
    "parkway": ("pkwy", "pky", "pkway"),
    "highway": ("hwy", "hiway", "hway"),
    "circle": ("cir",),
    "terrace": ("ter",),
    "trail": ("trl",),
    "square": ("sq",),
    "turnpike": ("tpke",),
    "way": (),
    "alley": ("aly",),
}
TYPES = {s: k for k, v in STREET_TYPES.items() for s in (k, *v)}
UNITS = frozenset(("suite", "ste", "unit", "apt", "apartment", "spc", "space", "rm", "room", "shop"))
CENTERS = frozenset(("plaza", "commons", "crossing", "center", "centre", "mall", "square", "shopping"))
BANDS = 32
_TOKEN = re.compile(r"#?\s*[a-z0-9]+")
_PARTING, _UNIT, _MARKED, _NUMBER, _LEADING = (re.compile(p) for p in (r"[,;()]|\s-+\s", r"#?[a-z]?\d+[a-z]?|#[a-z]", r"#?\d+[a-z]?", r"\d+[a-z]?", r"#\s*\d"))
_ZIP = re.compile(r"\s*(\d{1,5})(?:\.0*)?(?:-\d+)?\s*$")
_RNG = np.random.default_rng(20_130_101)
_A = _RNG.integers(1, 2**31 - 1, BANDS, dtype=np.int64) | 1
_B = _RNG.integers(0, 2**31 - 1, BANDS, dtype=np.int64)


@dataclass(frozen=True)
class Place:
    """The words of an address by what they are. Direction and street type stay as they were written; of the
    unit its number is kept. Words of a street are parted by a blank."""

    number: str = ""
    direction: str = ""
    street: str = ""
    kind: str = ""
    unit: str = ""
    town: str = ""
    zip5: str = ""


def zip5(text: str | None) -> str:
    """The first five digits of a postcode; a lost leading zero is put back."""
    m = _ZIP.match(text or "")
    return m.group(1).zfill(5) if m and len(m.group(1)) >= 3 else ""


@lru_cache(maxsize=100_000)
def street_type(token: str) -> str:
    """The street type that a word stands for, one edit in a long word allowed."""
    if token in TYPES:
        return TYPES[token]
    if len(token) >= 5:
        for full in STREET_TYPES:
            if len(full) >= 5 and distance(token, full, 1.0) <= 1.0:
                return full
    return ""


def _town_of(tokens: list[str], towns: Towns, state: str) -> tuple[str, str]:
    """(town key, state) told by the end of an address line, or ''. Postcode and state may follow."""
    ws = list(tokens)
    while ws and ws[-1].isdigit():
        ws.pop()
    if not ws:
        return "", ""
    typed = ""
    if len(ws) > 1 and ws[-1] in towns.states:
        typed = ws.pop()
    return town_key(" ".join(ws), state or typed, towns), typed


def town_key(city: str, state: str, towns: Towns) -> str:
    """'t:<id>' for a town of the list; '' where the state is needed and not given; 'x:<name>' for a town
    that the list lacks."""
    ranked = towns.search(city, state)
    if ranked:
        near = [e for c, e in ranked if c <= ranked[0][0] + 0.01]
        if len(near) > 1 and len({e.extra for e in near}) > 1:
            return ""
        return f"t:{near[0].ref_id}"
    ws, typed = towns.clean(city)
    ws = [towns.long_before.get(w, w) if i == 0 else towns.long_after.get(w, w) if i == len(ws) - 1 else w for i, w in enumerate(ws)]
    return f"x:{''.join(ws)}/{(state or typed).lower()}" if ws else ""


def read_place(address: str | None, city: str | None, state: str | None, postcode: str | None, towns: Towns) -> Place:
    state = (state or "").strip().lower()
    text = fold(address or "").replace("'", "")
    segments = [[t.replace(" ", "") for t in _TOKEN.findall(part)] for part in _PARTING.split(text)]
    segments = [s for s in segments if s]
    number = unit = ""
    spare = ""
    rest: list[list[str]] = []
    for seg in segments:
        if len(segments) > 1 and not any(c.isdigit() for t in seg for c in t) and seg[-1] in CENTERS:
            continue
        kept: list[str] = []
        i = 0
        while i < len(seg):
            t = seg[i]
            after = seg[i + 1] if i + 1 < len(seg) else ""
            if t in UNITS and after and (after.lstrip("#").isdigit() or _UNIT.fullmatch(after)):
                unit = after.lstrip("#").lstrip("0")
                i += 2
                continue
            if t in ("no", "num", "nr") and _MARKED.fullmatch(after):
                if number:
                    unit = unit or after.lstrip("#0")
                else:
                    number = after.lstrip("#0")
                i += 2
                continue
            if t.startswith("#"):
                spare, unit = (t[1:].lstrip("0"), unit) if unit else ("", t[1:].lstrip("0"))
            elif _NUMBER.fullmatch(t):
                if not number and not (len(t) == 5 and kept and kept[-1] in towns.states and i == len(seg) - 1):
                    number = t.lstrip("0")
                elif len(t) == 5 or kept:
                    kept.append(t)
            else:
                kept.append(t)
            i += 1
        # a center's name before the street, without a comma
        if len(kept) > 2 and kept[1] in CENTERS and kept[1] not in TYPES:
            kept = kept[2:]
        if kept:
            rest.append(kept)
    if not number and unit and spare:
        number = spare
    elif not number and unit and _LEADING.match(text.strip()):
        number, unit = unit, ""
    direction = kind = ""
    street: list[str] = []
    tail: list[str] = []
    for k, seg in enumerate(rest):
        if street:
            tail += seg
            continue
        at = next((j for j in range(1, len(seg)) if street_type(seg[j]) and any(w not in DIRECTIONS and not w.isdigit() for w in seg[:j])), None)
        if at is not None and seg[at] in towns.states and all(w.isdigit() for w in seg[at + 1 :]) and any("".join(seg[at - n : at]) in towns.by_form for n in range(1, min(4, at))):
            at = None  # the state after a town, not a street type
        body = seg[:at] if at is not None else seg
        while len(body) > 1 and body[0] in DIRECTIONS:
            direction, body = direction or body[0], body[1:]
        if at is None:
            while len(body) > 1 and body[-1].isdigit():
                tail, body = [body[-1], *tail], body[:-1]
            if len(body) > 1 and body[-1] in DIRECTIONS:
                direction, body = direction or body[-1], body[:-1]
            for n in (3, 2, 1):  # a town without a comma before it
                end = body[-n:] if body[-1] not in towns.states else body[-n - 1 :]
                if len(body) > len(end) and "".join(w for w in end if w not in towns.states) in towns.by_form:
                    tail, body = end + tail, body[: -len(end)]
                    break
            if len(body) > 1 and body[-1] in DIRECTIONS:
                direction, body = direction or body[-1], body[:-1]
            street = body
            continue
        kind = seg[at]
        street = body
        tail = seg[at + 1 :]
    town = ""
    typed = ""
    while tail and tail[0].isdigit() and len(tail[0]) != 5:
        tail = tail[1:]
    if tail and tail[0] in DIRECTIONS:
        alone = len([t for t in tail if not t.isdigit()]) == 1
        whole = "" if alone else _town_of(tail, towns, state)[0]
        if not whole.startswith("t:"):
            direction, tail = direction or tail[0], tail[1:]
    if tail and street_type(tail[0]) and not kind and tail[0] not in ("st",):
        kind, tail = tail[0], tail[1:]
    code = zip5(postcode)
    if not code and tail and tail[-1].isdigit() and len(tail[-1]) == 5:
        code = tail[-1]
    if tail:
        town, typed = _town_of(tail, towns, state)
    if (city or "").strip():
        own = town_key(city, state or typed, towns)
        town = own if own.startswith("t:") or not town.startswith("t:") else town
    if town.startswith("x:") and not (city or "").strip():
        town = ""
    return Place(number, direction, " ".join(street), kind, unit, town, code)


@lru_cache(maxsize=20_000)
def _hashed(gram: str) -> np.ndarray:
    return (zlib.crc32(gram.encode()) * _A + _B) % ((1 << 61) - 1) % ((1 << 31) - 1)


@lru_cache(maxsize=100_000)
def street_bands(street: str) -> tuple[int, ...]:
    """MinHash of the shingles of a street, one hash per band: its tokens, and of its letters run together the
    padded 2-grams, the 2-grams with a letter left out between, and the letters. Two spellings of six
    letters with two typing errors share about 0.4 of them, so that of 32 bands none is common in
    one such pair of ten millions."""
    whole = street.replace(" ", "")
    padded = f"^{whole}$"
    grams = {padded[i : i + 2] for i in range(len(padded) - 1)} | {f"{padded[i]}_{padded[i + 2]}" for i in range(len(padded) - 2)}
    return tuple(np.minimum.reduce([_hashed(s) for s in {*street.split(), *grams, *whole}]).tolist())


#: Costs of the alignment of two addresses token by token: opening and lengthening a gap over parts that may
#: be left out, a word for its abbreviation or misspelt form, a token parted in two, and what no match may cost.
GAP_OPEN, GAP_MORE, SHORT_FORM, PARTED, APART = 0.15, 0.05, 0.05, 0.1, 9.0
#: Alignments up to this cost denote one location: two typing errors in a street name of six letters or
#: more, and every other part left out or shortened.
SAME = 2.9
ROLES = ("number", "direction", "street", "kind", "unit")


def tokens_of(p: Place) -> list[tuple[str, str]]:
    """(role, word) in the order of ROLES, in which addresses are aligned however they were written."""
    out = []
    for role, words_of in zip(ROLES, (p.number, p.direction, p.street, p.kind, p.unit)):
        out += [(role, w) for w in words_of.split()]
    return out


@lru_cache(maxsize=200_000)
def swap(role: str, a: str, b: str) -> float:
    """Cost of one token standing for another of the same role. A direction or street type stands for
    its forms in the dictionaries of abbreviations; words of a street may be misspelt; numbers and
    units must agree."""
    if a == b:
        return 0.0
    if role == "direction":
        return SHORT_FORM if DIRECTIONS.get(a, a) == DIRECTIONS.get(b, b) else APART
    if role == "kind":
        return SHORT_FORM if street_type(a) == street_type(b) else APART
    longer = max(len(a), len(b))
    if role != "street" or longer < 4:
        return APART
    cost = distance(a, b, SAME)
    return cost * max(1.0, 6.0 / longer) if cost <= SAME else APART


def alignment(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> float:
    """Least cost of aligning two addresses with affine gaps (Gotoh). Words of the street and numbers
    cannot be left out, nor any part that the other address gives as well."""
    inf = float("inf")
    given_a, given_b = {r for r, _ in a}, {r for r, _ in b}
    lose = lambda role, given: APART if role in ("number", "street") or role in given else 0.0
    n, m = len(a), len(b)
    best = [[inf] * (m + 1) for _ in range(n + 1)]
    down = [[inf] * (m + 1) for _ in range(n + 1)]
    side = [[inf] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                down[i][j] = min(best[i - 1][j] + GAP_OPEN, down[i - 1][j] + GAP_MORE) + lose(a[i - 1][0], given_b)
            if j:
                side[i][j] = min(best[i][j - 1] + GAP_OPEN, side[i][j - 1] + GAP_MORE) + lose(b[j - 1][0], given_a)
            least = min(best[i][j], down[i][j], side[i][j])
            if i and j and a[i - 1][0] == b[j - 1][0]:
                role = a[i - 1][0]
                least = min(least, best[i - 1][j - 1] + swap(role, a[i - 1][1], b[j - 1][1]))
                if role == "street":
                    if i > 1 and a[i - 2][0] == role:
                        least = min(least, best[i - 2][j - 1] + PARTED + swap(role, a[i - 2][1] + a[i - 1][1], b[j - 1][1]))
                    if j > 1 and b[j - 2][0] == role:
                        least = min(least, best[i - 1][j - 2] + PARTED + swap(role, a[i - 1][1], b[j - 2][1] + b[j - 1][1]))
            best[i][j] = least
    return best[n][m]


def address_cost(a: Place, b: Place) -> float:
    """The cost of the alignment, or APART at once where a part that both give as one token cannot be aligned."""
    for role, x, y in (("number", a.number, b.number), ("unit", a.unit, b.unit), ("kind", a.kind, b.kind), ("direction", a.direction, b.direction)):
        if x and y and swap(role, x, y) >= APART:
            return APART
    return alignment(tokens_of(a), tokens_of(b))


def aligned(a: Place, b: Place) -> bool:
    """Whether address_cost() is at most SAME; it is told without an alignment for equal streets of one number, as parts left
    out or shortened cost less than that together, and for streets of one word that cannot stand for each other."""
    if a.number == b.number and a.number:
        if a.street == b.street:
            return not any(x and y and swap(role, x, y) >= APART for role, x, y in (("unit", a.unit, b.unit), ("kind", a.kind, b.kind), ("direction", a.direction, b.direction)))
        if a.street and b.street and " " not in a.street and " " not in b.street and swap("street", a.street, b.street) >= APART:
            return False
    return address_cost(a, b) <= SAME


def same_location(a: Place, b: Place) -> bool:
    return bool(a.town) and a.town == b.town and bool(a.number) and aligned(a, b)
