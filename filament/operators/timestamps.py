"""One UTC instant for stamps of mixed notation, precision and zone.

A stamp's shape mask has the class of every character: 9 for a digit, A for a letter, a
blank for white space, other signs as they are. Each distinct mask is mapped to its parsers
once: where the fields stand, and which words must stand where. The words of all rows of a
mask are looked up together (month, weekday, half of the day, zone), the first parser whose
words are right holds, the digits of all rows of a batch are read by array gathers along
their row's parser, and wall-clock times are converted through per-zone transition tables
that carry the version of the zone database.
"""

from __future__ import annotations

import functools
import os
import re
import string
import zoneinfo
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Minutes east of UTC that a zone abbreviation stands for.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0,
    "BST": 60, "CET": 60, "WEST": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540,
    "ACST": 570, "AEST": 600, "ACDT": 630, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()

_DAY = 86_400
NONE = np.datetime64("NaT", "us")


# ---------------------------------------------------------------- zone transition tables
@functools.cache
def zone_version() -> str:
    """Version of the zone database in use on this machine."""
    for folder in zoneinfo.TZPATH:
        path = os.path.join(folder, "tzdata.zi")
        if os.path.exists(path):
            with open(path) as f:
                return f.readline().rpartition(" ")[2].strip()
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@dataclass(frozen=True)
class ZoneTable:
    """UTC seconds at which the offset changes, and the offset before, between and after."""

    version: str
    transitions: np.ndarray
    offsets: np.ndarray

    def at(self, utc: np.ndarray) -> np.ndarray:
        return self.offsets[np.searchsorted(self.transitions, utc, side="right")]

    def to_utc(self, wall: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTC seconds of wall-clock seconds, and whether there is exactly one."""
        early, late = self.at(wall - 2 * _DAY), self.at(wall + 2 * _DAY)
        a, b = wall - early, wall - late
        ok_a, ok_b = self.at(a) == early, self.at(b) == late
        return np.where(ok_a, a, b), np.where(early == late, ok_a, ok_a ^ ok_b)


@functools.cache
def zone_table(name: str, first: int = 1900, last: int = 2110) -> ZoneTable | None:
    """Transition table of a zone, found by bisecting its offset week by week; None for no zone."""
    try:
        zone = zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None
    import datetime as dt

    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)

    def offset(t: int) -> int:
        return int((epoch + dt.timedelta(seconds=t)).astimezone(zone).utcoffset().total_seconds())

    begin = int((dt.datetime(first, 1, 1, tzinfo=dt.UTC) - epoch).total_seconds())
    end = int((dt.datetime(last, 1, 1, tzinfo=dt.UTC) - epoch).total_seconds())
    times, offsets = [], [offset(begin)]
    lo, at = begin, offsets[0]
    while lo < end:
        hi = lo + 7 * _DAY
        now = offset(hi)
        if now != at:
            a, b = lo, hi
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if offset(mid) == at else (a, mid)
            times.append(b)
            offsets.append(now)
            at = now
        lo = hi
    return ZoneTable(zone_version(), np.array(times, np.int64), np.array(offsets, np.int64))


# ---------------------------------------------------------------- masks to parsers
_CLASSES = {ord(c): "9" for c in "0123456789"} | {ord(c): "A" for c in string.ascii_letters} | {ord(c): " " for c in string.whitespace}


def mask_of(text: str) -> str:
    """The class of each character: 9 (ASCII digits), A (ASCII letters), a blank for white space, L for other letters and digits; other signs stay."""
    mask = text.translate(_CLASSES)
    return mask if mask.isascii() else "".join(c if c.isascii() else " " if c.isspace() else "L" if c.isalnum() else c for c in mask)


_FIELDS = ("Y", "M", "D", "A", "B", "J", "V", "U", "h", "m", "s", "oh", "om", "f")
_AT = {k: i for i, k in enumerate(_FIELDS)}

# grammars of masks; the groups that are no fields are words, see _WORDS
_TIME = r"(?P<h>99?):(?P<m>99)(?::(?P<s>99)(?:[.,](?P<f>9+))?)?"
_HALF = r" *(?P<half>A)\.?(?P<of>A)\.?(?!A)"
_CLOCKS = (_TIME + _HALF, _TIME, r"(?P<h>99?)" + _HALF)
_PACKED = r"(?P<h>99)(?P<m>99)(?:(?P<s>99)(?:[.,](?P<f>9+))?)?"
_ZONES = (
    r" *(?P<utc>AAA)? ?(?P<sg>[+\-−])(?P<oh>99?)(?::?(?P<om>99))?(?: *\[[^\]]*\])?",
    r" *[\[(]?(?P<zone>[A_]+(?:/[A9_+\-]+)+)[\])]?",
    r" *[\[(]?(?P<abbr>A{1,5})[\])]?",
    "",
)
_WEEKDAY = r"(?:(?P<wd>A{3,9})\.?,? +)?"
_DATES = (
    r"(?P<Y>9999)(?P<sep>[-/.])(?P<M>99?)(?P=sep)(?P<D>99?)",
    r"(?P<Y>9999)-(?P<J>999)",
    r"(?P<Y>9999)-(?P<week>A)(?P<V>99)-(?P<U>9)",
    r"(?P<Y>9999)(?P<week>A)(?P<V>99)(?P<U>9)",
    r"(?P<A>99?)(?P<sep>[-/.])(?P<B>99?)(?P=sep)(?P<Y>9999|99)",
    _WEEKDAY + r"(?P<D>99?)(?P<th>AA)?[ \-](?P<mon>A{3,9})\.?,?[ \-](?P<Y>9999)",
    _WEEKDAY + r"(?P<mon>A{3,9})\.? +(?P<D>99?)(?P<th>AA)?,? +(?P<Y>9999)",
)
_SEP = r"(?:(?P<t>A)|,? +|,)"
_DAY_PACKED = r"(?P<Y>9999)(?P<M>99)(?P<D>99)(?:(?P<t>A)| +)"
_GRAMMARS = tuple(
    re.compile(x)
    for zone in _ZONES
    for x in (
        *(f"{d}{_SEP}{clock}{zone}" for d in _DATES for clock in _CLOCKS),
        *(f"{d}{zone}" for d in _DATES),
        *(f"{_DAY_PACKED}{clock}{zone}" for clock in (_PACKED, *_CLOCKS[:2])),
        rf"(?P<Y>9999)-(?P<M>99)-(?P<D>99)(?P<t>A){_PACKED}{zone}",
        *(rf"(?P<wd>A{{3,9}})\.?,? +(?P<mon>A{{3,9}})\.? +(?P<D>99?) +{clock}{zone} +(?P<Y>9999)" for clock in _CLOCKS[:2]),
    )
)
_BARE = re.compile(r"(?P<n>9{1,17})(?:\.(?P<f>9+))?")


def _names(of: list[str]) -> dict[str, int]:
    """1-based place by full and three-letter name."""
    return {n: i for i, x in enumerate(of, 1) for n in (x, x[:3])}


#: What a word of a role must be (by lower-case text, or as written where case counts), and the value it has.
_WORDS: dict[str, tuple[bool, dict[str, int]]] = {
    "mon": (True, _names(MONTHS) | {"sept": 9}),
    "wd": (True, _names(WEEKDAYS)),
    "half": (True, {"a": 1, "p": 2}),
    "of": (True, {"m": 1}),
    "t": (True, {"t": 1}),
    "week": (False, {"W": 1}),
    "th": (False, {"st": 1, "nd": 1, "rd": 1, "th": 1}),
    "utc": (False, {"UTC": 1, "GMT": 1, "utc": 1, "gmt": 1}),
    "abbr": (True, {k.lower(): v for k, v in ABBREVIATIONS.items()}),
}
_VALUES = ("mon", "half", "abbr")


@dataclass(frozen=True)
class Parser:
    """Where the fields of a mask stand, and which words must stand where."""

    kind: str  # "date" or "number"
    spans: tuple[tuple[int, int], ...]  # start and length by _FIELDS
    words: tuple[tuple[str, int, int], ...] = ()  # role, start and length
    clock: str = ""  # "offset", "zone", "local"
    sign: int = 1
    zone: tuple[int, int] = (0, 0)  # where the zone's name stands


def _parsers(mask: str) -> tuple[Parser, ...]:
    if (m := _BARE.fullmatch(mask)) is not None:
        return (Parser("number", ((m.start("n"), len(m["n"])), (m.start("f"), len(m["f"] or "")))),)
    out = []
    for grammar in _GRAMMARS:
        if (m := grammar.fullmatch(mask)) is not None:
            g = {k: v for k, v in m.groupdict().items() if v is not None}
            spans = tuple((m.start(k), len(g[k])) if k in g else (0, 0) for k in _FIELDS)
            words = tuple((k, m.start(k), len(g[k])) for k in g if k in _WORDS)
            how = "offset" if "sg" in g or "abbr" in g else "zone" if "zone" in g else "local"
            out.append(Parser("date", spans, words, how, 1 if g.get("sg") in (None, "+") else -1, (m.start("zone"), len(g["zone"])) if "zone" in g else (0, 0)))
    return tuple(dict.fromkeys(out))


#: Masks whose parsers a process keeps, and their length at most; masks of free text are many and long.
KEPT_MASKS, KEPT_LENGTH = 8_192, 128
_kept_parsers = functools.lru_cache(KEPT_MASKS)(_parsers)


def parsers_of(mask: str) -> tuple[Parser, ...]:
    """The parsers of a mask, the first to be tried first; none for masks that no stamp has. Kept in the process for the masks used last."""
    return _kept_parsers(mask) if len(mask) <= KEPT_LENGTH else _parsers(mask)


# ---------------------------------------------------------------- batch conversion
def _read(chars: np.ndarray, start: np.ndarray, length: np.ndarray, keep: int) -> np.ndarray:
    """Numbers that stand at start in each row, their first keep digits at most."""
    out, rows = np.zeros(len(chars), np.int64), np.arange(len(chars))
    for k in range(int(min(keep, length.max(initial=0)))):
        have = k < length
        digit = chars[rows, np.where(have, start + k, 0)].astype(np.int64) - 48
        out = np.where(have, out * 10 + digit, out)
    return out


def _fraction(chars: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Microseconds; finer digits are cut off."""
    n = np.minimum(length, 6)
    return _read(chars, start, n, 6) * 10 ** (6 - n)


def _days(y: np.ndarray, mo: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970-01-01 and whether the date exists."""
    ok = (mo >= 1) & (mo <= 12) & (d >= 1) & (y >= 1)
    month = (np.where(ok, y, 1970) - 1970) * 12 + np.where(ok, mo, 1) - 1
    first = month.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    after = (month + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    return first + d - 1, ok & (d <= after - first)


def to_instants(texts: list[str | None], zones: list[str | None], orders: list[str | None]) -> np.ndarray:
    """UTC instants (datetime64[us], NaT where the text denotes none or more than one).

    texts: the stamps; zones, orders: zone and all-number date order of each row's clocks,
    used where the text names no zone or leaves the order open; null there makes such a
    text denote no instant.
    """
    out = np.full(len(texts), NONE)
    stripped = [t.strip() if t else "" for t in texts]
    codes, masks = pd.factorize(np.array([mask_of(t) for t in stripped], object))
    order = np.argsort(codes, kind="stable")
    ends = np.searchsorted(codes[order], np.arange(len(masks)), side="right")
    begin = 0
    read: dict[str, list[tuple]] = {"date": [], "number": []}  # rows with their parser and what their words say
    for mask, end in zip(masks, ends, strict=True):
        rows, begin = order[begin:end], end
        parsers = parsers_of(mask)
        if not parsers:
            continue
        for part in np.split(rows, range(CELLS // len(mask) + 1, len(rows), CELLS // len(mask) + 1)):
            chars = np.array([stripped[i] for i in part], f"U{len(mask)}").view(np.uint32).reshape(len(part), len(mask))
            left = np.arange(len(part))
            for p in parsers:
                good, values, names = _words(p, chars[left])
                own = left[good]
                if len(own):
                    read[p.kind].append((part[own], p, *(v[good] for v in values), names[good]))
                left = left[~good]
                if not len(left):
                    break
    for kind, convert in (("date", _dates), ("number", _numbers)):
        for some in _together(read[kind], stripped):
            rows = np.concatenate([x[0] for x in some])
            width = max(len(stripped[i]) for i in rows)
            chars = np.array([stripped[i] for i in rows], f"U{width}").view(np.uint32).reshape(len(rows), width)
            found = Read([x[1] for x in some], np.repeat(np.arange(len(some)), [len(x[0]) for x in some]), *(np.concatenate([x[i] for x in some]) for i in range(2, 6)))
            out[rows] = convert(chars, found, np.array(zones, object)[rows], np.array(orders, object)[rows])
    return out


#: Characters worked on at a time.
CELLS = 1 << 22


def _together(parts: list[tuple], texts: list[str]) -> Iterator[list[tuple]]:
    """Parts of alike lengths, a bounded number of characters at a time."""
    some: list[tuple] = []
    n = 0
    for x in sorted(parts, key=lambda x: len(texts[x[0][0]])):
        if some and (n + len(x[0])) * len(texts[x[0][0]]) > CELLS:
            yield some
            some, n = [], 0
        some.append(x)
        n += len(x[0])
    if some:
        yield some


@dataclass
class Read:
    """Rows' parsers, and what their words say: month, half of the day (1, 2 or 0), minutes east of UTC, and zone name."""

    parsers: list[Parser]
    of: np.ndarray
    month: np.ndarray
    half: np.ndarray
    minutes: np.ndarray
    zone: np.ndarray

    def spans(self) -> np.ndarray:
        return np.array([p.spans for p in self.parsers], np.int64)[self.of]


def _slot(chars: np.ndarray, start: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct texts at a place, and which of them each row has."""
    text = np.ascontiguousarray(chars[:, start : start + length]).view(f"U{length}").ravel()
    codes, names = pd.factorize(text.astype(object))
    return names, codes


def _words(p: Parser, chars: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of rows of one mask: whether their words are right for a parser, the values of _VALUES, and the zone's name."""
    n = len(chars)
    good, values, zone = np.ones(n, bool), {k: np.zeros(n, np.int64) for k in _VALUES}, np.full(n, None, object)
    for role, start, length in p.words:
        lower, known = _WORDS[role]
        names, codes = _slot(chars, start, length)
        found = [known.get(x.lower() if lower else x) for x in names]
        good &= np.array([x is not None for x in found])[codes]
        if role in values:
            values[role] = np.array([x or 0 for x in found], np.int64)[codes]
    if p.clock == "zone":
        names, codes = _slot(chars, *p.zone)
        zone = np.asarray(names, object)[codes]
    return good, [values[k] for k in _VALUES], zone


def _numbers(chars: np.ndarray, found: Read, zones: np.ndarray, orders: np.ndarray) -> np.ndarray:
    spans = found.spans()
    start, length = spans[:, 0, 0], spans[:, 0, 1]
    fraction = _fraction(chars, spans[:, 1, 0], spans[:, 1, 1])
    whole = spans[:, 1, 1] == 0
    number = _read(chars, start, np.where(length <= 17, length, 0), 17)
    scale = np.select([length <= 11, length <= 14, length <= 17], [1_000_000, 1_000, 1], 0)
    used = (length > 4) & (length <= 17) & (whole | (scale == 1_000_000))
    out = np.where(used, number * scale + np.where(scale == 1_000_000, fraction, 0), np.iinfo(np.int64).min).astype("datetime64[us]")
    calendar = np.flatnonzero(whole & np.isin(length, (8, 12, 14)))
    if len(calendar):
        c, s, k = chars[calendar], start[calendar], length[calendar]
        day, ok = _days(_read(c, s, np.full(len(c), 4), 4), _read(c, s + 4, np.full(len(c), 2), 2), _read(c, s + 6, np.full(len(c), 2), 2))
        h, mi, se = (_read(c, s + at, np.where(k >= at + 2, 2, 0), 2) for at in (8, 10, 12))
        year = _read(c, s, np.full(len(c), 4), 4)
        ok &= (h < 24) & (mi < 60) & (se < 60) & ((k == 8) | (year >= 1900) & (year <= 2100))
        wall = day * _DAY + h * 3600 + mi * 60 + se
        got = _from_wall(wall, zones[calendar])
        out[calendar[ok]] = got[ok]
    return out


def _from_wall(wall: np.ndarray, zones: np.ndarray) -> np.ndarray:
    """Instants of wall-clock seconds through the zones' transition tables."""
    out = np.full(len(wall), NONE)
    codes, names = pd.factorize(zones)
    for i, name in enumerate(names):
        table = zone_table(str(name))
        if table is not None:
            rows = np.flatnonzero(codes == i)
            utc, ok = table.to_utc(wall[rows])
            out[rows[ok]] = (utc[ok] * 1_000_000).astype("datetime64[us]")
    return out


def _dates(chars: np.ndarray, found: Read, zones: np.ndarray, orders: np.ndarray) -> np.ndarray:
    n = len(chars)
    spans = found.spans()
    start = {k: spans[:, i, 0] for k, i in _AT.items()}
    length = {k: spans[:, i, 1] for k, i in _AT.items()}
    v = {k: _read(chars, start[k], length[k], 4) for k in _FIELDS if k != "f"}
    year = np.where(length["Y"] == 2, 2000 + v["Y"], v["Y"])
    order = np.array([str(x).strip().lower() if x else "" for x in orders], object)
    open_order = length["A"] > 0
    month = np.where(open_order, np.where(order == "mdy", v["A"], v["B"]), v["M"])
    day = np.where(open_order, np.where(order == "mdy", v["B"], v["A"]), v["D"])
    month = np.where(found.month > 0, found.month, month)
    ordinal, week = length["J"] > 0, length["V"] > 0
    days, ok = _days(year, np.where(ordinal | week, 1, month), np.where(ordinal | week, 1, day))
    ok &= ~open_order | np.isin(order, ("mdy", "dmy"))
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    ok &= ~ordinal | ((v["J"] >= 1) & (v["J"] <= 365 + leap))
    days = np.where(ordinal, days + v["J"] - 1, days)
    # week 1 holds 4 January; a year has 53 weeks if its 1 January or 31 December is a Thursday
    weekday = (days + 3) % 7
    monday = days - weekday + np.where(weekday > 3, 7, 0)
    weeks = np.where((weekday == 3) | (leap & (weekday == 2)), 53, 52)
    ok &= ~week | ((v["V"] >= 1) & (v["V"] <= weeks) & (v["U"] >= 1) & (v["U"] <= 7))
    days = np.where(week, monday + 7 * (v["V"] - 1) + v["U"] - 1, days)

    hour = v["h"]
    ok &= (found.half == 0) | ((hour >= 1) & (hour <= 12))
    hour = np.where(found.half == 0, hour, hour % 12 + np.where(found.half == 2, 12, 0))
    ok &= (hour < 24) & (v["m"] < 60) & (v["s"] < 60)
    wall = days * _DAY + hour * 3600 + v["m"] * 60 + v["s"]
    out = np.full(n, NONE)

    how = np.array([p.clock for p in found.parsers], object)[found.of]
    signed = length["oh"] > 0
    offset = np.where(signed, np.array([p.sign for p in found.parsers])[found.of] * (v["oh"] * 60 + v["om"]), found.minutes)
    ok &= ~signed | ((v["oh"] <= 18) & (v["om"] < 60))
    fixed = ok & (how == "offset")
    out[fixed] = ((wall[fixed] - offset[fixed] * 60) * 1_000_000).astype("datetime64[us]")
    rows = np.flatnonzero(ok & (how != "offset"))
    if len(rows):
        out[rows] = _from_wall(wall[rows], np.where(how[rows] == "zone", found.zone[rows], zones[rows]))
    return out + _fraction(chars, start["f"], length["f"]).astype("timedelta64[us]")


def to_text(instants: np.ndarray) -> np.ndarray:
    """YYYY-MM-DDTHH:MM:SS.ffffffZ, or none."""
    lost = np.isnat(instants)
    text = np.char.add(np.datetime_as_string(np.where(lost, np.datetime64(0, "us"), instants), unit="us"), "Z").astype(object)
    text[lost] = "none"
    return text


def utc_stamp(text: Column, zone: Column, date_order: Column) -> Column:
    """UTC instant of a stamp as YYYY-MM-DDTHH:MM:SS.ffffffZ, or "none".

    text: the stamp, surrounding white space ignored. zone: zone of the clocks that wrote
    it, for texts that name none. date_order: "mdy" or "dmy", for all-number dates that do
    not begin with a four-digit year; null zone or order makes texts that need them "none".
    A null or blank text, and a text that is no stamp, is "none". All workers must have the
    zone database version that the driver has, else the job fails.
    """
    version = zone_version()

    @F.pandas_udf(T.StringType())
    def convert(t: pd.Series, z: pd.Series, o: pd.Series) -> pd.Series:
        if zone_version() != version:
            raise RuntimeError(f"zone database {zone_version()} on a worker, {version} on the driver")
        clean = lambda s: s.astype(object).where(s.notna(), None).tolist()
        return pd.Series(to_text(to_instants(clean(t), clean(z), clean(o))))

    return convert(text.cast("string"), zone.cast("string"), date_order.cast("string"))


#: Exactly YYYY-MM-DDTHH:MM:SSZ, with or without a fraction.
EXACT = r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z\z"
_LABEL = r"[a-z][a-z0-9]*(?:_[a-z0-9]+)+(?:\.run\d+)?"


def stamp_beside_label(name: Column) -> Column:
    """The text beside a counter label (`a_b.run1@S`, `a_b [S]`, `a_b at S`, `S | a_b`, `[S] a_b`); null if there is none."""
    after = F.regexp_extract(name, rf"(?s)\A\s*{_LABEL}(?:@|\s+at\s+|\s*\|\s*|\s+|(?=\[))(.*?)\s*\z", 1)
    before = F.regexp_extract(name, rf"(?s)\A\s*(.*?)\s*(?:\||@|\s)\s*{_LABEL}\s*\z", 1)
    beside = F.when(after != "", after).otherwise(before)
    inner = F.regexp_replace(beside, r"(?s)\A\[(.*)\]\z", "$1")
    return F.when(inner.rlike(r"(?U)\S"), inner)
