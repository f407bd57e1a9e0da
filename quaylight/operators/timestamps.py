"""Mixed timestamp texts to one instant in UTC.

Each text is reduced to a shape mask (digits to ``9``, Latin letters to ``A``, all
else as it stands).  A mask is matched against the grammar of timestamp shapes
once per worker and yields the fixed positions of its fields; all rows of a mask
are then read as one matrix of code points, without a loop over rows.  Wall times
go through the transition tables of :mod:`quaylight.functions.zones`.

Defined results: null, empty and blank texts, relative times, times
without a date and dates that don't exist give null; texts are read whole, of any length.  Rows are independent, so
repeated rows and ties keep their own result; an empty table gives an empty one.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylight.functions.zones import ZoneTable

#: Masks of at most so many characters are kept with their parser; longer ones are matched each time.
KEPT_MASK = 80
#: Zones whose transitions are shipped to the tasks; the zone database has some six hundred.
MOST_ZONES = 10_000
_MASK = {**{ord(c): "9" for c in "0123456789"}, **{c: "A" for c in range(65, 91)}, **{c: "A" for c in range(97, 123)}}

# Names of months and half days.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MERIDIEMS = {"am": 0, "pm": 1, "a.m.": 0, "p.m.": 1, "上午": 0, "凌晨": 0, "早上": 0, "下午": 1, "晚上": 1}

_DATE = r"""(?:
    (?P<y1>9{4})(?P<s1>[-/.])(?P<m1>9{1,2})(?P=s1)(?P<d1>9{1,2})
  | (?P<y2>9{4})年\ ?(?P<m2>9{1,2})月\ ?(?P<d2>9{1,2})日
  | (?P<p3>9{1,2})(?P<s3>[-/.])(?P<q3>9{1,2})(?P=s3)(?P<y3>9{4})
  | (?:A{3,9},?\ )?(?P<mon4>A{3,9})\.?\ (?P<d4>9{1,2})(?:AA)?,?\ (?P<y4>9{4})
  | (?:A{3,9},?\ )?(?P<d5>9{1,2})(?P<s5>[-\ ])(?P<mon5>A{3,9})\.?(?P=s5)(?P<y5>9{4})
  | (?P<c6>9{8})
)"""
_TIME = r"""(?:
    (?P<ap1>上午|下午|凌晨|早上|晚上)?\ ?(?P<H>9{1,2}):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9{1,12}))?)?(?:\ ?(?P<ap2>AA(?!A)|A\.A\.))?
  | (?P<c7>9{6})(?:[.,](?P<g>9{1,12}))?
)"""
_ZONE = r"""(?:
    \ ?(?:(?P<abbr0>A{2,3}))?(?P<sign>[-+−])(?P<oh>99)(?::?(?P<om>99))?
  | \ ?(?P<abbr>A{1,5})
  | \ (?P<zone2>A+/[A_/+-]+)
)"""
_WALL = re.compile(rf"{_DATE}(?:(?:,?\ |A|(?<=日)|\ ?,\ )(?={'(?:上午|下午|凌晨|早上|晚上|9)'}){_TIME}(?:{_ZONE})?(?:\ ?\[(?P<zone1>[A9_/+-]+)\])?)?", re.X)
_EPOCH = re.compile(r"(?:(?P<e10>9{10})|(?P<e13>9{13})|(?P<e16>9{16}))(?:\.(?P<ef>9{1,12}))?|(?P<c14>9{14})")


@lru_cache(maxsize=4096)
def parser_of(mask: str) -> dict[str, tuple[int, int]] | None:
    """Positions of the fields of a mask, or None for a shape that is no timestamp."""
    m = _EPOCH.fullmatch(mask) or _WALL.fullmatch(mask)
    return m and {k: m.span(k) for k, v in m.groupdict().items() if v is not None}


def clean(text: str) -> str:
    """Compatibility forms folded, control and format characters dropped, blanks single."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    return " ".join(text.split())


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970-01-01 and whether the date exists."""
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    y, m = np.where(ok, y, 1970), np.where(ok, m, 1)
    first = (y - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (m - 1).astype("timedelta64[M]")
    length = ((first + 1).astype("datetime64[D]") - first.astype("datetime64[D]")).astype(np.int64)
    return first.astype("datetime64[D]").astype(np.int64) + d - 1, ok & (d <= length)


class _Rows:
    """Rows of one mask as a matrix of code points."""

    def __init__(self, texts: list[str], at: dict[str, tuple[int, int]]):
        n = len(texts[0])
        self.codes = np.array(texts, dtype=f"<U{n}").view(np.uint32).reshape(len(texts), n)
        self.texts, self.at = texts, at

    def has(self, k: str) -> bool:
        return k in self.at

    def num(self, k: str, lo: int = 0, hi: int | None = None) -> np.ndarray:
        a, b = self.at[k]
        a, b = a + lo, b if hi is None else a + hi
        out = np.zeros(len(self.texts), np.int64)
        for i in range(a, b):
            out = out * 10 + (self.codes[:, i].astype(np.int64) - 48)
        return out

    def micros(self, k: str) -> np.ndarray:
        a, b = self.at[k]
        n = min(b - a, 6)
        return self.num(k, 0, n) * 10 ** (6 - n)

    def words(self, k: str) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.at[k]
        return np.unique(np.array([t[a:b] for t in self.texts], dtype=object).astype(str), return_inverse=True)


def _month(words: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    names, inv = words
    one = [MONTHS.index(w[:3]) + 1 if (w := x.lower()) in MONTH_NAMES or w in MONTHS or w == "sept" else 0 for x in names]
    return np.array(one, np.int64)[inv]


def _parse_mask(texts: list[str], at: dict, zones: np.ndarray, orders: np.ndarray, table: ZoneTable) -> tuple[np.ndarray, np.ndarray]:
    """UTC microseconds and validity of rows that share a mask."""
    r = _Rows(texts, at)
    n = len(texts)
    for k, unit in (("e10", 1_000_000), ("e13", 1000), ("e16", 1)):
        if r.has(k):
            us = r.num(k) * unit
            if r.has("ef"):
                us = us + r.micros("ef") // (1_000_000 // unit)
            return us, np.ones(n, bool)
    zero, ok = np.zeros(n, np.int64), np.ones(n, bool)
    if r.has("c14"):
        y, mo, d = r.num("c14", 0, 4), r.num("c14", 4, 6), r.num("c14", 6, 8)
        h, mi, s, us = r.num("c14", 8, 10), r.num("c14", 10, 12), r.num("c14", 12, 14), zero
    else:
        if r.has("y1"):
            y, mo, d = r.num("y1"), r.num("m1"), r.num("d1")
        elif r.has("y2"):
            y, mo, d = r.num("y2"), r.num("m2"), r.num("d2")
        elif r.has("y3"):
            p, q, y = r.num("p3"), r.num("q3"), r.num("y3")
            # without an order of the source only a day over 12 tells; else month first
            day_first = np.where(orders == "dmy", True, np.where(orders == "mdy", False, p > 12))
            mo, d = np.where(day_first, q, p), np.where(day_first, p, q)
        elif r.has("y4"):
            y, mo, d = r.num("y4"), _month(r.words("mon4")), r.num("d4")
        elif r.has("y5"):
            y, mo, d = r.num("y5"), _month(r.words("mon5")), r.num("d5")
        else:
            y, mo, d = r.num("c6", 0, 4), r.num("c6", 4, 6), r.num("c6", 6, 8)
        h = mi = s = us = zero
        if r.has("H"):
            h, mi = r.num("H"), r.num("M")
            s = r.num("S") if r.has("S") else zero
            us = r.micros("f") if r.has("f") else zero
        elif r.has("c7"):
            h, mi, s = r.num("c7", 0, 2), r.num("c7", 2, 4), r.num("c7", 4, 6)
            us = r.micros("g") if r.has("g") else zero
    abbr_extra = None
    for k in ("ap1", "ap2"):
        if r.has(k):
            names, inv = r.words(k)
            half = np.array([MERIDIEMS.get(x.lower(), -1) for x in names])[inv]
            known = half >= 0
            ok &= ~known | ((h >= 1) & (h <= 12)) | ((half == 1) & (h <= 23) & (h > 12))
            h = np.where(known & (h <= 12), h % 12 + 12 * np.maximum(half, 0), h)
            if not known.all():
                if k == "ap1" or r.has("abbr") or r.has("sign"):
                    ok &= known
                else:
                    abbr_extra = (names, inv, known)
    days, exists = _days(y, mo, d)
    ok &= exists & (h <= 23) & (mi <= 59) & (s <= 59)
    wall = days * 86400 + h * 3600 + mi * 60 + s
    if r.has("sign"):
        a = at["sign"][0]
        sign = np.where(r.codes[:, a] == ord("+"), 1, -1)
        om = r.num("om") if r.has("om") else zero
        oh = r.num("oh")
        if r.has("abbr0"):
            names, inv = r.words("abbr0")
            ok &= np.array([x.upper() in ("UTC", "GMT", "UT") for x in names])[inv]
        ok &= (oh <= 18) & (om <= 59)
        return (wall - sign * (oh * 3600 + om * 60)) * 1_000_000 + us, ok
    utc = np.zeros(n, np.int64)
    done = np.zeros(n, bool)
    words = r.words("abbr") if r.has("abbr") else (abbr_extra[0], abbr_extra[1]) if abbr_extra else None
    if words is not None:
        use = np.ones(n, bool) if r.has("abbr") else ~abbr_extra[2]
        for i, w in enumerate(words[0]):
            for z in np.unique(zones):
                at_ = use & (words[1] == i) & (zones == z)
                if at_.any():
                    off = table.abbreviation(str(w), z)
                    ok[at_] &= off is not None
                    utc[at_] = wall[at_] - (off or 0)
        done = use
    for k in ("zone1", "zone2"):
        if r.has(k) and not done.all():
            names, inv = r.words(k)
            for i, z in enumerate(names):
                at_ = ~done & (inv == i)
                if table.get(str(z)) is None:
                    ok[at_] = False
                utc[at_] = table.to_utc(wall[at_], str(z))
            done = np.ones(n, bool)
    for z in np.unique(zones[~done]):
        at_ = ~done & (zones == z)
        utc[at_] = table.to_utc(wall[at_], z)
    return utc * 1_000_000 + us, ok


def parse_many(texts: list, zones: list, orders: list, table: ZoneTable) -> tuple[np.ndarray, np.ndarray]:
    """UTC microseconds of ``texts`` and which of them name an instant."""
    n = len(texts)
    us, ok = np.zeros(n, np.int64), np.zeros(n, bool)
    by_mask: dict[str, list[int]] = {}
    cleaned: list = [None] * n
    for i, t in enumerate(texts):
        t = clean(t or "")
        if t:
            cleaned[i] = t
            by_mask.setdefault(t.translate(_MASK), []).append(i)
    zones = np.array([z if isinstance(z, str) and z else "UTC" for z in zones], dtype=object).astype(str)
    orders = np.array([o if isinstance(o, str) else "" for o in orders], dtype=object).astype(str)
    for mask, rows in by_mask.items():
        at = (parser_of if len(mask) <= KEPT_MASK else parser_of.__wrapped__)(mask)
        if at:
            i = np.array(rows)
            us[i], ok[i] = _parse_mask([cleaned[j] for j in rows], at, zones[i], orders[i], table)
    return us, ok


def utc_micros(text: Column, zone: Column, order: Column, table: ZoneTable) -> Column:
    """Column of UTC microseconds; null where the text names no instant."""

    @F.pandas_udf("long")
    def parse(t: pd.Series, z: pd.Series, o: pd.Series) -> pd.Series:
        us, ok = parse_many(t.tolist(), z.tolist(), o.tolist(), table)
        return pd.Series(pd.arrays.IntegerArray(us, ~ok))

    return parse(text.cast("string"), zone.cast("string"), order.cast("string"))


def normalize_times(df: DataFrame, text: str, source: str, clock: DataFrame, out: str = "utc_us") -> DataFrame:
    """``df`` with the instant of ``text`` as UTC microseconds in ``out``.

    ``clock`` (source, zone, date_order) is a dimension of one row a source; it is
    joined without a broadcast hint, so its measured size decides, and a source that it
    lists twice counts once.  Its zones (one entry each) are read on the driver
    to build the transition tables; a source that is null or not listed counts as UTC.
    """
    names = [r[0] for r in clock.select("zone").where("zone is not null").distinct().limit(MOST_ZONES + 1).collect()]
    if len(names) > MOST_ZONES:
        raise ValueError(f"more than {MOST_ZONES} zones")
    table = ZoneTable.build(sorted({*names, "UTC"}))
    dim = clock.groupBy(F.col("source").alias("__src")).agg(F.min(F.struct("zone", "date_order")).alias("__clk"))
    joined = df.join(dim, df[source] == F.col("__src"), "left")
    return joined.withColumn(out, utc_micros(F.col(text), F.col("__clk.zone"), F.col("__clk.date_order"), table)).drop("__src", "__clk")
