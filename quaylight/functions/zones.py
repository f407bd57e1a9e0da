"""Versioned zone transition tables for vectorised local-time conversion.

A :class:`ZoneTable` holds, for each zone, the instants at which its offset
changes and the offsets on either side, as sorted integer arrays.  It is built
once on the driver from the installed time zone database, carries that
database's version, and is shipped whole, so every executor converts by the same
rules whatever its own files say.  A zone named inside a value and absent from
the table is added on the worker when first met.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: Instants between which changes are looked up; outside, the nearest offset holds.
_FROM, _TO = datetime(1900, 1, 1, tzinfo=timezone.utc), datetime(2100, 1, 1, tzinfo=timezone.utc)
_STEP = timedelta(days=14)

# Offsets in minutes of abbreviations, for sources whose own zone doesn't use them.
COMMON_ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "IST": 330, "HKT": 480, "SGT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}


def database_version() -> str:
    """Version of the time zone database in use, ``unknown`` if it can't be told."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except Exception:
        pass
    try:
        with open("/usr/share/zoneinfo/tzdata.zi") as f:
            return f.readline().split()[-1]
    except OSError:
        return "unknown"


@dataclass(frozen=True)
class Zone:
    """One zone: ``bounds[i]`` is the wall second from which ``offsets[i + 1]`` holds.

    A wall time that occurs twice, or never, keeps the offset before the change:
    the bound lies at the later wall reading of the change, which gives the
    earlier of two instants and reads a skipped time as if the clock hadn't moved.
    """

    bounds: np.ndarray
    offsets: np.ndarray
    abbreviations: dict[str, int]


def _offset(z: ZoneInfo, at: datetime) -> tuple[int, str]:
    local = at.astimezone(z)
    return int(local.utcoffset().total_seconds()), local.tzname() or ""


def build_zone(name: str) -> Zone:
    """The transitions of ``name``: coarse sampling, then halving to the second."""
    z = ZoneInfo(name)
    at, (off, abbr) = _FROM, _offset(z, _FROM)
    bounds, offsets, abbrs = [], [off], {abbr.upper(): off}
    while at < _TO:
        nxt = at + _STEP
        new, new_abbr = _offset(z, nxt)
        if (new, new_abbr) != (off, abbr):
            lo, hi = at, nxt
            while hi - lo > timedelta(seconds=1):
                mid = lo + timedelta(seconds=int((hi - lo).total_seconds()) // 2)
                if _offset(z, mid) == (off, abbr):
                    lo = mid
                else:
                    hi = mid
            new, new_abbr = _offset(z, hi)
            if new != off:
                bounds.append(int((hi - _EPOCH).total_seconds()) + max(off, new))
                offsets.append(new)
            off, abbr, at = new, new_abbr, hi
            abbrs[abbr.upper()] = off
        else:
            at = nxt
    return Zone(np.array(bounds, np.int64), np.array(offsets, np.int64), {k: v for k, v in abbrs.items() if k.isalpha()})


@dataclass
class ZoneTable:
    """Transition tables of a set of zones, with the database version they came from."""

    version: str
    zones: dict[str, Zone] = field(default_factory=dict)

    @classmethod
    def build(cls, names: list[str]) -> "ZoneTable":
        t = cls(database_version())
        for n in names:
            t.get(n)
        return t

    def get(self, name: str) -> Zone | None:
        """The zone, or None for a name the database doesn't have."""
        if name not in self.zones:
            try:
                self.zones[name] = build_zone(name)
            except Exception:
                self.zones[name] = None
        return self.zones[name]

    def to_utc(self, wall: np.ndarray, zone: str) -> np.ndarray:
        """Wall seconds of ``zone`` to UTC seconds; an unknown zone counts as UTC."""
        z = self.get(zone)
        if z is None:
            return wall
        return wall - z.offsets[np.searchsorted(z.bounds, wall, side="right")]

    def abbreviation(self, abbr: str, zone: str) -> int | None:
        """Seconds east of UTC that ``abbr`` means in ``zone``, else commonly, else None."""
        z, abbr = self.get(zone), abbr.upper()
        if abbr in ("UTC", "GMT", "Z", "UT"):
            return 0
        if z is not None and abbr in z.abbreviations:
            return z.abbreviations[abbr]
        m = COMMON_ABBREVIATIONS.get(abbr)
        return None if m is None else m * 60
