"""Personal data in free text, found and replaced by typed placeholders.

A semi-Markov conditional random field over whole spans: patterns propose candidate
segments of every type, each with features of the span as a whole (its shape, check digit,
name parts) and of the words and characters around it, whose weights are learned and not listed.  A segmentation is a set of
candidates that don't overlap; everything else is plain text.  Its score is the sum of its segments' scores,
and dynamic programming over the segments' ends finds the best one, which fixes boundaries and
types together.  Segments are bounded by their patterns, so the programme is linear in the text.

Weights are fitted by maximum likelihood, with the forward-backward sums of the same programme, on
labelled sentences made by :mod:`quaylight.llm.pii_samples`; fitting takes about a second, is
deterministic, and happens once on the driver.

Defined results: null and empty texts have no findings; offsets count characters of the text as it
stands, full-width forms included; texts are read whole; repeated texts give equal findings;
overlaps never occur; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import exp, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
#: Candidates in which a feature must occur to be learned.
FEW = 5

_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 32, 0x2010: 45, 0x2011: 45, 0x2012: 45, 0x2013: 45, 0x2212: 45, 0xA0: 32}
_HAN = "一-鿿"

# Words that open or join English sentences, so that a capital makes no given name of them.
COMMON_WORDS = frozenset(
    "a about after all also an and any as ask at because before both but by call cc dear did do email every find first for from give good great hello hey hi how i if in is it its last "
    "let maybe meet my new next no not note now of on one only or our per please regards says see send she signed since so some tell thank thanks that the their then there they this "
    "to today two we what when where which while who why will with yes you your he him his her attn contact copy meanwhile however yesterday tomorrow once out over".split()
)
TITLES = ("Dr", "Mr", "Mrs", "Ms", "Prof", "Sir", "Miss")
FUNCTION_CHARS = "的了是在和就不也都把被让给吗吧呢啊说有没这那与或及要会能去来格"
STREETS = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Dr\.?|Close|Court|Ct\.?|Place|Pl\.?|Way|Boulevard|Blvd\.?|Square|Sq\.?|Terrace|Row|Crescent|Parade|Highway|Hwy\.?)"

_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_])?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
EMAILS = {
    "plain": re.compile(rf"(?<![A-Za-z0-9._%+-]){_LOCAL}@(?:{_LABEL}\.)+[A-Za-z]{{2,24}}(?![A-Za-z0-9])"),
    "sign": re.compile(rf"(?<![A-Za-z0-9._%+-]){_LOCAL} ?(?:[\[({{<](?:at|AT|@)[\])}}>]|艾特|#at#) ?{_LABEL}(?:(?:\.| ?[\[({{<](?:dot|DOT|\.)[\])}}>] ?| ?点 ?){_LABEL})*(?:\.| ?[\[({{<](?:dot|DOT|\.)[\])}}>] ?| ?点 ?)[A-Za-z]{{2,24}}(?![A-Za-z0-9])"),
    "word": re.compile(rf"(?<![A-Za-z0-9._%+-]){_LOCAL} (?:AT|at) {_LABEL}(?: (?:DOT|dot) {_LABEL})* (?:DOT|dot) [A-Za-z]{{2,24}}(?![A-Za-z0-9])"),
    "spaced": re.compile(rf"(?<![A-Za-z0-9._%+-]){_LOCAL} @ {_LABEL}(?: \. {_LABEL})* \. [A-Za-z]{{2,24}}(?![A-Za-z0-9])"),
}
# Last labels of domains, by which an address is told from a word that runs on after it.
LAST_LABELS = frozenset(
    "com net org edu gov mil int info biz name pro io co ai app dev xyz site online shop club top vip me tv cc eu uk de fr es it nl be ch at se no dk fi pl cz pt gr ie ru ua tr il ae sa za ng ke eg in pk bd lk "
    "cn hk tw mo jp kr sg my th vn ph id au nz ca us mx br ar cl example invalid test localhost local".split()
)


def _emails(m: re.Match, k: str) -> Iterator[Span]:
    """The whole match, and what ends in a known last label where more letters run on."""
    whole = m.group()
    label = re.search(r"[A-Za-z]+$", whole).group()
    rest = len(whole) - len(label)
    for n in range(2, len(label) + 1):
        head, cut = label[:n], n < len(label)
        if cut and head.lower() not in LAST_LABELS:
            continue
        f = ["EMAIL", f"email {k}", "label known" if head.lower() in LAST_LABELS else "label unknown"]
        if cut:
            f.append("letters run on, new case" if label[n].isupper() and head.islower() else "letters run on")
        elif head.islower() != head.isalpha() and not head.isupper():
            f.append("case changes inside")
        yield Span(m.start(), m.start() + rest + n, "EMAIL", tuple(f))


_NB, _NA = r"(?<![0-9A-Za-z])(?<![0-9][-.])", r"(?![0-9])(?![-.][0-9])"
_CC = r"(?:\(\+?86\)|\+86|0086|86)[- ]?"
PHONES = {
    "cn": re.compile(rf"(?:(?<![0-9])(?<![0-9][-.])){_CC}1[3-9][0-9][- ]?[0-9]{{4}}[- ]?[0-9]{{4}}{_NA}|(?<![0-9])(?<![0-9][-.])1[3-9][0-9]([- ]?)[0-9]{{4}}\1[0-9]{{4}}{_NA}"),
    "nanp": re.compile(rf"(?<![0-9])(?<![0-9][-.])(?:\+?1[-. ])?(?:\([2-9][0-9]{{2}}\) ?|[2-9][0-9]{{2}}[-. ])[0-9]{{3}}[-. ][0-9]{{4}}{_NA}"),
    "uk": re.compile(rf"(?<![0-9])(?<![0-9][-.])(?:\+44 ?(?:\(0\))? ?|0044 ?|0)7[0-9]{{3}}[- ]?[0-9]{{3}}[- ]?[0-9]{{3}}{_NA}"),
    "other": re.compile(rf"(?<![0-9(])(?<![0-9][-.])\+[1-9][0-9]{{0,2}}(?:[-. ]?(?:\([0-9]{{1,4}}\)|[0-9]{{1,4}})){{2,5}}{_NA}"),
    "bare10": re.compile(rf"{_NB}[2-9][0-9]{{9}}{_NA}"),
    "land": re.compile(rf"(?<![0-9])(?<![0-9][-.])\(?0[0-9]{{2,3}}\)?[- ]?[0-9]{{7,8}}{_NA}"),
}
IDS = {
    "id18": re.compile(rf"(?<![0-9A-Za-z])(?<![0-9][-.])[0-9]{{6}}([- ]?)[0-9]{{8}}\1[0-9]{{3}}[0-9Xx](?![0-9A-Za-z])(?![-.][0-9])"),
    "id324": re.compile(rf"(?<![0-9A-Za-z])(?<![0-9][-.])[0-9]{{3}}([- ])[0-9]{{2}}\1[0-9]{{4}}(?![0-9A-Za-z])(?![-.][0-9])"),
}
_UNIT = r"(?:号楼|号院|号|栋|幢|座|单元|室|层|楼|弄)"
_ROAD_NO = re.compile(rf"(?:大道|路|街|巷|弄|胡同|道)([0-9]{{1,5}}(?:号院|号楼|号|弄|栋|幢)(?:[- ]?[0-9A-Za-z]{{1,5}}{_UNIT})*)")
#: Characters of a place's or road's name before its suffix: the longest names of provinces and prefectures have six.
_PLACE = f"[{_HAN}]{{2,6}}"
_PLACES = re.compile(rf"((?:{_PLACE}省)?(?:{_PLACE}市)?(?:{_PLACE}[区县镇乡])?)({_PLACE}[东南西北中]?(?:大道|路|街|巷|弄|胡同|道))$")
#: What province, city, district and road can hold together by that pattern.
_PLACES_MOST = 3 * 7 + 6 + 1 + 2
ENGLISH_ADDRESS = re.compile(rf"(?<![0-9A-Za-z.,-])[0-9]{{1,5}}[A-Z]?(?: [A-Z][a-z'’]+){{1,4}}?,? {STREETS}(?:,? (?:Unit|Apt\.?|Flat|Suite|Room|No\.|#) ?[0-9]{{1,5}}[A-Z]?)?(?:,(?: [A-Z][a-z'’]+){{1,3}},?(?: [A-Z]{{2}})? [0-9]{{4,6}}(?:-[0-9]{{4}})?)?(?![0-9])")


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    features: tuple[str, ...]


def narrow(text: str) -> str:
    """Full-width forms as plain ones, character for character."""
    return text if text.isascii() else text.translate(_WIDE)


def check_digit_ok(number: str) -> bool:
    """Whether the last of 18 characters is the check character of the others (ISO 7064, modulus 11-2)."""
    d = [c for c in number.upper() if c.isalnum()]
    if len(d) != 18 or not all(c.isdigit() for c in d[:17]):
        return False
    return "10X98765432"[sum(int(c) * pow(2, 17 - i, 11) for i, c in enumerate(d[:17])) % 11] == d[17]


_LATIN_BEFORE, _LATIN_AFTER = re.compile(r"[a-z]{1,20}$"), re.compile(r"[a-z]{1,20}")
_GAP = " :：(（【[#\"“-—/、,，。.)）】]"


def _kind_of(c: str) -> str:
    return "han" if "一" <= c <= "鿿" else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c


def around(t: str, s: int, e: int, kind: str) -> list[str]:
    """Features of what stands before and after a span: the neighbouring character, then the nearest word, or one and two characters of a script without words."""
    out = []
    left, right = t[max(0, s - 32) : s].lower(), t[e : e + 32].lower()
    for side, near, rest in (("<", left[-1:], left.rstrip(_GAP)), (">", right[:1], right.lstrip(_GAP))):
        out.append(f"{kind}{side}{_kind_of(near) if near else 'edge'}")
        if not rest:
            continue
        word = (_LATIN_BEFORE.search(rest) if side == "<" else _LATIN_AFTER.match(rest))
        if word:
            out.append(f"{kind}{side}{side}{word.group()}")
        else:
            one, two = (rest[-1:], rest[-2:]) if side == "<" else (rest[:1], rest[:2])
            out += [f"{kind}{side}{side}{one}", f"{kind}{side}{side}{two}"]
    return out


class Names:
    """Known name parts: all family names, some given names."""

    def __init__(self, family: Iterable[str], given: Iterable[str]):
        self.family, self.given = frozenset(family), frozenset(given)
        han = sorted((f for f in self.family if not f.isascii()), key=len, reverse=True)
        latin = sorted((f for f in self.family if f.isascii()), key=len, reverse=True)
        self.han = re.compile("|".join(map(re.escape, han))) if han else None
        one = "|".join(map(re.escape, latin))
        cap = r"[A-Z][a-z'’]+(?:-[A-Z][a-z]+)?"
        self.latin = re.compile(rf"(?<![A-Za-z0-9_.@])(?:{one})(?![A-Za-z0-9_@]|\.[A-Za-z0-9])") if latin else None
        self.before = (re.compile(rf"(?<![A-Za-z0-9_])({cap}|[A-Z]\.) $"), re.compile(rf"(?<![A-Za-z0-9_])({cap}|[A-Z]\.)(?: [A-Z]\.){{1,2}} $"))
        self.after = re.compile(rf", ({cap}|[A-Z]\.)(?: [A-Z]\.)?(?![A-Za-z@])")

    def spans(self, t: str) -> Iterator[Span]:
        if self.han:
            for m in self.han.finditer(t):
                for n in (2, 1):
                    given = t[m.end() : m.end() + n]
                    if len(given) < n or not all("一" <= c <= "鿿" for c in given):
                        continue
                    s, e = m.start(), m.end() + n
                    f = ["NAME", f"han{n}", "given known" if given in self.given else f"han{n} given unknown"]
                    if any(c in FUNCTION_CHARS for c in given):
                        f.append("function char")
                    yield Span(s, e, "NAME", tuple(f + self._around(t, s, e)))
        if self.latin:
            for m in self.latin.finditer(t):
                for middle, pattern in enumerate(self.before):
                    b = pattern.search(t, _tokens_back(t, m.start(), middle + 4), m.start())
                    if b and b.group(1).rstrip(".") not in TITLES:
                        g = b.group(1)
                        f = ["NAME", "initial" if g.endswith(".") else "given first", "given known" if g in self.given else "given unknown"]
                        f += ["middle initial"] * middle + ["common word as given"] * (g.lower() in COMMON_WORDS)
                        yield Span(b.start(1), m.end(), "NAME", tuple(f + self._around(t, b.start(1), m.end())))
                a = self.after.match(t, m.end())
                if a:
                    f = ["NAME", "comma form", "given known" if a.group(1) in self.given else "given unknown"]
                    yield Span(m.start(), a.end(), "NAME", tuple(f + self._around(t, m.start(), a.end())))

    @staticmethod
    def _around(t: str, s: int, e: int) -> list[str]:
        f = around(t, s, e, "NAME")
        if s == 0 and e == len(t):
            f.append("whole field")
        elif s == 0 and re.match(r" (?:[+(]{0,2}[0-9]|/ |\S{1,64}@)", t[e : e + 70]):
            f.append("contact follows")
        return f


def _tokens_back(t: str, at: int, n: int) -> int:
    """Where the n-th last token before a position begins."""
    for _ in range(n):
        at = t.rfind(" ", 0, at)
        if at < 0:
            return 0
    return at + 1


def candidates(text: str, names: Names) -> list[Span]:
    """All candidate segments of a text, by end."""
    t = narrow(text)
    out: list[Span] = []
    low = t.lower()
    if "@" in t or " at " in low or "at]" in low or "at)" in low or "at}" in low or "at>" in low or "艾特" in t or "#at#" in t:
        for k, p in EMAILS.items():
            for m in p.finditer(t):
                out += _emails(m, k)
    if any(c.isdigit() for c in t):
        for k, p in PHONES.items():
            for m in p.finditer(t):
                digits = sum(c.isdigit() for c in m.group())
                f = ["PHONE", f"phone {k}", "digits ok" if 10 <= digits <= 14 else "digits odd"]
                near = around(t, m.start(), m.end(), "PHONE")
                out.append(Span(m.start(), m.end(), "PHONE", tuple(f + near + [f"{k} {x}" for x in near if "<<" in x])))
        for k, p in IDS.items():
            for m in p.finditer(t):
                f = ["ID", k, *around(t, m.start(), m.end(), "ID")]
                if k == "id18":
                    f.append("check ok" if check_digit_ok(m.group()) else "check wrong")
                out.append(Span(m.start(), m.end(), "ID_NUMBER", tuple(f)))
        for m in _ROAD_NO.finditer(t):
            out += _han_addresses(t, m)
        for m in ENGLISH_ADDRESS.finditer(t):
            f = ["ADDRESS", "street"] + ["postcode"] * bool(re.search(r" [0-9]{4,6}$", m.group()))
            out.append(Span(m.start(), m.end(), "ADDRESS", tuple(f)))
    out += names.spans(t)
    one: dict[tuple[int, int, str], tuple[str, ...]] = {}
    for x in out:  # a span that several patterns propose is one candidate with the features of all
        k = x.start, x.end, x.kind
        one[k] = tuple(dict.fromkeys((*one.get(k, ()), *x.features)))
    return sorted((Span(*k, f) for k, f in one.items()), key=lambda s: (s.end, s.start))


def _han_addresses(t: str, m: re.Match) -> Iterator[Span]:
    """An address ends at its numbers; where it begins is a choice among the place names before them."""
    road_end = m.start(1)
    left = t[max(0, road_end - _PLACES_MOST) : road_end]
    base = road_end - len(left)
    for at in range(len(left)):
        p = _PLACES.match(left, at)
        if not p:
            continue
        head, road = p.groups()
        f = ["ADDRESS", "road number"]
        for suffix, name in (("省", "province"), ("市", "city"), ("区", "district"), ("县", "district")):
            if suffix in head:
                f.append(name)
        stem = re.sub(r"[东南西北中]?(?:大道|路|街|巷|弄|胡同|道)$", "", road)
        lengths = [len(x) for x in re.split("[省市区县镇乡]", head)[:-1]]
        f += [f"road of {min(len(stem), 4)}", *(f"place of {min(n, 4)}" for n in lengths)]
        if lengths:
            f.append(f"first place of {min(lengths[0], 4)}")
        if any(c in "省市区县" for c in stem):
            f.append("place inside road")
        before = t[base + at - 1 : base + at]
        f.append("address<" + (_kind_of(before) if before else "edge"))
        if before:
            f.append(f"address<<{before}")
        yield Span(base + at, m.end(1), "ADDRESS", tuple(f))


def _logsum(xs: list[float]) -> float:
    m = max(xs)
    return m + log(sum(exp(x - m) for x in xs))


class SemiCRF:
    """Weights of span features, the best segmentation, and the likelihood's gradient."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.w = weights or {}

    def score(self, s: Span) -> float:
        return sum(self.w.get(f, 0.0) for f in s.features)

    def best(self, spans: list[Span]) -> list[Span]:
        """The segmentation of greatest score; plain text scores 0. ``spans`` by end."""
        if not spans:
            return []
        total, back = [0.0], []
        ends = [s.end for s in spans]
        from bisect import bisect_right

        for i, s in enumerate(spans):
            j = bisect_right(ends, s.start, 0, i)  # segments that end before this one begins
            take = total[j] + self.score(s)
            if take > total[i]:
                total.append(take)
                back.append(j)
            else:
                total.append(total[i])
                back.append(-1)
        out, i = [], len(spans)
        while i:
            if back[i - 1] >= 0:
                out.append(spans[i - 1])
                i = back[i - 1]
            else:
                i -= 1
        return out[::-1]

    def marginals(self, spans: list[Span]) -> list[float]:
        """Probability of each candidate, by forward and backward sums."""
        n = len(spans)
        sc = [self.score(s) for s in spans]
        ends = [s.end for s in spans]
        from bisect import bisect_right

        j = [bisect_right(ends, s.start, 0, i) for i, s in enumerate(spans)]
        a = [0.0]
        for i in range(n):
            a.append(_logsum([a[i], a[j[i]] + sc[i]]))
        g = [0.0] * (n + 1)  # gradient of the log sum by each forward value
        g[n] = 1.0
        p = [0.0] * n
        for i in range(n - 1, -1, -1):
            p[i] = g[i + 1] * exp(a[j[i]] + sc[i] - a[i + 1])
            g[i] += g[i + 1] * exp(a[i] - a[i + 1])
            g[j[i]] += p[i]
        return p

    def fit(self, data: list[tuple[list[Span], set[tuple[int, int, str]]]], epochs: int = 40, rate: float = 0.08, shrink: float = 0.0003, batch: int = 32) -> "SemiCRF":
        """Adam on the mean log likelihood of the labelled segmentations less ``shrink`` times the squared weights.

        Features of fewer than ``FEW`` candidates get no weight.
        """
        often = Counter(f for spans, _ in data for s in spans for f in s.features)
        names = sorted(f for f, k in often.items() if k >= FEW)
        at = {f: i for i, f in enumerate(names)}
        data = [(spans, [[at[f] for f in s.features if f in at] for s in spans], gold) for spans, gold in data if spans]
        w = np.array([self.w.get(f, 0.0) for f in names])
        m, v, t = np.zeros_like(w), np.zeros_like(w), 0
        order, steps = np.random.default_rng(3), epochs * -(-len(data) // batch)
        for _ in range(epochs):
            for part in np.array_split(order.permutation(len(data)), -(-len(data) // batch)):
                self.w = dict(zip(names, w.tolist()))
                grad = -2 * shrink * w
                for i in part:
                    spans, features, gold = data[i]
                    for s, fs, p in zip(spans, features, self.marginals(spans)):
                        d = (float((s.start, s.end, s.kind) in gold) - p) / len(part)
                        for f in fs:
                            grad[f] += d
                t += 1
                m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
                w = w + rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.w = dict(zip(names, w.tolist()))
        return self


@lru_cache(maxsize=1)
def trained() -> SemiCRF:
    """The model fitted on the labelled sentences."""
    from quaylight.llm.pii_samples import NAMES, labelled

    return SemiCRF().fit([(candidates(t, NAMES), gold) for t, gold in labelled()])


def find(text: str | None, names: Names, model: SemiCRF) -> list[Span]:
    """Findings of one text."""
    return model.best(candidates(text, names)) if text else []


def redact_text(text: str | None, names: Names, model: SemiCRF) -> str | None:
    """The text with each finding replaced by its type in square brackets."""
    if not text:
        return text
    out, at = [], 0
    for s in find(text, names, model):
        out += [text[at : s.start], f"[{s.kind}]"]
        at = s.end
    return "".join([*out, text[at:]])


def names_of(parts: DataFrame) -> Names:
    """Name parts of a dimension table (name_part, kind) that doesn't grow; at most 100,000 are read."""
    rows = parts.where("name_part is not null").select("name_part", "kind").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("the table of name parts is too large to ship with each task")
    return Names([r[0] for r in rows if r[1] == "family"], [r[0] for r in rows if r[1] == "given"])


def redact(text: Column, names: Names) -> Column:
    """Column of redacted texts; null stays null."""
    model = trained()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: redact_text(x, names, model) if isinstance(x, str) else None)

    return run(text.cast("string"))


def findings(fields: DataFrame, names: Names) -> DataFrame:
    """Distinct findings of rows (tbl, row_key, place, text): tbl, row_key, place, kind, found_text."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, str, str]] = []
            for i, t in enumerate(b.column(3).to_pylist()):
                out += ((i, s.kind, t[s.start : s.end]) for s in find(t, names, model))
            at = pa.array([x[0] for x in out], pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(3)), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())], names=["tbl", "row_key", "place", "kind", "found_text"])

    rows = fields.select("tbl", "row_key", "place", "text").where("text is not null and text <> ''")
    return rows.mapInArrow(run, "tbl string, row_key string, place string, kind string, found_text string").distinct()
