"""Texts that lost their end.

Two kinds of evidence, for every text:

* Near copies.  Texts that share bands of MinHash over five-word shingles and are alike by 0.8 or
  more are aligned.  A copy whose end lies inside the other one ends early; it is cut if the other goes on within
  the word, number or link there, whatever its own end looks like.
* Closing-word terminality, for texts that no copy decides.  How a text closes is reduced to a class of its closing
  word or mark (``closing``).  How often each class stands at positions inside texts is counted by cutting every text at
  ``INSIDE`` places drawn by its hash; how often it stands at the end, by reading every text.  Ends are a
  mixture of whole texts and of texts cut anywhere, so the rate of cut texts is the ratio of both counts in the class
  that is most frequent inside, and a class's ends are cut as far as that rate explains them.  Tags, names and link shapes carry what is
  known of them: whether they stand complete inside texts, or are the beginning of one that does.  Marks put after the end
  (dots, a note, half a character) are told apart by how often cut and whole texts carry them.

No rule says that a class is cut: ``PRIOR`` rows of opinion a class decide only where a table is too small to tell.

Defined results: null, empty and blank texts are whole; exact copies share their result; repeated rows give one; texts
are read whole, of any length; an empty table gives an empty result; a null source is a source of its own in the shares.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.llm import minhash as M
from quaylight.session import materialize

BANDS, ROWS = 16, 6
K = BANDS * ROWS
WORDS = 5
LIKE = 0.8
#: Characters that an end must share with a copy to be laid on it.
LEAST_TAIL = 12
#: Places at which each text is cut to count what stands inside.
INSIDE = 3
#: Share of cut rows of a class from which its ends count as cut.
CUT_SHARE = 0.5
#: Bounds of the levels of how common a link shape is among complete links.
COMMON = (0.005, 0.05)
#: Rows of opinion a class, cut and whole, that small tables fall back on.
PRIOR = {"cut": (20.0, 1.0), "whole": (0.0, 20.0), "remark": (1.0, 5.0)}
LINK, TAG, NAME = "link", "tag", "name"

# Marks that close a sentence, and closers that may follow them.
STOPS = "。.!！?？…"
CLOSERS = "\"'”’」』》）)】]"
_TRAIL = re.compile(r"(?:[\s\u00ad\u200b-\u200f\u2028-\u202e\u2060-\u2064\ufeff\x00-\x1f\x7f-\x9f]|&nbsp;|<(?:/[a-zA-Z]\w*|br ?/?)>)+$")
_BREAK_MARK = re.compile(r"(?:\.{3,}|…+|\[(?:\.{3}|…)\]|\((?:truncated|cut off)\)|\[truncated\]|（未完(?:待续)?）)$", re.I)
_STOP_END = re.compile(f"[{re.escape(STOPS)}][{re.escape(CLOSERS)}`*_~]*$")
_STOP_INSIDE = re.compile(r"[。!！?？…]\W*\w|\.\s+\w|\n")
_LINK_END = re.compile(r"https?:/?/?[^\s)\]>]*$")
_LINK_CLOSED = re.compile(r"\]\((https?:[^\s)]*)\)$")
_TAGS_END = re.compile(r"(?:^|\s)#([^\s#]+)$")
_NAME_LINE = re.compile(r"^(?:--|——|—)\s+(\S.{0,40})$")
_LINKS_IN = re.compile(r"https?://[^\s)\]>，。]+(?=[\s)\]>])")
_TAGS_IN = re.compile(r"(?:^|(?<=\s))#([^\s#]+)(?=\s)")
_NAMES_IN = re.compile(r"\*\*([^*\n]{1,40})\*\*:|/ ([^/\]\n]{1,40})\] ")
_OPENERS = {"）": "（", ")": "(", "]": "[", "】": "【", "”": "“", "」": "「"}


def link_shape(url: str) -> str:
    """Labels of the host and class of each path segment: h2/a/9."""
    rest = url.partition("://")[2]
    rest = rest.partition("?")[0]
    host, *path = rest.split("/")
    kind = ["9" if s.isdigit() else "a" if s.isalpha() else "x" if s else "" for s in path]
    return "/".join([f"h{host.count('.') + 1 if host else 0}{'' if not host.endswith('.') else '.'}", *kind])


def _at_end(pattern: re.Pattern, t: str) -> re.Match | None:
    """The pattern's match at the end of a text, sought in a tail that grows while the match begins with it."""
    n = 64
    while True:
        m = pattern.search(t, max(0, len(t) - n))
        if m is None or n >= len(t) or m.start() > len(t) - n:
            return m
        n *= 4


def _bare(text: str) -> str:
    m = _at_end(_TRAIL, text)
    return text[: m.start()] if m else text


def _unmarked(text: str) -> tuple[str, str]:
    """A text without what was put after its end, and which kind of mark that was."""
    t = _bare(text)
    if t.endswith("\ufffd"):
        return t.rstrip("\ufffd"), "half character"
    m = _at_end(_BREAK_MARK, t)
    if m:
        before, mark = _bare(t[: m.start()]), m.group()
        if before:
            return before, {"…": "ellipsis" if len(mark) == 1 else "long ellipsis", ".": "dots"}.get(mark[0], "note")
    return t, ""


def closing(text: str) -> tuple[str, str, str]:
    """Class of the closing word or mark, the item by which it may be known elsewhere, and the mark after it.

    Classes tell sentence marks, brackets, fences, emphasis, emoji, links, tags and signatures, words, numbers and other marks. After
    a word, number or other mark it counts whether the text has any sentence or line before, and if not, how long it is.
    """
    t, mark = _unmarked(text)
    if not t:
        return "blank", "", mark
    if t.count("```") % 2:
        return "open fence", "", mark
    if t.endswith("```"):
        return "fence", "", mark
    last = t[t.rfind("\n") + 1 :].strip()
    m = _LINK_END.search(last)
    if m:
        return LINK, link_shape(m.group()), mark
    if _LINK_CLOSED.search(last):
        return "closed link", "", mark
    m = _NAME_LINE.match(last)
    if m:
        return NAME, m.group(1), mark
    m = _TAGS_END.search(last)
    if m:
        return TAG, m.group(1), mark
    if _at_end(_STOP_END, t):
        return "stop", "", mark
    c = t[-1]
    if c in _OPENERS:
        return ("bracket" if _OPENERS[c] in t else "lone bracket"), "", mark
    if c in "*_~":
        inner = last.strip("*_~")
        return ("emphasis" if inner and last.count(c) % 2 == 0 and not last.endswith(" " + c * 2) else "open emphasis"), "", mark
    kind = unicodedata.category(c)
    if kind in ("So", "Sk", "Mn", "Me", "Cf", "Co") or c == "\u20e3":
        return "emoji", "", mark
    word = {"L": "word", "N": "number"}.get(kind[0], "other")
    before = "after a sentence" if _STOP_INSIDE.search(t) else "in a short line" if len(t) < 64 else "in a long line"
    return f"{word} {before}", "", mark


def complete_items(text: str) -> Iterator[tuple[str, str]]:
    """(kind, item) of links' shapes, tags and names that stand complete inside a text."""
    if "http" in text:
        yield from ((LINK, link_shape(u)) for u in _LINKS_IN.findall(text))
    if "#" in text:
        yield from ((TAG, x) for x in _TAGS_IN.findall(text))
    if "**" in text or "/ " in text:
        yield from ((NAME, a or b) for a, b in _NAMES_IN.findall(text))


def opinion(cls: str) -> tuple[float, float]:
    """Prior rows, cut and whole, of a class."""
    if cls.startswith(("word", "number", "other")):
        return PRIOR["remark" if cls.endswith("short line") else "cut"]
    return PRIOR["cut" if cls.startswith(("open", "lone")) or cls.endswith(("begun", "rare", "never")) else "whole"]


def fit_terminality(ends: dict[tuple[str, str], int], inside: dict[str, int], rounds: int = 20) -> dict[tuple[str, str], float]:
    """Share of cut rows among the ends of each (class, mark), from counts at ends and of classes at places inside."""
    if not ends:
        return {}
    classes = sorted({c for c, _ in ends} | set(inside))
    marks = sorted({m for _, m in ends})
    n = np.zeros((len(classes), len(marks)))
    for (c, m), k in ends.items():
        n[classes.index(c), marks.index(m)] = k
    within = np.array([inside.get(c, 0) + 0.5 for c in classes])
    within /= within.sum()
    rows, total = n.sum(1), n.sum()
    top = within.argmax()
    rate = min(0.5, rows[top] / total / within[top])
    for_cut, for_whole = np.array([opinion(c) for c in classes]).T
    share = (np.minimum(rate * within * total, rows) + for_cut) / (rows + for_cut + for_whole)
    post = np.repeat(share[:, None], len(marks), 1)
    for _ in range(rounds):
        cut = (n * post).sum(0) + 0.5
        whole = (n * (1 - post)).sum(0) + 0.5
        own = n * (1 - post)
        # whole texts of a class have their own way with marks, drawn to that of all
        whole = (own + 5 * whole / whole.sum()) / (own.sum(1, keepdims=True) + 5)
        s = np.clip(share, 1e-6, 1 - 1e-6)[:, None]
        odds = s / (1 - s) * (cut / cut.sum()) / whole
        post = odds / (1 + odds)
    return {(c, m): float(post[i, j]) for i, c in enumerate(classes) for j, m in enumerate(marks)}


def word_shingles(texts: list[str], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words, and each text's bounds in them.

    A word is a run of letters and digits of an alphabet, or one character of a script
    without spaces; marks and white space only part words.  A shorter text is one shingle.
    """
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    c = codes.astype(np.uint64)
    upper = (codes >= 65) & (codes <= 90)
    c[upper] += np.uint64(32)
    single = ((codes >= 0x2E80) & (codes < 0xA960) & ~((codes >= 0x3000) & (codes < 0x3040))) | ((codes >= 0xF900) & (codes < 0xFB00)) | (codes >= 0x20000)
    letter = ((codes >= 48) & (codes <= 57)) | ((c >= 97) & (c <= 122)) | ((codes >= 0xAA) & (codes < 0x2000) & (codes != 0xAB) & (codes != 0xB7) & (codes != 0xBB) & (codes != 0xD7) & (codes != 0xF7)) | ((codes >= 0xAC00) & (codes < 0xD7B0))
    prev = np.concatenate([[False], letter[:-1]])
    start = np.nonzero(single | (letter & ~prev))[0]
    bounds = np.zeros(len(texts) + 1, np.int64)
    if len(start) == 0:
        return np.empty(0, np.uint64), bounds
    h = M.mix(c * M._ODD[0] + M._ODD[1])
    pos = np.arange(len(c), dtype=np.uint64)
    word_of = np.cumsum(single | (letter & ~prev)) - 1
    use = single | letter
    offset = pos[use] - start[word_of[use]].astype(np.uint64)
    words = np.zeros(len(start), np.uint64)
    np.add.at(words, word_of[use], h[use] * (offset * np.uint64(2) * M._ODD[2] + M._ODD[3]))
    text_of = np.searchsorted(ends, start, side="right")
    n = np.bincount(text_of, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    sh = sum(padded[i : i + len(words)] * M._ODD[i] for i in range(size))
    left = n[text_of] - (np.arange(len(words)) - first[text_of])
    keep = left >= size
    short = (n[text_of] < size) & (left == n[text_of])
    for i in np.nonzero(short)[0]:
        k = int(left[i])
        sh[i] = (padded[i : i + k] * M._ODD[:k]).sum(dtype=np.uint64)
    keep |= short
    np.cumsum(np.bincount(text_of[keep], minlength=len(texts)), out=bounds[1:])
    return M.mix(sh[keep]), bounds


def _bands(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    table = M._shifts()[:, :K]
    cell = (hashes >> np.uint64(44)).astype(np.int64)
    sig = np.full((len(bounds) - 1, K), 0xFFFFFFFF, np.uint32)
    for i in range(len(sig)):
        for lo in range(bounds[i], bounds[i + 1], 4096):
            np.minimum(sig[i], table[cell[lo : min(lo + 4096, bounds[i + 1])]].min(axis=0), out=sig[i])
    s = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    h = np.zeros((len(sig), BANDS), np.uint64)
    for j in range(ROWS):
        h = M.mix(h + s[:, :, j] * M._ODD[j] + M._ODD[5])
    return M.mix(h ^ (np.arange(1, BANDS + 1, dtype=np.uint64) * M._ODD[6])).view(np.int64)


def _inside(text: str, digest: bytes) -> Iterator[str]:
    """The text cut at places drawn by its hash."""
    for i in range(INSIDE):
        at = 1 + int.from_bytes(digest[5 * i : 5 * i + 5], "little") % max(1, len(text) - 1)
        if text[:at].strip():
            yield text[:at]


_READ = "what string, id long, d0 long, d1 long, cls string, item string, mark string, n long, open boolean, bands array<long>"


def _read(docs: DataFrame) -> DataFrame:
    """One pass, no shuffle: rows ``end`` (one a text, with its digest, closing, whether a copy can show that it goes on, and bands), and
    counts of closings at places ``inside`` and of ``item`` that stand complete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        names = [x.split()[0] for x in _READ.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]

        def counted() -> pa.RecordBatch:
            k = list(counts)
            none = [None] * len(k)
            cols = [[x[0] for x in k], none, none, none, [x[1] for x in k], [x[2] for x in k], none, list(counts.values()), none, none]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds)], names=names)

        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                texts = b.column(1).to_pylist()
                n = len(texts)
                digests = [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
                ends = [closing(t) for t in texts]
                for t, dig in zip(texts, digests):
                    for x in _inside(t, dig):
                        c = closing(x)
                        counts["inside", c[0], c[1]] += 1
                    counts.update(("item", k, i) for k, i in complete_items(t))
                dig = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                bands = _bands(*word_shingles(texts))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
                cols = [["end"] * n, b.column(0), dig[:, 0].copy(), dig[:, 1].copy(), *([e[i] for e in ends] for i in range(3)), [1] * n, [may_go_on(t) for t in texts]]
                yield pa.RecordBatch.from_arrays([*(v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(cols, kinds)), lists], names=names)
            if len(counts) > 50_000:
                yield counted()
        if counts:
            yield counted()

    return docs.mapInArrow(run, _READ)


def _aligned(short: pd.Series, long: pd.Series) -> pd.Series:
    """Whether the first text of a pair is a near copy of the second and ends early, unfinished."""
    return pd.Series([x is not None and y is not None and ends_early(x, y) and _alike(x, y) for x, y in zip(short.tolist(), long.tolist())], dtype=bool)


def _alike(x: str, y: str) -> bool:
    """Whether the sets of word shingles are alike by ``LIKE`` or more."""
    p, pb = word_shingles([x, y])
    s, t = set(p[: pb[1]].tolist()), set(p[pb[1] :].tolist())
    k = len(s & t)
    return k >= LIKE * (len(s) + len(t) - k)


def may_go_on(text: str | None) -> bool:
    """Whether a text ends so that ``ends_early`` can hold against some copy: all others needn't be compared."""
    s = _unmarked(text or "")[0]
    return len(s) >= LEAST_TAIL and (s[-1].isalnum() or s[-1] in "-_/.#")


def ends_early(short: str, long: str) -> bool:
    """Whether the end of ``short`` aligns with the inside of ``long`` and stops within a word, number or link there.

    The end is laid where most characters before it agree; of several such places, where it stands in ``short``.
    After a stop only a digit or a small letter goes on: ``3.`` of ``3.5``, ``example.`` of ``example.org``.
    """
    s, t = _unmarked(short)[0], _bare(long)
    if len(s) < LEAST_TAIL or s[-LEAST_TAIL:] not in t:
        return False
    lo, hi = LEAST_TAIL, min(len(s), len(t))
    while lo < hi:
        n = (lo + hi + 1) // 2
        lo, hi = (n, hi) if s[-n:] in t else (lo, n - 1)
    tail, own = s[-lo:], len(s) - lo
    places = [x for x in (t.rfind(tail, 0, len(s)), t.find(tail, own)) if x >= 0]
    nxt = min(places, key=lambda x: abs(x - own)) + lo
    if nxt >= len(t):
        return False
    c, d = t[nxt - 1], t[nxt]
    if c == "." and not _LINK_END.search(s[s.rfind("\n") + 1 :]):
        return t[nxt - 2].isascii() and t[nxt - 2].isalnum() and d.isascii() and (d.isdigit() or d.islower())
    return not d.isspace() and d not in STOPS + CLOSERS + "，,；;：:、" and (c.isalnum() or c in "-_/.#") and (d.isalnum() or d in "-_/.")


def _known(closings: DataFrame, items: DataFrame) -> DataFrame:
    """Closings with ``cls`` told further by what is known of their item among complete ones."""
    total = items.where(F.col("kind") == LINK).agg(F.sum("n")).first()[0]
    begun = items.where(F.col("kind").isin(TAG, NAME) & (F.length("item") > 1))
    begun = begun.select("kind", F.explode(F.expr("transform(sequence(1, length(item) - 1), i -> substring(item, 1, i))")).alias("item")).distinct().withColumn("begun", F.lit(True))
    j = closings.where(F.col("cls").isin(LINK, TAG, NAME)).withColumnRenamed("n", "rows").withColumn("kind", F.col("cls"))
    j = j.join(items, ["kind", "item"], "left").join(begun, ["kind", "item"], "left")
    share = F.coalesce(F.col("n"), F.lit(0)) / F.lit(total or 1)
    links = F.when(F.lit(total is None), "unknown").when(share == 0, "never").when(share < COMMON[0], "rare").when(share < COMMON[1], "known").otherwise("common")
    other = F.when(F.col("n").isNotNull(), "known").when(F.col("begun"), "begun").otherwise("new")
    told = F.concat(F.col("kind"), F.lit(" "), F.when(F.col("kind") == LINK, links).otherwise(other))
    return closings.where(~F.col("cls").isin(LINK, TAG, NAME)).unionByName(j.withColumn("cls", told).withColumn("n", F.col("rows")).select(*closings.columns))


def find_cut(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row a cut record: key, reason (``copy goes on``, else the class of its closing and its mark)."""
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")
    seen = materialize(_read(docs), "endings")
    ends = seen.where("what = 'end'")
    # near copies, between one representative of each exact copy: every text whose end may go on is held against all others of its buckets
    reps = ends.groupBy("d0", "d1").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.bool_or("open").alias("open"))
    pairs = materialize(M.bucket_pairs_from(reps.select(F.explode("bands").alias("key"), F.col("rep").alias("id"), "open")), "pairs")
    need = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    t = docs.select("id", "text").join(need, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
    both = pairs.join(t.toDF("a", "ta"), "a").join(t.toDF("b", "tb"), "b")
    early = both.where(F.pandas_udf(_aligned, "boolean")(F.col("ta"), F.col("tb"))).select(F.col("a").alias("id")).distinct()
    early = ends.join(early, "id", "left_semi").select("d0", "d1").distinct().withColumn("early", F.lit(True))
    # terminality of the others
    items = materialize(seen.where("what = 'item'").groupBy(F.col("cls").alias("kind"), "item").agg(F.sum("n").alias("n")), "items")
    closings = materialize(_known(seen.where("what <> 'item'").select("what", "id", "d0", "d1", "cls", "item", F.coalesce("mark", F.lit("")).alias("mark"), "n"), items), "closings")
    ends_n, inside_n = {}, Counter()
    for r in closings.groupBy("what", "cls", "mark").agg(F.sum("n").alias("n")).collect():  # classes and marks: at most some two hundred rows
        if r.what == "inside":
            inside_n[r.cls] += r.n
        elif r.cls != "blank":
            ends_n[r.cls, r.mark] = r.n
    cut = [(c, m, p) for (c, m), p in fit_terminality(ends_n, inside_n).items() if p > CUT_SHARE]
    told = F.array(*[F.lit(f"{c}\0{m}") for c, m, _ in cut]).cast("array<string>")
    rows = closings.where("what = 'end'").join(early, ["d0", "d1"], "left").where(F.col("early") | F.array_contains(told, F.concat_ws("\0", "cls", "mark")))
    reason = F.when(F.col("early"), "copy goes on").otherwise(F.concat_ws(", then ", "cls", F.when(F.col("mark") != "", F.col("mark"))))
    return rows.groupBy("id").agg(F.min(reason).alias("reason")).select(F.col("id").alias(key), "reason")


def share_by_source(df: DataFrame, cut: DataFrame, key: str, source: str) -> DataFrame:
    """source, records, cut, share of cut records; records counted once."""
    rows = df.select(key, source).distinct().join(cut.select(key, F.lit(1).alias("__cut")), key, "left")
    return rows.groupBy(source).agg(F.count("*").alias("records"), F.count("__cut").alias("cut")).withColumn("share", F.col("cut") / F.col("records"))
