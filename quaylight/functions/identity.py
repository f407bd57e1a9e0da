"""Identity of links and texts.

Expressions that the built-in functions can say are columns; the others are Arrow-batched
functions over the distinct values of a batch.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What is removed from links, hosts that mean one site, and lengths.
TRACKERS = frozenset(
    ["from", "from_source", "_from", "spm", "scene", "fbclid", "gclid", "ref", "ref_src", "refer", "referer", "referrer", "src", "source", "wxshare", "weibo_id", "timestamp", "ts", "_t"]
)
TRACKER_PREFIXES = ("utm_", "share")
POST_HOSTS = frozenset(["twitter.com", "mobile.twitter.com", "fxtwitter.com", "vxtwitter.com", "fixupx.com", "fixvx.com", "x.com"])
END_MARKS = ".,;!?\"'。，；：！？"
BARE_LINK_CHARS = 10
FINGERPRINT_CHARS = 24

# Shapes of links and what is no substance. The same text works in the dialects of Spark, DuckDB and Python.
MD_LINK = r"\[([^\]\n]+)\]\((https?://[^)\s]+)\)"
BARE_LINK = r"https?://[^\s<>（）【】《》「」『』，。；：！？、一-鿿]+"
NOT_SUBSTANCE = r"[\p{P}\p{S}\p{Z}\p{C}\s]"

# Paths of posts, articles and videos.
_POST = re.compile(r"/(?:i/web/)?(?:\w+/)?status(?:es)?/(\d+)(?:/|$)", re.A)
_ARTICLE = re.compile(r"/(?:i/article|\w+/articles)/([\w-]+)(?:/|$)", re.A)
_VIDEO = re.compile(r"BV[0-9A-Za-z]{10}")


def body_without_links(text: Column) -> Column:
    """Labels of markdown links stay, bare links become a blank."""
    return F.regexp_replace(F.regexp_replace(text, MD_LINK, "$1"), BARE_LINK, " ")


def substance(text: Column) -> Column:
    """Text without marks, symbols, blanks and control characters."""
    return F.regexp_replace(text, NOT_SUBSTANCE, "")


def is_bare_link(text: Column) -> Column:
    """At least one link and hardly anything said about it."""
    return F.coalesce((F.regexp_like(text, F.lit(BARE_LINK))) & (F.length(substance(body_without_links(text))) <= BARE_LINK_CHARS), F.lit(False))


def text_fingerprint(text: Column) -> Column:
    """SHA-1 of the comparable body in lower case; null under 24 characters. Compatibility forms stay apart."""
    body = substance(F.lower(body_without_links(text)))
    return F.when(F.length(body) >= FINGERPRINT_CHARS, F.sha1(body))


def _mapped(f: Callable, kind: str) -> Callable[[Column], Column]:
    """A column function that computes each distinct value of a batch once."""

    def column(c: Column) -> Column:
        @F.pandas_udf(kind)
        def run(s: pd.Series) -> pd.Series:
            done = {x: f(x) for x in s.dropna().unique()}
            none = f(None)
            return pd.Series([done.get(x, none) if isinstance(x, str) else none for x in s], dtype=object)

        return run(c.cast("string"))

    return column


def folded_fingerprint(text: str | None) -> str | None:
    """As ``text_fingerprint``, with compatibility forms and case folded."""
    body = re.sub(BARE_LINK, " ", re.sub(MD_LINK, r"\1", text or ""))
    kept = [c for c in unicodedata.normalize("NFKC", body).casefold() if not c.isspace() and unicodedata.category(c)[0] not in "PSZC"]
    return hashlib.sha1("".join(kept).encode()).hexdigest() if len(kept) >= FINGERPRINT_CHARS else None


def trimmed_link(url: str) -> str:
    """Without marks of the sentence around it; a closing bracket stays only with its opening one."""
    while True:
        cut = url.rstrip(END_MARKS)
        if cut.endswith(")") and cut.count(")") > cut.count("("):
            cut = cut[:-1]
        if cut == url:
            return url
        url = cut


def links_of(text: str | None) -> list[str]:
    """Links of markdown, then bare links of what remains, each in order of appearance."""
    if not text:
        return []
    marked = [m.group(2) for m in re.finditer(MD_LINK, text)]
    rest = re.sub(MD_LINK, r" \1 ", text)
    return marked + [u for u in map(trimmed_link, re.findall(BARE_LINK, rest)) if u]


def _kept_query(query: str) -> str:
    pairs = sorted((k, v) for k, v in parse_qsl(query, keep_blank_values=True) if k.lower() not in TRACKERS and not k.lower().startswith(TRACKER_PREFIXES))
    return urlencode(pairs)


def canonical_link(url: str | None) -> str | None:
    """One name for one target: post and article ids, video ids, else the link without trackers."""
    try:
        u = urlsplit((url or "").strip())
        host, port = (u.hostname or "").lower().removeprefix("www."), u.port
    except ValueError:
        return None
    if not host:
        return None
    if host in POST_HOSTS:
        for pattern, to in ((_POST, "x.com/status/"), (_ARTICLE, "x.com/i/article/")):
            if m := pattern.match(u.path):
                return to + m.group(1)
    if host.endswith("bilibili.com") and (m := _VIDEO.search(u.path)):
        return "bilibili.com/video/" + m.group()
    return urlunsplit((u.scheme.lower() or "https", f"{host}:{port}" if port else host, u.path.rstrip("/"), _kept_query(u.query), ""))


def stored_link(url: str | None) -> str:
    """The other identity, that of stored entries: host kept whole, no site rules."""
    url = (url or "").strip()
    try:
        u = urlsplit(url)
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return url
    if not u.scheme and not u.netloc:
        return url
    return urlunsplit((u.scheme.lower(), f"{host}:{port}" if port else host, u.path.rstrip("/"), _kept_query(u.query), ""))


def link_keys(text: str | None) -> list[str]:
    """Sorted canonical links of a text."""
    return sorted({c for c in map(canonical_link, links_of(text)) if c})


def seen_keys(text: str | None) -> list[str]:
    """Keys by which a text is known: its fingerprint, then each canonical link's hash."""
    fp = folded_fingerprint(text)
    return ([f"text:{fp}"] if fp else []) + [f"url:{hashlib.sha1(u.encode()).hexdigest()}" for u in link_keys(text)]


def index_keys(text: str | None) -> list[str]:
    """Keys of posts and articles: t:<id>, a:<id>."""
    out = []
    for u in link_keys(text):
        for head, kind in (("x.com/status/", "t:"), ("x.com/i/article/", "a:")):
            if u.startswith(head):
                out.append(kind + u[len(head) :])
    return out


folded_fingerprint_col = _mapped(folded_fingerprint, "string")
links_col = _mapped(links_of, "array<string>")
canonical_link_col = _mapped(canonical_link, "string")
link_keys_col = _mapped(link_keys, "array<string>")
seen_keys_col = _mapped(seen_keys, "array<string>")
index_keys_col = _mapped(index_keys, "array<string>")
stored_link_col = _mapped(stored_link, "string")


def letters_only(text: Column) -> Column:
    """Lower case, letters and digits alone; null counts as empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]", "")


def entry_fingerprint(title: Column, link: Column, category: Column) -> Column:
    """SHA-256 of the stored link and category, or of title and category without a link."""
    by_link = F.concat(F.lit("url:"), letters_only(stored_link_col(link)))
    by_title = F.concat(F.lit("title:"), letters_only(title))
    return F.sha2(F.concat(F.when(F.trim(F.coalesce(link, F.lit(""))) != "", by_link).otherwise(by_title), F.lit("|"), letters_only(category)), 256)


def topic_id(title: Column) -> Column:
    """First 12 digits of the hash of the title's letters."""
    return F.substring(F.sha2(letters_only(title), 256), 1, 12)
