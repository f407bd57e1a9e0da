"""JSON out of model answers and other loose text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_FENCE = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"


def rescued_json(text: Column) -> Column:
    """The JSON object in a text as VARIANT: the whole, else a fenced one, else from first to last brace."""
    whole = F.try_parse_json(text)
    fenced = F.try_parse_json(F.nullif(F.regexp_extract(text, _FENCE, 1), F.lit("")))
    braces = F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")))
    is_object = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v)
    return F.coalesce(is_object(whole), is_object(fenced), is_object(braces))


def mended(raw: str) -> str:
    """Broken escapes doubled, commas before a closing bracket dropped, open strings and brackets closed."""
    raw = re.sub(r"\\u(?![0-9a-fA-F]{4})", r"\\\\u", raw)
    out, open_, inside, skip = [], [], False, False
    for c in raw:
        if skip:
            skip = False
        elif inside:
            skip, inside = c == "\\", c != '"'
        elif c == '"':
            inside = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            while out and (out[-1].isspace() or out[-1] == ","):
                out.pop()
            if open_:
                open_.pop()
        out.append(c)
    if inside:
        out.append('"')
    text = "".join(out).rstrip()
    return text.rstrip(",") + "".join(reversed(open_)) if open_ else text


def tolerant_json(text: Column) -> Column:
    """Compact JSON of a text, mended where needed; null if it can't be."""

    def one(t: str | None) -> str | None:
        for f in (lambda x: x, mended):
            try:
                return json.dumps(json.loads(f(t or "")), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                continue
        return None

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(F.coalesce(text.cast("string"), F.lit("")))


def leaves(text: str | None) -> Iterator[tuple[str, str | None]]:
    """Path and value of every leaf of a JSON text, depth first; nothing if it isn't JSON."""
    try:
        todo = [("$", json.loads(text or ""))]
    except ValueError:
        return
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{path}.{k}", x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(f"{path}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
        else:
            yield path, v if isinstance(v, str) else None if v is None else json.dumps(v)


def fences(text: str | None) -> Iterator[tuple[str, str, str, int]]:
    """Language, tag, body and number of each fenced block; a fence inside a fence belongs to the body."""
    depth, lang, tag, body, no = 0, "", "", [], 0
    for line in (text or "").splitlines():
        m = re.match(r"\s*```(\S*)\s*(\S*)\s*$", line)
        if m and depth == 0:
            depth, lang, tag, body = 1, m.group(1), m.group(2), []
        elif m and m.group(1):
            depth += 1
            body.append(line)
        elif m and depth == 1:
            yield lang, tag, "\n".join(body), no
            depth, no = 0, no + 1
        else:
            depth -= bool(m)
            body.append(line)
    if depth and body:
        yield lang, tag, "\n".join(body), no


def register_json_functions(spark: SparkSession) -> None:
    """Table functions ``json_leaves(text)`` and ``fenced_blocks(text)`` for SQL."""

    @F.udtf(returnType="path string, value string")
    class Leaves:
        def eval(self, text: str):
            yield from leaves(text)

    @F.udtf(returnType="lang string, tag string, body string, no int")
    class Blocks:
        def eval(self, text: str):
            yield from fences(text)

    spark.udtf.register("json_leaves", Leaves)
    spark.udtf.register("fenced_blocks", Blocks)


_IMAGE_PATH = r"(?i)^(?=~|.*/)(?:.*)\.(?:png|jpg|jpeg|webp)$"
# Words by which stored JSON of a message is told to carry media, and the type they name.
MEDIA_WORDS = ("photo", "image", "document", "media", "webpage")


def has_media(raw: Column) -> Column:
    low = F.lower(raw)
    return F.coalesce(F.greatest(*[F.contains(low, F.lit(w)) for w in MEDIA_WORDS]), F.lit(False))


def media_type(raw: Column) -> Column:
    """Type of the media that stored JSON of a message carries."""
    has = lambda w: F.contains(F.lower(raw), F.lit(w))
    return F.when(has("photo") | has("image"), "图片").when(has("webpage"), "链接卡片").when(has("document"), "文件").otherwise("媒体")


def image_paths(raw: Column) -> Column:
    """Leaves of a JSON text that are paths of images, in order; none if it isn't JSON.  Whether a file is there is for the reader to see."""

    @F.pandas_udf("array<string>")
    def strings(s: pd.Series) -> pd.Series:
        return pd.Series([[v for _, v in leaves(x) if isinstance(v, str)] for x in s], dtype=object)

    return F.filter(strings(raw.cast("string")), lambda v: v.rlike(_IMAGE_PATH))


#: Blocks that bound each other in a summary.
SUMMARY_BLOCKS = (("markdown", "concise"), ("markdown", "detailed"), ("json", "opportunities"), ("json", "verification"))
NO_OPPORTUNITIES = '{"permanent_additions":[],"hot_leads_additions":[],"death_signals":[]}'


def summary_parts(text: str | None) -> tuple[str | None, str, str | None, str | None, str]:
    """concise, detailed, opportunities, verification and what is missing or broken, of an answer in fenced blocks.

    A block of a known kind ends the one before it, closed or not; of several of one kind the last counts.  Without a
    tagged verification the last untagged JSON with checked claims is it.  Broken opportunities become none.
    """
    blocks: dict[tuple[str, str], list[str]] = {}
    depth, body = 0, []
    for line in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        fence = re.fullmatch(r"```(?:(\w+)[ \t]*(\w*))?\s*", line)
        kind = (fence.group(1) or "", fence.group(2) or "") if fence else None
        if fence and kind[0] and (depth == 0 or kind in SUMMARY_BLOCKS):
            depth, body = 1, []
            blocks[kind] = body
        elif depth:
            depth += 0 if not fence else 1 if kind[0] else -1
            if depth:
                body.append(line)
    found = {k: "\n".join(v).strip() for k, v in blocks.items()}

    def parsed(raw: str | None) -> str | None:
        for f in (str, mended):
            try:
                return json.dumps(json.loads(f(raw)), ensure_ascii=False, separators=(",", ":"))
            except (ValueError, TypeError):
                continue
        return None

    concise = found.get(("markdown", "concise"))
    raw = found.get(("json", "opportunities"))
    opportunities = NO_OPPORTUNITIES if raw is None else parsed(raw)
    loose = parsed(found.get(("json", "")))
    verification = parsed(found.get(("json", "verification"))) if ("json", "verification") in found else loose if loose and "checked_claims" in json.loads(loose) else None
    faults = ["concise"] * (not concise) + ["opportunities"] * (opportunities is None) + ["verification"] * (verification is None)
    return concise or None, found.get(("markdown", "detailed"), ""), opportunities or NO_OPPORTUNITIES, verification, ",".join(faults)


def summary_parts_col(text: Column) -> Column:
    """``summary_parts`` as a struct: concise, detailed, opportunities, verification, faults."""

    @F.pandas_udf("concise string, detailed string, opportunities string, verification string, faults string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([summary_parts(x) for x in s], columns=["concise", "detailed", "opportunities", "verification", "faults"])

    return run(text.cast("string"))
