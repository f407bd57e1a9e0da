"""Short texts of cards and reports, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaylight.functions.markup import escaped_html

# Platforms that a source's name begins with, and what is said where nothing is known.
PLATFORMS = ("微信", "Telegram")
NONE = "—"
#: Scores under which images without a worthy type, or without facts, are left out.
LEAST_WORTH, LEAST_WITHOUT_FACTS = 0.75, 0.55


def source_label(name: Column) -> Column:
    """A source's name without its platform, blanks around slashes made one."""
    parts = F.transform(F.split(name, "/"), lambda x: F.trim(x))
    rest = F.trim(F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), " / "))
    return F.when((F.size(parts) >= 2) & parts[0].isin(*PLATFORMS), rest).otherwise(F.trim(name))


def rubric_version(text: Column) -> Column:
    """``v<number>`` out of the first line, else v0."""
    found = F.regexp_extract(F.regexp_extract(F.coalesce(text, F.lit("")), r"^([^\n\r]*)", 1), r"\b(v\d+)\b", 1)
    return F.when(found != "", found).otherwise("v0")


def signed_delta(value: Column, base: Column, unit: str, digits: int = 0) -> Column:
    """The rounded difference with its sign and unit, zero without a sign; a dash where either is missing."""
    d = F.bround(value - base, digits)
    text = F.when(d == 0, F.format_string(f"%.{digits}f", F.lit(0.0))).otherwise(F.format_string(f"%+.{digits}f", d))
    return F.when(d.isNull(), NONE).otherwise(F.concat(text, F.lit(unit)))


def hours_text(hours: Column) -> Column:
    """Hours as hours and minutes."""
    m = F.bround(hours * 60, 0).cast("bigint")
    return F.when(m.isNull(), NONE).otherwise(F.concat(F.floor(m / 60), F.lit("小时"), F.lpad((m % 60).cast("string"), 2, "0"), F.lit("分")))


def rendered_point(text: Column) -> Column:
    """Escaped, pairs of bold marks as <b>, single ones dropped."""
    return F.replace(F.regexp_replace(escaped_html(text), r"(?s)\*\*(.+?)\*\*", "<b>$1</b>"), F.lit("**"), F.lit(""))


def segment_footer(date: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("<i>📍 "), date, F.lit(" · "), start, F.lit("–"), end, F.lit("</i>"))


def without_media(markdown: Column, media_id: Column) -> Column:
    """Markdown without the blocks that show one attachment."""
    return F.regexp_replace(markdown, F.concat(F.lit(r"!\[[^\]]*\]\(tg://(?:photo|video|audio)\?id="), media_id, F.lit(r'(?:\s+"[^"\n]*")?\)')), F.lit(""))


def is_empty_image(kind: Column, worth: Column, facts: Column, summary: Column) -> Column:
    """Memes and unknown images of little worth, images without facts, and such as are said to hold no text."""
    said = F.coalesce(summary, F.lit("")).rlike("表情包|无文字|纯图片")
    none = F.coalesce(F.size(facts), F.lit(0)) <= 0
    return F.coalesce((kind.isin("meme", "unknown") & (worth < LEAST_WORTH)) | (none & (worth < LEAST_WITHOUT_FACTS)) | said, F.lit(False))
