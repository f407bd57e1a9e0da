"""Text forms used to compare messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_NORM_CHARS = 1500
# Marks that begin a card's header line, and its line about the author.
HEADER_MARKS = ("📢", "📄", "🌱", "📋", "🔁", "⚠", "🚨", "✅")
AUTHOR_MARK = "👤 "

# Shapes of links and clock times, ends of lines.
_LINK = r"\[([^\]\n]+)\]\((https?://[^)\s]+)\)"
_URL = r"https?://\S+"
_CLOCK = r"(?<!\d)[0-2]?\d:[0-5]\d(?!\d)"
_EOL = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"


def card_body_col(text: Column) -> Column:
    """A card without header line, author lines, links' targets and clock times, blanks made one; at most 1,500 characters.  Null gives an empty text."""
    unicode = lambda p: f"(?U){p}"
    blank = f"[\\s&&[^{_EOL}]]*"
    t = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), unicode(r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"), "")
    t = F.regexp_replace(t, f"^(?:{'|'.join(HEADER_MARKS)})[^{_EOL}]*", "")
    t = F.regexp_replace(t, unicode(f"(?<=^|[{_EOL}]){blank}{AUTHOR_MARK}(?=[^{_EOL}]*\\S)[^{_EOL}]*"), "")
    for pattern, to in ((_LINK, "$1"), (_URL, " "), (_CLOCK, " "), (r"[\s\x1c-\x1f]+", " ")):
        t = F.regexp_replace(t, unicode(pattern), to)
    return F.substring(F.trim(t), 1, MAX_NORM_CHARS)


def squeezed(text: str) -> str:
    """Without white space, in lower case."""
    return "".join(text.split()).lower()
