"""Greedy clusters of topic lines that several groups report.

A cluster's first line is its seed; a later line joins the first seed that it is similar to.  The order
decides, so a day is worked through by one task; a day's candidate lines are bounded by
what a day brings.  Within it, only seeds that share a run of characters are compared.
"""

from __future__ import annotations

import difflib
import hashlib
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CONTAINED = 0.92


def topic_letters(text: str) -> str:
    """What is compared of a line: without source, links and brackets; letters only, at most 80."""
    t = re.sub(r"^\[Telegram / [^\]]+\]\s*|^\*\*[^*]+\*\*:\s*", "", text)
    t = re.sub(r"https?://\S+|\[.*?\]", "", t)
    return "".join(c for c in t if c.isalnum() or c == "_").lower()[:80]


def likeness(a: str, b: str) -> float:
    """0.92 if one contains the other, else the matching-blocks ratio."""
    if not a or not b:
        return 0.0
    return _CONTAINED if a in b or b in a else difflib.SequenceMatcher(None, a, b).ratio()


def _grams(s: str, n: int = 3) -> set[str]:
    return {s[i : i + n] for i in range(len(s) - n + 1)} or {s}


def seeds_of(lines: list[str], threshold: float = 0.85) -> list[int]:
    """For each line the position of its seed.

    A ratio of 0.85 leaves at most 15 % unmatched, in few pieces; such lines share a run of three
    characters, as do lines of which one contains the other, so seeds without a shared run are passed over.
    """
    norm = [topic_letters(x) for x in lines]
    out: list[int] = []
    index: dict[str, list[int]] = defaultdict(list)
    for i, s in enumerate(norm):
        near = sorted({j for g in _grams(s) for j in index[g]}) if s else []
        seed = next((j for j in near if likeness(norm[j], s) >= threshold), i)
        out.append(seed)
        if seed == i and s:
            for g in _grams(s):
                index[g].append(i)
    return out


def clustered(df: DataFrame, day: str, source: str, order: str, text: str, threshold: float = 0.85) -> DataFrame:
    """day, cluster_id, title, lines, sources: clusters of each day's lines; lines without a day are a group of their own, whose day is null."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        pdf["seed"] = seeds_of(pdf["text"].tolist(), threshold)
        out = []
        for seed, g in pdf.groupby("seed"):
            title = pdf["text"][seed][:40]
            letters = topic_letters(title)
            out.append((pdf["day"][0], hashlib.sha256(letters.encode()).hexdigest()[:16] if len(letters) >= 8 else letters, title, len(g), g["source"].nunique()))
        return pd.DataFrame(out, columns=["day", "cluster_id", "title", "lines", "sources"])

    rows = df.select(F.col(day).alias("day"), F.col(source).alias("source"), F.col(order).alias(order), F.col(text).alias("text")).where("text is not null")
    return rows.groupBy("day").applyInPandas(run, f"day {df.schema[day].dataType.simpleString()}, cluster_id string, title string, lines long, sources long")
