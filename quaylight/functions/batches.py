"""Whole groups out of a sorted stream of batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = 65536) -> Iterator[pd.DataFrame]:
    """Frames of at least ``rows`` rows (but for the last) that never split a group.

    The stream must be sorted by ``keys``, or at least hold each group in one
    piece.  Memory is ``rows`` plus the largest group, however long the stream.
    """
    held: list[pd.DataFrame] = []
    n = 0
    for b in batches:
        if len(b) == 0:
            continue
        held.append(b)
        n += len(b)
        if n < rows:
            continue
        df = pd.concat(held, ignore_index=True)
        last = df[keys].iloc[-1]
        same = np.ones(len(df), bool)
        for k in keys:
            same &= (df[k] == last[k]).to_numpy()
        cut = len(df) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield df.iloc[:cut].reset_index(drop=True)
            df = df.iloc[cut:]
        held, n = [df], len(df) if cut else 0
    if held:
        yield pd.concat(held, ignore_index=True)
