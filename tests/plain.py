"""Plain statistics for the tests."""

from __future__ import annotations

import pandas as pd


def spearman_of(x, y) -> float:
    """Pearson's correlation of average ranks."""
    return pd.Series(x).rank().corr(pd.Series(y).rank())
