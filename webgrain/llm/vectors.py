"""Vectors of list columns as matrices."""

from __future__ import annotations

import numpy as np


def stacked(column, n: int | None = None) -> np.ndarray:
    """A pandas column of equally long vectors as a matrix."""
    return np.stack([np.asarray(x) for x in column]) if len(column) else np.zeros((0, n or 0))
