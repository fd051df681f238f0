"""JSON texts with fixed key order and no blanks."""

from __future__ import annotations

import json

import numpy as np


def dumps(value) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


class Number(float):
    """A float that is written by ``positional`` where it stands in a structure given to ``dumps``."""

    def __repr__(self) -> str:
        return positional(self)


def positional(x) -> str:
    """Shortest digits that give the number back, never with an exponent; whole numbers without a point, both zeros as 0."""
    if x == 0:
        return "0"
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "inf" if x > 0 else "-inf"
    return np.format_float_positional(x, unique=True, trim="-")
