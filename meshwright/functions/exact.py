"""The C library's functions on arrays: numpy and Java round some results otherwise, SQL engines built on that library do not.

Their names are numpy's, so that either can be handed to the same formula.
"""

from __future__ import annotations

import math

import numpy as np


def _over(f):
    return lambda *x: np.array(list(map(f, *[np.asarray(v, dtype="float64").tolist() for v in x])), dtype="float64")


sin, cos, tan, arctan, arctan2, log10 = (_over(f) for f in (math.sin, math.cos, math.tan, math.atan, math.atan2, math.log10))


def square(x: np.ndarray) -> np.ndarray:
    return np.array([math.pow(v, 2.0) for v in np.asarray(x, dtype="float64").tolist()], dtype="float64")
