"""Random numbers of given laws as expressions of the row, from
:func:`~contactgraph.functions.hashing.uniform_text`."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactgraph.functions.hashing import uniform_text

# More than 95 of 100 tries are taken, so all of them fail less than once in
# 1e40 rows; such a row gets the mode.
FIRST_TRIES, ALL_TRIES = 2, 32


def log_gamma_text(shape: float, seed, *parts: str) -> str:
    """SQL text of the logarithm of a Gamma(``shape``, 1) number.

    A cubed normal is accepted or tried again (the squeeze-free form of Marsaglia
    and Tsang); a shape below 1 is taken from the shape above it by a power of one
    more uniform. The tries after the first two are evaluated only where those fail.
    Logarithms keep tiny shapes from becoming 0.
    """
    if not 0 < shape < math.inf:
        raise ValueError(f"shape must be positive and finite, got {shape}")
    d = (shape if shape >= 1 else shape + 1.0) - 1.0 / 3.0
    c = 1.0 / math.sqrt(9.0 * d)

    def u(tag: str, *more: str) -> str:
        return f"(1 - {uniform_text(seed, f"'{tag}'", *parts, *more)})"

    def taken(first: int, last: int) -> str:
        normal = f"sqrt(-2 * ln({u('r', '_try')})) * cos({2 * math.pi!r}D * {u('angle', '_try')})"
        tries = f"transform(sequence({first}, {last}), _try -> named_struct('x', {normal}, 'l', ln({u('accept', '_try')})))"
        cubed = f"transform({tries}, _at -> named_struct('x', _at.x, 'l', _at.l, 'v', power(1 + {c!r}D * _at.x, 3)))"
        test = f"_at.v > 0 and _at.l < _at.x * _at.x / 2 + {d!r}D * (1 - _at.v + ln(_at.v))"
        return f"get(filter({cubed}, _at -> {test}), 0).v"

    v = f"coalesce({taken(0, FIRST_TRIES - 1)}, {taken(FIRST_TRIES, ALL_TRIES - 1)}, 1D)"
    boost = f" + ln({u('boost')}) / {shape!r}D" if shape < 1 else ""
    return f"(ln({d!r}D * {v}){boost})"


def beta_draw(a: float, b: float, seed, *cols: str) -> Column:
    """Beta(``a``, ``b``) DOUBLE in [0, 1], a function of ``seed`` and the values of
    ``cols`` alone: the share of one of two Gamma numbers in their sum."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in cols]
    one, other = (log_gamma_text(float(s), seed, f"'{tag}'", *quoted) for s, tag in ((a, "a"), (b, "b")))
    return F.expr(f"1 / (1 + exp({other} - {one}))")
