"""Seeded randomness as a pure function of the row, so that a retry, another
partitioning or another engine gives the same draw."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX_DIGITS = 13  # 52 bits, exact in a double


def portable_uniform(seed, *cols) -> Column:
    """Uniform DOUBLE in [0, 1) from md5 of ``seed|col|col...``."""
    parts = [c if isinstance(c, Column) else F.col(c) for c in cols]
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    head = F.substring(F.md5(text), 1, _HEX_DIGITS)
    return F.conv(head, 16, 10).cast("bigint") / F.lit(float(16**_HEX_DIGITS))


def uniform_text(seed, *parts: str) -> str:
    """:func:`portable_uniform` as SQL text over SQL expressions, for plans
    built in a loop."""
    quoted = str(seed).replace("\\", "\\\\").replace("'", "\\'")
    text = ", ".join([f"'{quoted}'", *(f"cast({p} as string)" for p in parts)])
    head = f"substring(md5(concat_ws('|', {text})), 1, {_HEX_DIGITS})"
    return f"(cast(conv({head}, 16, 10) as bigint) / {float(16**_HEX_DIGITS)!r}D)"
