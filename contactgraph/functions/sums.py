"""Sums of doubles that do not depend on the order of the terms.

A double is a whole number of units of a bin, bins being 32 binary places wide.
That number is cut into three whole parts, whose sums Spark forms exactly, bin by
bin and with partial sums before the shuffle. What is left to merge are a few
exact terms per group, in a fixed order and with the rounding errors carried
along. So partitions, retries and the order of rows cannot change a bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WIDTH = 32  # binary places of a bin
_LEAST = -34  # the bin of the smallest positive double
_MOST = 31
_PART = 30  # binary places of a part, so that 2**33 terms sum up in a long


def _power(exponent: Column) -> Column:
    """Two to a multiple of 16 that half a bin's power can be, exactly."""
    listed = F.array(*[F.lit(2.0**e) for e in range(16 * _LEAST, -16 * _LEAST + 1, 16)])
    return F.element_at(listed, (exponent / 16 - _LEAST + 1).cast("int"))


def _bin(size: Column) -> Column:
    """Bin of a positive finite double: the power of 2**32 at or below it."""
    guess = F.greatest(F.lit(_LEAST), F.least(F.lit(_MOST), F.floor(F.log2(size) / _WIDTH))).cast("int")
    # a logarithm may be off by a little; halves of the powers do not overflow
    half = _power(-guess * 16)
    scaled = size * half * half
    moved = guess + F.when(scaled < 1, -1).when(scaled >= 2.0**_WIDTH, 1).otherwise(0)
    # least and greatest would turn a null into a bin
    return F.when(size.isNotNull(), F.greatest(F.lit(_LEAST), F.least(F.lit(_MOST), moved)).cast("int"))


def _parts(value: Column, at: Column) -> list[Column]:
    """The whole parts, highest first, of ``value`` in units of its bin."""
    half = _power(-at * 16)
    units = value * half * half * 2.0**52

    def whole(x: Column) -> Column:
        return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")

    high = whole(units / 2.0 ** (2 * _PART))
    rest = units - high * 2.0 ** (2 * _PART)
    middle = whole(rest / 2.0**_PART)
    return [p.cast("bigint") for p in (high, middle, rest - middle * 2.0**_PART)]


def _merged(bins: str) -> Column:
    """The sum of a group's bins, from the highest term down, with compensation."""

    def terms(b: Column) -> Column:
        half = _power(b["at"] * 16)
        found = []
        for name, places in (("p2", 2 * _PART), ("p1", _PART), ("p0", 0)):
            # the halves of a long are exact in a double
            upper = F.shiftright(b[name], 32)
            lower = b[name] - F.shiftleft(upper, 32)
            for half_of, up in ((upper, 32), (lower, 0)):
                found.append(half_of.cast("double") * 2.0 ** (places + up - 52) * half * half)
        return F.array(*found)

    listed = F.flatten(F.transform(F.reverse(F.array_sort(bins)), terms))

    def added(state: Column, x: Column) -> Column:
        total = state["high"] + x
        back = total - state["high"]
        error = (state["high"] - (total - back)) + (x - back)
        return F.struct(total.alias("high"), (state["low"] + error).alias("low"))

    start = F.struct(F.lit(0.0).alias("high"), F.lit(0.0).alias("low"))
    return F.aggregate(listed, start, added, lambda state: state["high"] + state["low"])


def exact_sum(df: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """``keys`` and the sum of ``value`` per group, the same bits in whatever order
    and partitions the rows come; with no keys one row, null when there is nothing.

    Nulls are left out, and a group of nulls has a null. Infinite values and NaN
    make the sum what they make any sum. Sums near the end of the range of doubles
    may overflow like any. Up to 2**33 rows of a group may fall into one bin; more
    raise an overflow and no wrong sum.
    """
    x = F.col(value).cast("double")
    size = F.abs("_x")
    # null where there is no bin: zeros, infinite values and NaN
    rows = df.select(*keys, x.alias("_x")).withColumn("_in", F.when((size > 0) & (size < float("inf")), F.col("_x")))
    rows = rows.withColumn("_at", _bin(F.abs("_in")))
    names = ("p2", "p1", "p0")
    split = rows.select(
        *keys,
        "_at",
        F.when(F.col("_in").isNull(), F.col("_x")).alias("_plain"),
        *[p.alias(n) for n, p in zip(names, _parts(F.col("_in"), F.col("_at")))],
    )
    # what is in no bin are zeros, infinite values and NaN, whose sums have no order
    binned = split.groupBy(*keys, "_at").agg(F.sum("_plain").alias("_plain"), *[F.sum(n).alias(n) for n in names])
    entry = F.when(F.col("_at").isNotNull(), F.struct(F.col("_at").alias("at"), *names))
    merged = binned.groupBy(*keys).agg(F.sum("_plain").alias("_plain"), F.collect_list(entry).alias("_bins"))
    some = F.size("_bins") > 0
    total = F.when(some, _merged("_bins") + F.coalesce("_plain", F.lit(0.0))).otherwise(F.col("_plain"))
    return merged.select(*keys, total.alias(value))

