"""Counts, step quotas and peaks of observed curves; grids of scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactgraph.operators.relabel import observed_counts
from contactgraph.schema import QUOTAS, SCENARIOS, conform


def scenario_grid(base: DataFrame, **lists) -> DataFrame:
    """Every row of ``base`` with every combination of the given parameter
    values, e.g. ``beta=[0.3, 0.4]``. ``scenario_id`` numbers the combinations
    within the base scenario, the last list running fastest."""
    unknown = set(lists) - set(SCENARIOS.names)
    if unknown or "scenario_id" in lists:
        raise ValueError(f"not scenario parameters: {sorted(unknown) or ['scenario_id']}")
    if any(not values for values in lists.values()):
        raise ValueError("every list needs a value")
    grid = conform(base, SCENARIOS)
    place, combinations = F.lit(0).cast("long"), 1
    for name, values in lists.items():
        combinations *= len(values)
        options = F.array(*[F.lit(v) for v in values])
        grid = grid.select(
            *[c for c in grid.columns if c != name],
            F.posexplode(options).alias(f"_{name}", name),
        )
        place = place * len(values) + F.col(f"_{name}")
    number = F.col("scenario_id") * F.lit(combinations) + place
    return conform(grid.withColumn("scenario_id", number), SCENARIOS)


def rounded_counts(curves: DataFrame) -> DataFrame:
    """Add ``n_s, n_i, n_r``: each share times n, rounded on its own, half to
    even. They need not add up to n."""

    def count(share: str):
        return F.bround(F.round(F.col("n") * F.col(share), 9), 0).cast("long")

    return curves.withColumns({f"n_{c}": count(c) for c in ("s", "i", "r")})


def step_quotas(counts: DataFrame) -> DataFrame:
    """Change of ``n_i`` and ``n_r`` since the step before, not below 0; before
    the first step both are 0. The first is a change of prevalence."""
    by_step = Window.partitionBy("scenario_id").orderBy("step")

    def change(name: str):
        return F.greatest(F.col(name) - F.lag(name, 1, 0).over(by_step), F.lit(0))

    return conform(
        counts.select(
            "scenario_id",
            "step",
            change("n_i").alias("new_infected"),
            change("n_r").alias("new_recovered"),
        ),
        QUOTAS,
    )


def quota_at(quotas: DataFrame, step: int) -> DataFrame:
    """The quotas of one step; empty beyond the curve."""
    return quotas.filter(F.col("step") == step)


def quota_cursor(quotas: DataFrame) -> DataFrame:
    """Each step's quotas beside those of the step before and the step after,
    null at the ends."""
    by_step = Window.partitionBy("scenario_id").orderBy("step")
    cols = []
    for name in ("new_infected", "new_recovered"):
        cols += [
            F.lag(name).over(by_step).alias(f"previous_{name.removeprefix('new_')}"),
            F.lead(name).over(by_step).alias(f"next_{name.removeprefix('new_')}"),
        ]
    return quotas.select("*", *cols)


def peak_infected(curves: DataFrame) -> DataFrame:
    """Largest infected share of each scenario, rounded to 3 places."""
    return curves.groupBy("scenario_id").agg(F.round(F.max("i"), 3).alias("peak"))


def observed_curve(history: DataFrame) -> DataFrame:
    """``(step, n_s, n_i, n_r)`` from the vertices of all snapshots."""
    return observed_counts(history, "step")
