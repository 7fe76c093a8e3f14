import pytest

from contactgraph.operators import curves
from contactgraph.schema import SCENARIOS
from contactgraph.sources import tables

CURVE = "scenario_id long, step int, s double, i double, r double, n long"


def scenario(spark, *rows):
    return spark.createDataFrame(list(rows), SCENARIOS)


SIR20 = (0, 0.45, 0.05, 20, 0.2, 0.0, 20, 1.0)
SIR6 = (1, 0.35, 0.07, 6, 0.1, 0.0, 20, 1.0)


@pytest.fixture(scope="module")
def table(spark):
    """Two observed curves, of 20 and of 6."""
    shares = [(0, 0, 0.8, 0.2, 0.0, 20), (0, 1, 0.724, 0.263, 0.013, 20), (0, 2, 0.64, 0.34, 0.03, 20)]
    shares += [(1, 0, 0.9, 0.1, 0.0, 6), (1, 2, 0.6, 0.669, 0.1, 6)]
    rows = spark.createDataFrame(shares, CURVE).repartition(3)
    counts = curves.rounded_counts(rows).cache()
    return counts, curves.step_quotas(counts)


def test_counts_and_quotas(table):
    counts, quotas = table
    got = {
        (r["scenario_id"], r["step"]): (
            (r["n_s"], r["n_i"], r["n_r"]),
            (r["new_infected"], r["new_recovered"]),
        )
        for r in counts.join(quotas, ["scenario_id", "step"]).collect()
    }
    assert got == {
        (0, 0): ((16, 4, 0), (4, 0)),
        (0, 1): ((14, 5, 0), (1, 0)),
        (0, 2): ((13, 7, 1), (2, 1)),
        (1, 0): ((5, 1, 0), (1, 0)),
        (1, 2): ((4, 4, 1), (3, 1)),
    }


def test_peak_and_cursor(table):
    counts, quotas = table
    peaks = {r["scenario_id"]: r["peak"] for r in curves.peak_infected(counts).collect()}
    assert peaks == {0: 0.34, 1: 0.669}
    due = curves.quota_at(quotas, 2).filter("scenario_id = 0").first()
    assert (due["new_infected"], due["new_recovered"]) == (2, 1)
    assert curves.quota_at(quotas, 21).count() == 0
    row = curves.quota_cursor(quotas).filter("scenario_id = 0 and step = 1").first()
    assert (row["previous_infected"], row["next_infected"]) == (4, 2)


def test_daily_steps_run_on_over_months(spark, tmp_path):
    days = ["2024-01-30", "2024-01-31", "2024-02-01", "2024-03-01"]
    rows = [(i, i % 2, "error", d + " 10:00:00") for i, d in enumerate(days)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string")
    events.withColumn("ts", events["ts"].cast("timestamp")).write.parquet(str(tmp_path / "events.parquet"))
    steps = sorted(r["step"] for r in tables.event_curve(spark, str(tmp_path)).collect())
    assert steps == [0, 1, 2, 31]


def test_rounding_is_half_to_even(spark):
    curve = spark.createDataFrame(
        [(0, 0, 0.05, 0.15, 0.25, 10)],
        CURVE,
    )
    row = curves.rounded_counts(curve).first()
    assert (row["n_s"], row["n_i"], row["n_r"]) == (0, 2, 2)


def test_grid(spark):
    grid = curves.scenario_grid(scenario(spark, SIR20, SIR6), beta=[0.1, 0.2], t_end=[5, 6, 7])
    rows = grid.orderBy("scenario_id").collect()
    assert [r["scenario_id"] for r in rows] == list(range(12))
    assert [(r["beta"], r["t_end"], r["n"]) for r in rows[4:8]] == [
        (0.2, 6, 20),
        (0.2, 7, 20),
        (0.1, 5, 6),
        (0.1, 6, 6),
    ]
    with pytest.raises(ValueError):
        curves.scenario_grid(scenario(spark, SIR20), speed=[1])
