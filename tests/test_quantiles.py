"""Quantiles by selection against numpy."""

import numpy as np
import pytest

from pulsegrid.functions.quantiles import exact_quantiles

SHARES = [0.0, 0.004, 0.1, 0.5, 0.65, 0.996, 1.0]


@pytest.mark.parametrize("accuracy", [20_000, 1000, 100])
def test_against_numpy(spark, accuracy):
    rng = np.random.default_rng(0)
    groups = {
        "normal": rng.normal(size=3001), "ties": rng.integers(0, 3, 500).astype(float), "flat": np.full(40, 7.5), "one": np.array([-2.0]), "two": np.array([1.0, 5.0]),
        "wide": np.array([-1.7e308, 1e-300, 0.0, 3.0, 1.7e308]), "crowded": np.concatenate([[0.0, 1e12], rng.random(900)]),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("normal", None), ("normal", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: r["q"] for r in exact_quantiles(df, "g", "x", SHARES, accuracy).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        if g != "wide":
            np.testing.assert_allclose(got[g], np.quantile(xs, SHARES), rtol=1e-12, atol=1e-12)
    assert got["wide"][3] == 1e-300 and got["wide"][0] == -1.7e308 and got["wide"][-1] == 1.7e308


def test_no_task_takes_a_groups_values(spark):
    df = spark.range(200_000).selectExpr("'g' AS g", "cast(id * 7919 % 200000 AS double) AS x")
    out = exact_quantiles(df, "g", "x", [0.25])
    assert out.first()["q"] == [49_999.75]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert " percentile(" not in plan and "collect_list" not in plan and "Window" in plan
