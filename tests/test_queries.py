"""Each registered query of the grid against its SQL."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.plans.oracle import SQL
from pulsegrid.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("events", "embeddings", "documents"):
        c.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    keys = [c for c in columns if a[c].dtype.kind != "f" and not isinstance(a[c].iloc[0] if len(a) else None, list)]
    a, b = (x[columns].sort_values(keys).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in columns:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), atol=2e-6, err_msg=c)
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, db, name):
    same(QUERIES[name](spark, SF).toPandas(), db.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"orc01_analysis"}))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_analysis_labels_every_pixel_by_each_method(spark):
    labels = QUERIES["orc01_analysis"](spark, SF).toPandas()
    pixels = QUERIES["prj04_coordinates"](spark, SF).count()
    assert labels.groupby("method").size().to_dict() == dict.fromkeys(("features", "correlation", "contrastive"), pixels)
    assert (labels["label"] >= -2).all()


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["recording_id", "pixel_id", "active"]


def test_means_are_the_same_however_the_events_are_cut(spark, tmp_path):
    import functools

    from pulsegrid.plans.recording import signals

    # sums of tenths end in other digits in another order
    values = [(0.1 * k) ** 3 for k in range(1, 41)]
    made = spark.createDataFrame([(i, 3, "view", v) for i, v in enumerate(values)] + [(1, 4, "view", None)], "k int, user_id long, event_type string, value double")
    made = made.select("user_id", "event_type", "value", F.expr("timestamp_ntz'2024-01-02 00:00:00' + make_dt_interval(0, 0, k * 7)").alias("ts"))
    want = functools.reduce(lambda a, b: a + b, values, 0.0) / len(values)
    for name, rows in (("up", made.orderBy("ts").coalesce(1)), ("down", made.orderBy(F.desc("ts")).coalesce(1)), ("many", made.repartition(7))):
        rows.write.parquet(str(tmp_path / name / "events.parquet"))
        got = {(r["pixel_id"], r["t"]): r["v"] for r in signals(spark, str(tmp_path / name)).collect()}
        assert len(got) == 120 and got[3, 2] == want and got[4, 2] == 0.0, name


def test_a_decay_that_hardly_falls_has_the_time_constant_of_the_sql(db):
    from pulsegrid.operators.kinetics import tau_of

    for k in range(200):
        random = np.random.default_rng(k)
        t = [float(i) * 6.0 / 59 for i in np.sort(random.choice(60, 8, replace=False))]
        y = (0.5 + 1e-9 * random.standard_normal(8)).tolist()
        got = db.execute("SELECT regr_slope(ln(y), t) FROM (SELECT unnest(?) AS t, unnest(?) AS y)", [t, y]).fetchone()[0]
        assert tau_of(t, y) == (-1000 / got if got < 0 else None)


def test_means_of_events_of_one_second_are_those_of_the_sql(spark, tmp_path):
    from pulsegrid.plans.oracle import grid
    from pulsegrid.plans.recording import signals

    # every event comes again with a new id, as in a copy with shifted keys: sums by second add the copies of an event first
    made = spark.createDataFrame([(c * 90 + u * 3 + k, u, ((u * 37 + k * 53) % 997) / 100 + k, k, u) for c in range(20) for u in range(30) for k in range(3)], "event_id long, user_id long, value double, k int, u int")
    at = F.expr("timestamp_ntz'2024-01-02 00:00:00' + make_dt_interval(0, 0, k * 7, u)")
    made.select("event_id", at.alias("ts"), "user_id", F.lit("view").alias("event_type"), "value").orderBy("event_id").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    one = duckdb.connect()
    one.execute(f"SET threads = 1; CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {(p, t): v for p, t, v in one.execute(f"WITH {grid()} SELECT pixel_id, t, v FROM s").fetchall()}
    assert {(r["pixel_id"], r["t"]): r["v"] for r in signals(spark, str(tmp_path)).collect()} == want


def test_prominences_of_frames_of_nearly_one_height_are_those_of_the_sql(spark, tmp_path):
    # two frames hold the same values in another order, so their means' last digits tell a plateau from a peak
    values = lambda u: [((u * 37 + k * 53) % 997) / 100 + k for k in range(3)]
    rows = [(c * 1200 + u * 6 + f * 3 + k, u, values(u)[(k - f) % 3], 43200 * f + 7 * k) for c in range(20) for u in range(200) for f in range(2) for k in range(3)]
    made = spark.createDataFrame(rows, "event_id long, user_id long, value double, s int")
    at = F.expr("timestamp_ntz'2024-01-02 00:00:00' + make_dt_interval(0, 0, 0, s)")
    made.select("event_id", at.alias("ts"), "user_id", F.lit("view").alias("event_type"), "value").orderBy("event_id").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    one = duckdb.connect()
    one.execute(f"SET threads = 1; CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    want = one.execute(SQL["win07_prominence"]).df()
    assert 0 < (want["t"] == 3).sum() < len(want)
    same(QUERIES["win07_prominence"](spark, str(tmp_path)).toPandas(), want)
