"""Frames as tiles against whole frames, and what analyses do with recordings that fail."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import tiles
from pulsegrid.operators.spatial import gaussian_weights
from pulsegrid.plans import analysis
from pulsegrid.plans.recording import Grid, Params


def whole(image, sigma):
    w = gaussian_weights(sigma)
    r = len(w) // 2
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        image = np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), axis, np.pad(image, pad, "symmetric"))
    return image


def frames(shape, n=2, seed=0):
    return np.random.default_rng(seed).random((n, *shape))


def rows(spark, stack, name="r"):
    return spark.createDataFrame([(name, t, y, x, float(v)) for t, f in enumerate(stack) for (y, x), v in np.ndenumerate(f)], "recording_id string, t int, y int, x int, v double").repartition(3)


def joined(found, size, stack):
    out = np.full(stack.shape, np.nan)
    for r in found.collect():
        part = out[r["t"], r["ty"] * size : (r["ty"] + 1) * size, r["tx"] * size : (r["tx"] + 1) * size]
        part[:] = np.reshape(r["pixels"], part.shape)
    return out


@pytest.mark.parametrize("shape,size,sigma", [((10, 15), 4, 0.8), ((10, 15), 64, 0.8), ((7, 5), 2, 1.6), ((3, 3), 1, 1.0), ((1, 9), 4, 2.0)])
def test_blur_of_tiles_is_that_of_the_frame(spark, shape, size, sigma):
    stack = frames(shape)
    cut = tiles.to_tiles(rows(spark, stack), size)
    np.testing.assert_array_equal(joined(cut, size, stack), stack)
    np.testing.assert_allclose(joined(tiles.blur(cut, size, sigma), size, stack), [whole(f, sigma) for f in stack], atol=1e-12)


def test_decoded_frames_missing_pixels_and_bins(spark):
    stack = frames((5, 7))
    decoded = spark.createDataFrame([("r", t, 5, 7, f.ravel().tolist()) for t, f in enumerate(stack)], "recording_id string, t int, height int, width int, pixels array<double>")
    np.testing.assert_array_equal(joined(tiles.frames_to_tiles(decoded, 3), 3, stack), stack)
    holes = rows(spark, stack).where("NOT (y > 3 AND x < 3)")
    want = stack.copy()
    want[:, 4:, :3] = 0
    np.testing.assert_array_equal(joined(tiles.to_tiles(holes, 2), 2, stack), want)
    got = tiles.binned(tiles.to_tiles(rows(spark, stack), 4), 4, 2).toPandas()
    full = np.zeros((2, 6, 8))
    full[:, :5, :7] = stack
    for r in got.itertuples():
        assert r.width == 4 and np.isclose(r.v, full[r.t, 2 * r.y : 2 * r.y + 2, 2 * r.x : 2 * r.x + 2].mean())
    assert len(got) == 2 * 3 * 4
    with pytest.raises(ValueError):
        tiles.binned(tiles.to_tiles(holes, 3), 3, 2)


def test_signals_do_not_depend_on_the_size_of_tiles(spark):
    stack = frames((10, 15), 20)
    told = []
    for size in (4, 6, 64):
        params = Params(bin_size=2, value=10.0, sigma=0.8, tile=size)
        told.append(analysis.prepare(tiles.to_tiles(rows(spark, stack), size), 20, 10, params).toPandas().sort_values(["pixel_id", "t"], ignore_index=True))
    assert len(told[0]) == 20 * 5 * 8 and np.isclose(told[0]["time_s"].max(), 2.0)
    for other in told[1:]:
        pd.testing.assert_frame_equal(told[0], other)


def test_parameters_give_sigma_and_duration(spark):
    assert Params(use_fps=True, value=20.0).duration(60) == 3.0 and Params(use_fps=False, value=7.0).duration(60) == 7.0
    flat = np.ones((4, 4, 4))
    out = analysis.prepare(tiles.to_tiles(rows(spark, flat), 256), 4, 4, Params(bin_size=2, use_fps=False, value=6.0)).toPandas()
    assert (out["v"] == 0).all() and out["time_s"].max() == 6.0


def test_broken_recordings_are_told_and_the_others_analysed(spark):
    t = np.arange(60)
    good = [("good", p, int(i), int(i) * 0.1, float(np.sin(i / 3) * (p + 1))) for p in range(6) for i in t]
    bad = [("bad", 0, int(i), int(i) * 0.1, float("nan") if i else 1.0) for i in t]
    short = [("short", 0, 0, 0.0, 1.0)]
    signals = spark.createDataFrame(good + bad + short, "recording_id string, pixel_id int, t int, time_s double, v double")
    kept, failed = analysis.sound(signals)
    assert {r[0] for r in kept.select("recording_id").distinct().collect()} == {"good"}
    assert {(r["recording_id"], r["error"]) for r in failed.collect()} == {("bad", "too few finite values"), ("short", "no frames to compare")}
    told = analysis.analyse(signals, Grid(3, 60, 6.0), contrastive=False)
    assert told.failures.count() == 2 and {r["recording_id"] for r in told.labels.collect()} == {"good"}
    rows_, failures = analysis.batch(signals, Grid(3, 60, 6.0))
    assert failures.count() == 2 and {r["Filename"] for r in rows_.collect()} <= {"good"}


def test_failed_methods_leave_the_labels_before(spark):
    from pulsegrid.operators.clustering import guarded

    pixels = spark.createDataFrame([(r, p) for r in "abc" for p in range(2)], "recording_id string, pixel_id int")
    run = guarded(lambda pdf: 1 / 0 if pdf["recording_id"].iloc[0] == "a" else pdf.assign(label=7, status="density"))
    first = pixels.groupBy("recording_id").applyInPandas(run, "recording_id string, pixel_id int, label int, status string")
    assert [r["status"] for r in first.where("label IS NULL").collect()] == ["failed: division by zero"]
    second = pixels.where("recording_id <> 'b'").select("*", F.lit(1).alias("label"))
    out = {(r["recording_id"], r["method"]): (r["label"], r["map_value"], r["status"]) for r in analysis.cascade(pixels, [("one", first), ("two", second)]).collect()}
    assert out == {("a", "one"): (-2, 0, "none"), ("b", "one"): (7, 9, "one"), ("c", "one"): (7, 9, "one"), ("a", "two"): (1, 3, "two"), ("b", "two"): (7, 9, "one"), ("c", "two"): (1, 3, "two")}


def test_a_later_method_labels_what_an_earlier_one_cannot(spark):
    from pulsegrid.operators.clustering import first_that_holds

    active = spark.createDataFrame([(r, p) for r in "abc" for p in range(4)], "recording_id string, pixel_id int")
    edges = spark.createDataFrame([(r, 0, 1, 0.9) for r in "abc"], "recording_id string, src int, dst int, weight double")
    seen = []

    def fails_for(name, *bad):
        def run(pixels, links):
            seen.append((name, sorted(r[0] for r in links.select("recording_id").distinct().collect())))
            return pixels.select("*", F.when(~F.col("recording_id").isin(*bad) | (F.col("pixel_id") > 0), F.lit(len(seen))).alias("label"))

        return run

    got = {(r["recording_id"], r["label"], r["status"]) for r in first_that_holds(active, edges, {"x": fails_for("x", "b", "c"), "y": fails_for("y", "c")}).collect()}
    assert got == {("a", 1, "x"), ("b", 2, "y"), ("c", 0, "single")} and seen == [("x", ["a", "b", "c"]), ("y", ["b", "c"])]
    assert {r["status"] for r in first_that_holds(active, edges).collect()} == {"communities"}


def test_pixels_come_back_from_tiles_of_any_number(spark):
    # 3 frames of 40 x 15 of which the last column and a row are empty
    made = [("r", t, y, x, float(t + y * 100 + x)) for t in range(3) for y in range(40) for x in range(14) if y != 7]
    cut = tiles.to_tiles(spark.createDataFrame(made, "recording_id string, t int, y int, x int, v double"), 16, 15)
    assert max(len(r["pixels"]) for r in cut.collect()) == 16 * 15
    got = {(r["t"], r["y"], r["x"]): r["v"] for r in tiles.pixels_of(cut, 16).collect()}
    want = {(t, y, x): 0.0 for t in range(3) for y in range(40) for x in range(15)} | {(t, y, x): v for _, t, y, x, v in made}
    assert got == want
    # a value's place is found by its number, not by a walk through the tile's map
    assert "element_at" not in cut._jdf.queryExecution().analyzed().toString()
