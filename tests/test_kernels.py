"""Kernels and array columns against plain versions and known answers."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import peaks
from pulsegrid.operators import activity, bandpass, baseline, clustering, encoder, features, graphs, kinetics, sampling, scalar, spatial


def packed(spark, rows):
    return spark.createDataFrame([("r", i, [float(x) for x in v]) for i, v in enumerate(rows)], "recording_id string, pixel_id int, v array<double>")


def plain_peaks(v):
    out, i = [], 1
    while i < len(v) - 1:
        if v[i] > v[i - 1]:
            j = i
            while j + 1 < len(v) and v[j + 1] == v[i]:
                j += 1
            if j + 1 < len(v) and v[j + 1] < v[i]:
                out.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    return out


def plain_prominence(v, p):
    left = next((i for i in range(p - 1, -1, -1) if v[i] > v[p]), -1)
    right = next((i for i in range(p + 1, len(v)) if v[i] > v[p]), len(v))
    return v[p] - max(min(v[left + 1 : p + 1]), min(v[p:right]))


def test_peaks_with_plateaus_and_prominences(spark):
    rng = np.random.default_rng(1)
    rows = [rng.integers(0, 4, 40).tolist() for _ in range(20)] + [[1, 3, 3, 3, 1], [3, 3, 1, 3, 3], [0], [], [1, 2], [2, 2, 2]]
    df = packed(spark, rows).withColumn("p", peaks.local_maxima(F.col("v")))
    df = df.withColumn("h", peaks.prominences(F.col("v"), F.col("p")))
    for r in df.collect():
        want = plain_peaks(r["v"])
        assert r["p"] == want
        assert r["h"] == [plain_prominence(r["v"], p) for p in want]


def test_peaks_apart_keep_the_higher_and_of_equals_the_later(spark):
    df = packed(spark, [[0, 5, 0, 5, 0, 0, 0, 4, 0]]).withColumn("p", peaks.local_maxima(F.col("v")))
    assert df.select(peaks.keep_apart(F.col("v"), F.col("p"), 3)).first()[0] == [3, 7]


def test_band_edges_are_three_decibels_and_the_phase_is_zero():
    sections = bandpass.design(0.1, 0.4)
    for edge in (0.1, 0.4):
        z = np.exp(-1j * np.pi * edge * np.arange(3))
        gain = np.prod([(s[:3] @ z) / (s[3:] @ z) for s in sections])
        assert abs(20 * np.log10(abs(gain)) + 3.0103) < 0.01
    t = np.arange(400)
    wave = np.sin(np.pi * 0.2 * t)
    out = bandpass.zero_phase(sections, wave[None])[0]
    assert np.abs(out - wave)[100:300].max() < 0.02
    constant = bandpass.zero_phase(sections, np.full((1, 100), 7.0))
    assert np.abs(constant).max() < 1e-6
    short = np.ones((1, 27))
    assert bandpass.zero_phase(sections, short) is short


def test_decay_fit_finds_the_constant():
    t = np.linspace(0, 6, 60)
    a, tau, c = baseline.fit_decay(t, 5 * np.exp(-t / 1.7) + 2)
    assert (abs(a - 5), abs(tau - 1.7), abs(c - 2)) < (1e-3, 1e-3, 1e-3)


def test_decay_time_of_a_transient(spark):
    t = np.arange(60) * 6 / 59
    v = np.where(t < 1, 0, 10 * np.exp(-(t - t[10]) / 0.5))
    tau = kinetics.taus(packed(spark, [v, np.zeros(60)]), 6.0).orderBy("pixel_id").collect()
    assert abs(tau[0]["tau_ms"] - 500) < 1 and tau[1]["tau_ms"] is None


def test_flat_signals_have_no_kinetics_and_no_beats(spark):
    flat = packed(spark, [np.ones(30)])
    assert kinetics.single_transient(flat, 3.0).count() == 0
    trace = spark.createDataFrame([("r", i, i / 10, 1.0) for i in range(30)], "recording_id string, t int, time_s double, v double")
    assert activity.beats(trace, 10.0).first()["beats"] == []


def test_dominant_frequency_and_phase_of_a_sine(spark):
    t = np.arange(60) * 6 / 59
    hertz = 7 * 59 / (60 * 6)
    rows = packed(spark, [np.sin(2 * np.pi * hertz * t), np.zeros(60), np.full(60, np.nan), np.sin(np.arange(9)), []]).select("pixel_id", features.spectrum(F.col("v"), 6.0).alias("s")).orderBy("pixel_id").collect()
    assert abs(rows[0]["s"]["dom_freq"] - hertz) < 1e-9 and [r["s"]["dom_freq"] for r in rows[1:3]] == [0, 0] and rows[4]["s"] == (0, 0)
    assert abs(features.mean_phase(np.cos(2 * np.pi * np.arange(64) / 64)[None])[0]) < 0.06


def test_spectrum_does_not_grow_the_plan(spark):
    df = packed(spark, [np.sin(np.arange(3000))])
    plan = df.select(features.spectrum(F.col("v"), 300.0).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 2000


def test_blocks_of_a_filter_equal_one_run():
    rng = np.random.default_rng(4)
    section = bandpass.design(0.06, 0.9)[1]
    x, state = rng.normal(size=(3, 1001)), rng.normal(size=(3, 2))
    b0, b1, b2, _, a1, a2 = section
    want = np.empty_like(x)
    z1, z2 = state.T
    for i in range(x.shape[1]):
        want[:, i] = o = b0 * x[:, i] + z1
        z1, z2 = b1 * x[:, i] - a1 * o + z2, b2 * x[:, i] - a2 * o
    np.testing.assert_allclose(bandpass.recurrence(section, x, state), want, atol=1e-9)
    assert bandpass.recurrence(section, x[:, :1], state).shape == (3, 1)


def test_sliding_quantile_and_lines():
    rng = np.random.default_rng(5)
    for n, k in ((1, 1), (2, 5), (40, 3), (60, 3), (200, 12)):
        v = rng.integers(0, 9, n).astype(float)
        np.testing.assert_allclose(baseline.sliding_quantile(v, k), [np.quantile(v[max(i - k, 0) : i + k + 1], 0.1) for i in range(n)])
    v, m = rng.random(50), np.array([4, 9, 30])
    got = baseline.lines_of(v, m)
    assert np.allclose(got[m], v[m]) and np.allclose(got[4:10], np.interp(np.arange(4, 10), m, v[m])) and np.isclose(got[0], v[4] - 4 * (v[9] - v[4]) / 5) and np.isclose(got[49], v[30] + 19 * (v[30] - v[9]) / 21)


def test_synchronicity_equals_the_mean_correlation(spark):
    rows = np.random.default_rng(2).normal(size=(6, 40)) + np.sin(np.arange(40))
    got = activity.synchronicity(packed(spark, rows)).first()["sync_index"]
    corr = np.corrcoef(rows)
    assert abs(got - corr[np.triu_indices(6, 1)].mean()) < 1e-9


def test_correlation_graph_finds_shifts_and_cuts_opposites(spark):
    x = np.sin(np.arange(40) / 3)
    edges = graphs.correlation_graph(packed(spark, [x, np.roll(x, 3), -np.eye(40)[5], np.eye(40)[5]]), 4).toPandas().set_index(["src", "dst"])["weight"]
    assert len(edges) == 3 and edges[0, 1] > 0.85 and edges[2, 3] == pytest.approx(1 / 39, abs=0.05)


def test_block_means_fill_the_edge_with_zeros(spark):
    rows = [("r", 0, y, x, 4.0) for y in range(3) for x in range(3)]
    got = {(r["by"], r["bx"]): r["v"] for r in spatial.block_mean(spark.createDataFrame(rows, "recording_id string, t int, y int, x int, v double"), 2).collect()}
    assert got == {(0, 0): 4.0, (0, 1): 2.0, (1, 0): 2.0, (1, 1): 1.0}


def test_blur_keeps_a_flat_frame_and_its_sum(spark):
    image = np.zeros((9, 9))
    image[4, 4] = 1
    rows = [("r", 0, 9, 9, image.ravel().tolist()), ("r", 1, 9, 9, [2.0] * 81)]
    got = spatial.blur(spark.createDataFrame(rows, "recording_id string, t int, height int, width int, pixels array<double>"), 1.0).orderBy("t").collect()
    assert abs(sum(got[0]["pixels"]) - 1) < 1e-9 and np.allclose(got[1]["pixels"], 2)


def test_sanitise_refuses_a_broken_recording(spark):
    bad = spark.createDataFrame([("r", 0, i, float("nan")) for i in range(10)], "recording_id string, pixel_id int, t int, v double")
    with pytest.raises(Exception, match="too few finite values"):
        scalar.sanitise(bad).collect()


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([("r", 1, 0.0005, 0.0015)], "recording_id string, pixel_id int, bpm double, amp double")
    row = sampling.metrics_sheet(df).first()
    assert (row["bpm"], row["amp"]) == (0.0, 0.002)


def test_sample_is_repeatable_without_replacement_and_takes_all_of_few(spark):
    df = spark.createDataFrame([("r", i, float(i % 5)) for i in range(40)], "recording_id string, pixel_id int, weight double")
    one, two = ([r["pixel_id"] for r in sampling.weighted_sample(df, 10).orderBy("rank").collect()] for _ in range(2))
    assert one == two and len(set(one)) == 10 and all(i % 5 for i in one)
    assert sampling.weighted_sample(df.where("pixel_id < 3"), 10).count() == 3


def same_partition(a, b):
    return len({*zip(a, b, strict=True)}) == len(set(a)) == len(set(b))


def test_density_clusters_two_blobs_and_noise():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 0.1, (30, 2)), rng.normal(5, 0.1, (30, 2)), [[20, 20]]])
    labels = clustering.density_clusters(len(x), lambda i: np.sqrt(((x - x[i]) ** 2).sum(1)), 5)
    assert labels[-1] == -1 and same_partition(labels[:60], [0] * 30 + [1] * 30)


def of_pixels(found, recording="r"):
    return found.where(F.col("recording_id") == recording).orderBy("pixel_id").toPandas()["label"].tolist()


def graph(spark, edges):
    """Pixels and edges of a recording; a pixel for each end and one without edges."""
    links = spark.createDataFrame([("r", a, b, float(w)) for a, b, w in edges], "recording_id string, src int, dst int, weight double")
    n = max(max(a, b) for a, b, _ in edges) + 2
    return spark.createDataFrame([("r", i) for i in range(n)] + [("one", 0)], "recording_id string, pixel_id int"), links


def modularity(edges, labels):
    total, out, mass = 2 * sum(w for *_, w in edges), 0.0, {}
    for a, b, w in edges:
        out += 2 * w * (labels[a] == labels[b]) / total
        for x in (a, b):
            mass[labels[x]] = mass.get(labels[x], 0.0) + w
    return out - sum((m / total) ** 2 for m in mass.values())


def test_communities_split_a_chain_at_its_weak_link(spark):
    found = clustering.communities(*graph(spark, [(0, 1, 1), (1, 2, 1), (2, 3, 0.01), (3, 4, 1), (4, 5, 1)])).cache()
    assert same_partition(of_pixels(found), [0, 0, 0, 1, 1, 1, 2])
    assert of_pixels(found, "one") == [0]


def test_no_partition_of_a_small_graph_is_much_better_than_its_communities(spark):
    rng = np.random.default_rng(6)
    edges = [(a, b, round(float(rng.uniform(0.1, 1)), 3)) for a in range(8) for b in range(a + 1, 8) if rng.uniform() < 0.4]
    labels = of_pixels(clustering.communities(*graph(spark, edges)))

    def partitions(n, used=0):
        if not n:
            yield ()
            return
        for c in range(used + 1):
            for rest in partitions(n - 1, max(used, c + 1)):
                yield c, *rest

    best = max(modularity(edges, p) for p in partitions(8))
    assert modularity(edges, labels) >= 0.95 * best > 0


def test_spectral_labels_part_two_cliques(spark):
    pairs = [(a, b, 1.0) for k in (0, 8) for a in range(k, k + 8) for b in range(a + 1, k + 8)]
    pixels, links = graph(spark, [*pairs, (7, 8, 0.05)])
    found = clustering.spectral(pixels.where("recording_id = 'r' and pixel_id < 16"), links, rounds=15)
    assert same_partition(of_pixels(found), [0] * 8 + [1] * 8)


def test_spectral_rounds_write_one_table_of_blocks_and_labels_stay(spark, monkeypatch):
    pairs = [(a, b, 1.0) for k in (0, 8) for a in range(k, k + 8) for b in range(a + 1, k + 8)]
    pixels, links = graph(spark, [*pairs, (7, 8, 0.05)])
    plain, written = clustering.cut, []
    monkeypatch.setattr(clustering, "cut", lambda df, *spent: written.append(df.columns) or plain(df, *spent))
    monkeypatch.setattr(clustering, "BLOCK", 3)  # edges within blocks and between them
    found = clustering.spectral(pixels.where("recording_id = 'r' and pixel_id < 16"), links, rounds=12)
    assert same_partition(of_pixels(found), [0] * 8 + [1] * 8)
    assert sum("gram" in c for c in written) == 12 and sum("u" in c for c in written) == 0


def test_k_means_finds_blobs_of_each_recording(spark):
    rng = np.random.default_rng(8)
    rows = [(r, i, 2, (rng.normal(0, 0.1, 2) + (i % 2) * far).tolist()) for r, far in (("r", 5.0), ("s", 50.0)) for i in range(20)]
    rows += [("same", i, 2, [1.0, 1.0]) for i in range(4)]
    found = clustering.k_means(spark.createDataFrame(rows, "recording_id string, pixel_id int, k int, x array<double>"), 2, 4).cache()
    for r in "rs":
        assert same_partition(of_pixels(found, r), [0, 1] * 10)
    assert of_pixels(found, "same") == [0] * 4


def test_k_means_rounds_read_blocks_and_end_where_no_point_is_nearer_another_mean(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n, written = 3000, []
    x = rng.normal(0, 1, (n, 3)) + rng.integers(0, 4, (n, 1)) * 6
    plain = clustering.cut
    monkeypatch.setattr(clustering, "cut", lambda df, *spent: written.append(plain(df, *spent)) or written[-1])
    rows = [("r", i, 4, v.tolist()) for i, v in enumerate(x)]
    found = clustering.k_means(spark.createDataFrame(rows, "recording_id string, pixel_id int, k int, x array<double>"), 3, 4)
    labels = np.array(of_pixels(found))
    # three blocks of points, and no table of points for each run
    assert written[0].count() == -(-n // clustering.BLOCK) and set(written[0].columns) >= {"block", "pixels"}
    means = np.stack([x[labels == c].mean(0) for c in range(4)])
    assert (((x[:, None] - means) ** 2).sum(2).argmin(1) == labels).all()


def test_few_or_flat_features(spark):
    assert clustering.density_labels(np.zeros((2, 5))).tolist() == [-2, -2]
    assert clustering.density_labels(np.ones((5, 5))).tolist() == [0] * 5
    rows = [("few", i, float(i), 1.0) for i in range(2)] + [("flat", i, 3.0, 1.0) for i in range(5)]
    found = clustering.cluster_features(spark.createDataFrame(rows, "recording_id string, pixel_id int, a double, b double"), ["a", "b"], "k-means").cache()
    assert of_pixels(found, "few") == [-2, -2] and of_pixels(found, "flat") == [0] * 5
    assert clustering.graph_density_labels(1, np.array([], int), np.array([], int), np.array([])).tolist() == [0]


def test_embedding_in_blocks_changes_nothing(spark):
    p = packed(spark, np.sin(np.arange(40) * np.linspace(0.2, 1.5, 9)[:, None]))
    weights = encoder.train_encoders(p, epochs=2).cache()
    one, two = (encoder.embed(p, weights, n).orderBy("pixel_id").toPandas()["embedding"].tolist() for n in (4096, 2))
    np.testing.assert_allclose(np.array(one), np.array(two), atol=1e-6)


def test_encoder_gradients_and_size():
    w = encoder.new_weights(1)
    assert sum(w[k].size for k in encoder.trained(w)) == 60_480
    x = np.random.default_rng(4).normal(size=(4, 24))

    def loss(weights):
        _, z, kept = encoder.forward(dict(weights), x, True)
        return encoder.contrastive_loss(z[:2], z[2:]), kept

    (base, da, db), kept = loss(w)
    grads = encoder.backward(w, kept, np.concatenate([da, db]))
    rng = np.random.default_rng(5)
    for k in ("c0", "c1", "c2", "g1", "s2", "h0", "h1", "hb1", "cb2"):
        at = tuple(rng.integers(0, n) for n in w[k].shape)
        up, down = ({**w, k: w[k].copy()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert grads[k][at] == pytest.approx((loss(up)[0][0] - loss(down)[0][0]) / 2e-5, rel=2e-3, abs=1e-7)


def test_training_lowers_the_loss():
    x = np.sin(np.arange(40) * np.linspace(0.2, 1.5, 16)[:, None])
    _, losses = encoder.train(x, epochs=25)
    assert np.mean(losses[-5:]) < np.mean(losses[:5])


def test_label_map_fills_in_inactive_pixels(spark):
    pixels = spark.createDataFrame([("r", i) for i in range(3)], "recording_id string, pixel_id int")
    labels = spark.createDataFrame(pd.DataFrame({"recording_id": ["r", "r"], "pixel_id": [0, 2], "label": [-1, 1]}))
    got = [(r["label"], r["map_value"]) for r in scalar.label_map(pixels, labels).orderBy("pixel_id").collect()]
    assert got == [(-1, 1), (-2, 0), (1, 3)]


@pytest.mark.parametrize("kind", ["even", "ties", "copies", "pairs", "blobs", "few"])
def test_the_tree_of_points_gives_the_plain_trees_lengths_and_labels(kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(7 if kind == "few" else 600, 5))
    if kind == "ties":
        x = np.round(x)
    elif kind in ("copies", "pairs"):
        x = np.repeat(x, 2 if kind == "pairs" else 4, 0)[rng.permutation(len(x) * (2 if kind == "pairs" else 4))]
    elif kind == "blobs":
        x[:200], x[200:400] = x[:200] * 0.1 + 2, x[200:400] * 0.1 - 2
    n, least = len(x), max(3, len(x) // 15)
    tree, row = clustering.point_tree(x), lambda i: np.sqrt(((x - x[i]) ** 2).sum(1))
    assert tree[:, 2].tolist() == clustering.spanning_tree(n, row, 2)[:, 2].tolist()
    assert clustering.condensed(n, tree, least).tolist() == clustering.density_clusters(n, row, least).tolist()


def test_density_of_many_points_does_not_grow_with_their_square():
    # 140,000 points of 390 kinds, as a grid of repeated signals has them; by all pairs 23,400 took a minute
    kinds = np.random.default_rng(6).normal(size=(390, 5))
    labels = clustering.density_labels(np.tile(kinds, (360, 1)))
    assert (labels.reshape(360, 390) == labels[:390]).all()


def test_bandpass_memory_does_not_grow_with_the_rows_of_a_batch():
    class Batches:
        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):  # noqa: N802
            return run

    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"recording_id": "r", "pixel_id": np.arange(10_000), "v": list(rng.normal(size=(10_000, 60)))})
    tracemalloc.start()
    (out,) = bandpass.bandpass(Batches(), 10.0)(iter([pdf]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20  # 60 MB when all rows were filtered at once
    assert np.array_equal(np.stack(out["v"])[::999], bandpass.zero_phase(bandpass.design(*bandpass.band(10.0)), np.stack(pdf["v"])[::999]))
