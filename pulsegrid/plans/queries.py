"""The registered queries: each applies one operator to the virtual recording or the vectors of the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, shared_path
from ..functions.peaks import keep_apart, local_maxima
from ..operators import activity, bandpass, baseline, clustering, encoder, features, graphs, kinetics, sampling, scalar, spatial, tiles
from ..sources import sinks, stacks, timing
from ..streaming import arrivals, beats
from .analysis import analyse, batch, cascade, prepare
from .recording import GRID, Params, auto_bin, likely_duration, pack, packed, signals, unpack

FRAMES, WIDTH, DURATION, FPS = GRID.frames, GRID.width, GRID.duration, GRID.fps
PIXEL = scalar.PIXEL


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


def _base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Signals, packed signals, mask and beats of the recording; what several branches read is written once."""
    p = cut(packed(spark, sf_dir))
    s = unpack(p)
    mask = cut(activity.activity_mask(cut(activity.pulsatility(s))))
    return s, p, mask, activity.beats(activity.reference_trace(s, mask), FPS)


def _values(df: DataFrame) -> DataFrame:
    return _rounded(df.select(*PIXEL, "t", "v"), "v")


def prj01(spark, d):
    return _values(scalar.normalise(signals(spark, d)))


def prj04(spark, d):
    return scalar.coordinates(packed(spark, d).select(*PIXEL), WIDTH)


def prj06(spark, d):
    # what would divide by nothing isn't finite
    s = signals(spark, d)
    return _values(scalar.sanitise(s.withColumn("v", F.when(F.col("v") % 7 < 1, F.lit(float("inf"))).otherwise(F.col("v")))))


def prj08(spark, d):
    return _values(unpack(scalar.centre_l2(packed(spark, d))))


def prj09(spark, d):
    return _values(unpack(scalar.zscore(packed(spark, d))))


def prj10(spark, d):
    f = signals(spark, d).groupBy(*PIXEL).agg(F.var_pop("v").alias("puls"), (F.max("v") - F.min("v")).alias("range"))
    return _rounded(scalar.standardise(f, ["puls", "range"]), "puls", "range")


def stn01(spark, d):
    # frames grow with the users, so they are blurred as tiles
    cut_up = tiles.to_tiles(scalar.coordinates(signals(spark, d), WIDTH).select("recording_id", "t", "y", "x", "v"), 64, WIDTH)
    return _rounded(tiles.pixels_of(tiles.blur(cut_up, 64, 0.8), 64), "v")


def stn02(spark, d):
    return _rounded(spatial.block_mean(scalar.coordinates(signals(spark, d), WIDTH), 2), "v")


def win01(spark, d):
    return _rounded(baseline.envelope(signals(spark, d), FRAMES).select(*PIXEL, "t", "env"), "env")


def win02(spark, d):
    s = signals(spark, d)
    return baseline.corrected(s, FRAMES, "Single Exp").select(*PIXEL, "t", "v")


def win02_fit(spark, d):
    """How well the decay fits each envelope: the mean squared error, which is settled to all digits where the time constant isn't."""
    known = baseline.on_axis(signals(spark, d)).select(*PIXEL, baseline.rolling(F.col("v"), FRAMES).alias("env"), F.col("time_s").alias("times"))
    both = baseline.decay_baseline(known).join(known, PIXEL)
    error = scalar.mean_of(F.zip_with("env", "baseline", lambda y, b: (y - b) * (y - b)))
    return _rounded(both.select(*PIXEL, error.alias("error")), "error")


def win03(spark, d):
    s = signals(spark, d)
    return _values(baseline.corrected(s, FRAMES, "Boundary"))


def win04(spark, d):
    return _values(scalar.above_minimum(signals(spark, d)))


def win05(spark, d):
    return _values(unpack(bandpass.bandpass(packed(spark, d), FPS)))


def win06(spark, d):
    return packed(spark, d).select(*PIXEL, F.explode(local_maxima(F.col("v"))).alias("t"))


def win07(spark, d):
    return _rounded(activity.peak_prominences(packed(spark, d)), "prominence")


def win08(spark, d):
    p = packed(spark, d).withColumn("p", local_maxima(F.col("v")))
    return p.select(*PIXEL, F.explode(keep_apart(F.col("v"), F.col("p"), 8)).alias("t"))


def win09(spark, d):
    return _rounded(activity.level_crossing(packed(spark, d), DURATION), "time_s")


def win10(spark, d):
    p = packed(spark, d).withColumn("p", local_maxima(F.col("v")))
    return p.select(*PIXEL, kinetics.period(F.col("p"), F.size("v")).alias("period"))


def agg01(spark, d):
    return _rounded(activity.pulsatility(signals(spark, d)), "pulsatility")


def agg02(spark, d):
    return activity.activity_mask(activity.pulsatility(signals(spark, d))).select(*PIXEL, "active")


def agg03(spark, d):
    s = signals(spark, d)
    return _rounded(activity.reference_trace(s, activity.activity_mask(activity.pulsatility(s))).select("recording_id", "t", "v"), "v")


def agg04(spark, d):
    return _base(spark, d)[3].select("recording_id", F.posexplode("beats").alias("beat_no", "t"))


def agg05(spark, d):
    _, p, mask, beats = _base(spark, d)
    return _rounded(activity.activation_map(p, mask, beats, FPS, DURATION), "activation_ms")


def agg06(spark, d):
    _, p, mask, beats = _base(spark, d)
    return _rounded(features.features(p, p, mask, beats, FPS, DURATION).drop("phase_offset"), "puls", "dom_freq", "mean_amp", "duty")


def _filtered(spark, d):
    """Packed signals, the same filtered, and the mask of the filtered ones' variance."""
    p = cut(packed(spark, d))
    f = cut(bandpass.bandpass(p, FPS))
    return p, f, cut(activity.activity_mask(cut(activity.pulsatility(f.select(*PIXEL, F.explode("v").alias("v"))))))


def agg06_phase(spark, d):
    """All five features as the analysis takes them: of band-passed signals, whose variance makes the mask."""
    p, f, mask = _filtered(spark, d)
    beats = activity.beats(activity.reference_trace(unpack(p), mask), FPS)
    return _rounded(features.features(p, f, mask, beats, FPS, DURATION), *features.FEATURES)


def agg07(spark, d):
    return _rounded(activity.synchronicity(packed(spark, d)), "sync_index")


def agg07_filtered(spark, d):
    """Synchronicity as the analysis takes it: of the active pixels' band-passed signals."""
    _, f, mask = _filtered(spark, d)
    return _rounded(activity.synchronicity(f.join(mask.where("active").select(*PIXEL), PIXEL)), "sync_index")


def agg09(spark, d):
    return _rounded(kinetics.single_transient(packed(spark, d), DURATION), *kinetics.KINETICS)


def agg10(spark, d):
    _, p, _, beats = _base(spark, d)
    return _rounded(kinetics.beat_averaged(p, beats, DURATION).drop("cd_estimated"), *kinetics.KINETICS)


def agg11(spark, d):
    return _rounded(kinetics.taus(packed(spark, d), DURATION), "tau_ms")


def gra01(spark, d):
    return _rounded(graphs.correlation_graph(packed(spark, d), WIDTH), "weight")


def vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.lit("embeddings").alias("recording_id"), F.col("vec_id").cast("int").alias("pixel_id"), "embedding")


def gra02(spark, d):
    return _rounded(graphs.cosine_graph(vectors(spark, d), 25), "weight")


def agg08(spark, d):
    p = packed(spark, d)
    labels = p.select(*PIXEL, (F.col("pixel_id") % 3).alias("label"))
    return _rounded(graphs.cluster_score(graphs.correlation_graph(p, WIDTH), labels), "score")


def joi05(spark, d):
    s = signals(spark, d)
    mask = activity.activity_mask(activity.pulsatility(s))
    return scalar.label_map(mask, mask.where("active").select(*PIXEL, (F.col("pixel_id") % 3 - 1).alias("label")))


def smp01(spark, d):
    return sampling.heaviest(sampling.amplitudes(packed(spark, d, by_type=True))).select(*PIXEL, "rank")


def smp02(spark, d):
    return sampling.weighted_sample(sampling.amplitudes(packed(spark, d, by_type=True))).select(*PIXEL, "rank")


def snk04(spark, d):
    return sampling.metrics_sheet(_rounded(kinetics.single_transient(packed(spark, d), DURATION), *sampling.METRIC_ORDER))


def _labels(mask):
    """A label of each pixel: -2 for inactive ones."""
    return mask.select(*PIXEL, F.when(F.col("active"), F.col("pixel_id") % 3 - 1).otherwise(-2).alias("label"))


def smp02_labelled(spark, d):
    _, p, mask, _ = _base(spark, d)
    return sampling.labelled_sample(p, _labels(mask)).select(*PIXEL, "rank", "point")


def ui05(spark, d):
    """The traces of the sampled cells."""
    s, p, mask, _ = _base(spark, d)
    chosen = sampling.labelled_sample(p, _labels(mask)).select(*PIXEL, "point")
    return _rounded(s.join(F.broadcast(chosen), PIXEL).select("recording_id", "point", "t", "time_s", "v"), "time_s", "v")


def ui06(spark, d):
    """The beat-averaged metrics of the sampled cells."""
    _, p, mask, beats = _base(spark, d)
    chosen = cut(sampling.labelled_sample(p, _labels(mask)).select(*PIXEL, "point"))
    averaged = kinetics.beat_averaged(p.join(F.broadcast(chosen.select(*PIXEL)), PIXEL), beats, DURATION)
    return _rounded(averaged.join(F.broadcast(chosen), PIXEL).select("recording_id", "point", *kinetics.KINETICS), *kinetics.KINETICS)


def _metadata(spark, d):
    """What files may say about their timing, for a file of each document: the eight cases of the chain by doc_id."""
    i = F.col("doc_id")
    only = lambda k, text: F.when(i % 8 == k, text)
    number = lambda c: c.cast("string")
    ending = F.when(i % 8 == 7, ".vsi").when(i % 16 < 8, ".tiff").otherwise(".TIF")
    return spark.read.parquet(f"{d}/documents.parquet").select(
        i, F.concat(F.lit("in/"), number(i), ending).alias("path"), only(0, F.concat(F.lit('{"fps": '), number(F.col("n_chars") / 10 + 1), F.lit("}"))).alias("sidecar"),
        (i % 100).cast("int").alias("ets_frames"), (i % 90).cast("int").alias("series_frames"), F.when((i % 8).isin(1, 7), 0.04 + i % 5 / 100).when(i % 8 == 2, 1.0).alias("finterval"),
        only(2, i % 50 + 0.5).alias("fps_tag"), only(2, F.lit("tifffile.py")).alias("software"),
        only(3, F.concat(F.lit('<OME xmlns="o"><Image><Pixels TimeIncrement="'), number(50 + i % 7), F.lit('" TimeIncrementUnit="ms"/></Image></OME>'))).alias("ome"),
        only(4, F.concat(F.lit('{"Interval_ms": '), number(20 + i % 11), F.lit("}"))).alias("summary"),
        only(5, F.concat(F.lit("Value #1 = 0\nUnits #1 = 10^-3s^1\nValue #2 = "), number(40 + i % 9), F.lit("\nUnits #2 = 10^-3s^1\nValue #3 = 7\nUnits #3 = m"))).alias("info"),
    )


def src06(spark, d):
    return timing.timing(_metadata(spark, d)).select("doc_id", "path", F.round("fps", 6).alias("fps"), "fps_source", "n_frames", F.coalesce(F.size("timestamps"), F.lit(0)).alias("times"))


def src07(spark, d):
    use_fps, value = timing.batch_rate(F.col("finterval"), F.col("doc_id") % 3 == 0, F.lit(15.0))
    return _metadata(spark, d).select("doc_id", use_fps.alias("use_fps"), (F.round(value, 6) + 0.0).alias("value"))


def src04(spark, d):
    """Frame files, one for each document and as long as its text, in the folders of 50 recordings: the largest of each."""
    i = F.col("doc_id")
    number = lambda k: (i % k).cast("string")
    ending = F.when(i % 4 == 0, ".tif").when(i % 4 == 1, ".ETS").otherwise(".ets")
    path = F.concat(F.lit("in/_rec"), number(50), F.lit("_/stack"), number(3), F.lit("/frame_"), i.cast("string"), ending)
    return stacks.largest(spark.read.parquet(f"{d}/documents.parquet").select(path.alias("path"), F.col("n_chars").cast("long").alias("length")))


def snk01_written(spark, d):
    """The sidecars written, written again, and read."""
    path = shared_path(spark, "sidecars")
    for _ in range(2):
        sinks.save_sidecars(snk01(spark, d), path)
    return sinks.load_sidecars(spark, path)


def snk06(spark, d):
    """The batch's rows by recording: written, one recording written again, and read."""
    rows, path = cut(orc02(spark, d)), shared_path(spark, "batch")
    sinks.overwrite(rows, path, "Filename")
    sinks.overwrite(rows.where("Filename = 'click'"), path, "Filename")
    return sinks.read(spark, path, rows.schema)


def snk01(spark, d):
    known = timing.timing(_metadata(spark, d)).where("fps is not null")
    return timing.sidecars(known.select("path", "fps"))


def prj02(spark, d):
    """A recording for each user, of as many frames as events: its length, the bin for its frame size, and whether to run it unasked."""
    i = F.col("user_id")
    found = spark.read.parquet(f"{d}/events.parquet").groupBy(i).agg(F.count("*").alias("frames"))
    seconds = scalar.duration(F.col("frames"), i % 2 == 0, 15.0 + i % 10)
    size = F.col("frames") * 20, (i % 7 + 1) * 400
    return _rounded(found.select("user_id", "frames", seconds.alias("seconds"), auto_bin(*size).alias("bin_size"), likely_duration(seconds).alias("likely")), "seconds")


def snk05(spark, d):
    s = scalar.coordinates(signals(spark, d).where(F.col("pixel_id") < 3), WIDTH)
    point = F.concat(F.lit("P"), (F.col("pixel_id") + 1).cast("string"))
    named = s.withColumn("name", sampling.cell_name(F.col("recording_id"), point, F.col("y"), F.col("x")))
    names = [f"events_P{i + 1}_Y{i // WIDTH}X{i % WIDTH}" for i in range(3)]
    return _rounded(sampling.traces_sheet(named, names), "time_s", *names)


def orc02(spark, d):
    """The batch on raw signals, the heaviest pixels of each recording: what SQL can follow; ``batch`` of the analysis draws at random."""
    p = packed(spark, d, by_type=True)
    chosen = sampling.heaviest(sampling.amplitudes(p)).select(*PIXEL)
    rows = scalar.coordinates(kinetics.single_transient(p.join(chosen, PIXEL), DURATION), WIDTH)
    named = rows.withColumnsRenamed({"recording_id": "Filename", "pixel_id": "ID", "x": "X (Binned)", "y": "Y (Binned)"})
    return _rounded(sampling.batch_columns(named), *kinetics.KINETICS)


def _active(spark, d):
    p = cut(packed(spark, d))
    mask = cut(activity.activity_mask(cut(activity.pulsatility(unpack(p)))))
    return p, mask, p.join(mask.where("active").select(*PIXEL), PIXEL)


def clu01(spark, d):
    _, p, mask, beats = _base(spark, d)
    told = features.features(p, bandpass.bandpass(p, FPS), mask, beats, FPS, DURATION)
    return scalar.label_map(mask, clustering.cluster_features(told, features.FEATURES))


def clu02(spark, d):
    _, p, mask, beats = _base(spark, d)
    told = features.features(p, bandpass.bandpass(p, FPS), mask, beats, FPS, DURATION)
    return scalar.label_map(mask, clustering.cluster_features(told, features.FEATURES, "k-means"))


def gra03(spark, d):
    _, mask, active = _active(spark, d)
    return scalar.label_map(mask, clustering.cluster_graph(active, graphs.correlation_graph(active, WIDTH)))


def gra04(spark, d):
    _, mask, active = _active(spark, d)
    return scalar.label_map(mask, clustering.cluster_graph(active, graphs.correlation_graph(active, WIDTH), "spectral"))


def gra05(spark, d):
    _, mask, active = _active(spark, d)
    return scalar.label_map(mask, clustering.cluster_graph(active, graphs.correlation_graph(active, WIDTH), "density"))


def nn03(spark, d):
    """Forward loss of rows 2i and 2i + 1 as partners, within blocks of 64 vectors."""
    v = vectors(spark, d).select(F.col("pixel_id").alias("i"), "embedding")
    v = v.where(F.col("i") < v.count() // 2 * 2).withColumn("block", F.floor(F.col("i") / 64))

    def run(pdf):
        z = np.stack([np.asarray(e, float) for e in pdf.sort_values("i")["embedding"]])
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "loss": [encoder.contrastive_loss(z[::2], z[1::2])[0]]})

    return _rounded(v.select("block", "i", "embedding").groupBy("block").applyInPandas(run, "block long, loss double"), "loss")


def nn04(spark, d):
    _, _, active = _active(spark, d)
    return encoder.train_encoders(active).select("recording_id", "first_loss", "last_loss")


def nn05(spark, d):
    _, mask, active = _active(spark, d)
    edges = graphs.cosine_graph(encoder.embed(active, encoder.train_encoders(active)), WIDTH)
    return scalar.label_map(mask, clustering.cluster_graph(active, edges))


def orc01(spark, d):
    """The whole analysis: labels of every pixel by each method."""
    return analyse(signals(spark, d), GRID).labels


def orc02_sampled(spark, d):
    return batch(signals(spark, d, by_type=True), GRID)[0]


def orc01_front(spark, d):
    """Raw frames, a recording for each event type, to signals and the mask: tiles, normalised, blurred, binned."""
    params = Params(bin_size=2, use_fps=True, value=FPS, sigma=0.8, tile=8)
    pixels = scalar.coordinates(signals(spark, d, by_type=True), WIDTH).select("recording_id", "t", "y", "x", "v")
    s = prepare(cut(tiles.to_tiles(pixels, params.tile)), FRAMES, 1, params)
    return _rounded(activity.activity_mask(cut(activity.pulsatility(s))).select(*PIXEL, "pulsatility", "active"), "pulsatility")


def orc02_isolated(spark, d):
    """The batch of a recording for each event type, one of them broken: kinetics of the heaviest active pixels, and a row that tells what failed."""
    s = signals(spark, d, by_type=True).withColumn("v", F.when(F.col("recording_id") == "error", F.lit(float("inf"))).otherwise(F.col("v")))
    rows, failures = batch(s, GRID, seed=None)
    told = _rounded(rows.drop("cd_estimated"), *kinetics.KINETICS).withColumn("status", F.lit("ok"))
    return told.unionByName(failures.select(F.col("recording_id").alias("Filename"), F.col("error").alias("status")), allowMissingColumns=True)


def gra06(spark, d):
    """The first method that labels all pixels of a recording, else one cluster; here methods by the pixel's number that fail for some recordings, on the correlation graph."""
    p = packed(spark, d, by_type=True)
    edges = graphs.correlation_graph(p.where("pixel_id < 60"), WIDTH)

    def by(k, *fails):
        # a pixel's label is its remainder and how many neighbours it has
        def run(active, edges):
            ends = edges.select(*PIXEL[:1], F.explode(F.array("src", "dst")).alias("pixel_id")).groupBy(*PIXEL).agg(F.count("*").cast("int").alias("n"))
            label = F.when(~F.col("recording_id").isin(*fails) | (F.col("pixel_id") % 9 > 0), F.col("pixel_id") % k + 10 * F.coalesce("n", F.lit(0)))
            return active.join(ends, PIXEL, "left").select(*PIXEL, label.alias("label"))

        return run

    return clustering.first_that_holds(p, edges, {"communities": by(2, "click", "error", "view"), "spectral": by(3, "error", "view"), "density": by(4, "view")})


def clu03(spark, d):
    """Labels by three methods in turn, where the second and the third fail for a recording each; the methods here are remainders of the pixel's number."""
    p = packed(spark, d, by_type=True).select(*PIXEL)
    label = lambda k: (F.col("pixel_id") * 7 % k - 1).cast("int").alias("label")
    second = p.select(*PIXEL, label(3)).where("recording_id <> 'error'")
    third = p.select(*PIXEL, F.when(~F.col("recording_id").isin("click", "error") | (F.col("pixel_id") % 5 > 0), label(4)).alias("label"))
    return cascade(p, [("features", p.where("pixel_id % 11 > 0").select(*PIXEL, label(2))), ("correlation", second), ("contrastive", third)])


ORIGIN, HALF_DAY, LATE = "2024-01-01 00:00:00", 43_200, "1 day"


def str01(spark, d):
    """The events as a stream, told once all that is there is read: beats of each pixel, in frames that the watermark has passed."""
    # a pattern, as a stream takes no path of a single file
    events = arrivals.event_stream(spark, f"{d}/event[s].parquet", spark.read.parquet(f"{d}/events.parquet").schema)
    return _rounded(arrivals.settled(beats.beats(events, ORIGIN, HALF_DAY, LATE)), "v")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "prj01_normalise": prj01, "prj04_coordinates": prj04, "prj06_sanitise": prj06, "prj08_centre_l2": prj08, "prj09_zscore": prj09, "prj10_standardise": prj10,
    "stn01_blur": stn01, "stn02_block_mean": stn02, "win01_envelope": win01, "win02_exponential_baseline": win02, "win02_fit": win02_fit, "win03_boundary_baseline": win03, "win04_above_minimum": win04,
    "win05_bandpass": win05, "win06_local_maxima": win06, "win07_prominence": win07, "win08_peak_distance": win08, "win09_level_crossing": win09, "win10_beat_period": win10,
    "agg01_pulsatility": agg01, "agg02_activity_mask": agg02, "agg03_reference_trace": agg03, "agg04_beats": agg04, "agg05_activation_map": agg05, "agg06_features": agg06, "agg06_phase": agg06_phase,
    "agg07_synchronicity": agg07, "agg07_filtered": agg07_filtered, "agg08_cluster_score": agg08, "agg09_single_transient": agg09, "agg10_beat_averaged": agg10, "agg11_decay_tau": agg11,
    "gra01_correlation_graph": gra01, "gra02_cosine_graph": gra02, "joi05_label_map": joi05, "smp01_heaviest": smp01, "smp02_weighted_sample": smp02,
    "smp02_labelled_sample": smp02_labelled, "ui05_selected_traces": ui05, "ui06_selected_metrics": ui06, "src06_timing": src06, "src07_batch_rate": src07, "snk01_sidecars": snk01, "prj02_duration": prj02,
    "snk04_metrics_sheet": snk04, "snk05_traces_sheet": snk05, "orc02_batch": orc02,
    "clu01_density_clusters": clu01, "clu02_k_means": clu02, "gra03_communities": gra03, "gra04_spectral": gra04, "gra05_density_graph": gra05,
    "nn03_contrastive_loss": nn03, "nn04_train_encoders": nn04, "nn05_embedding_graph": nn05, "orc01_analysis": orc01, "orc02_sampled_batch": orc02_sampled, "orc01_front": orc01_front, "orc02_isolated": orc02_isolated, "clu03_inherited": clu03, "gra06_fallback": gra06, "str01_beats": str01, "src04_companions": src04, "snk01_written": snk01_written, "snk06_batch_written": snk06,
}
