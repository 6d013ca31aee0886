"""Whole analyses: one for any number of recordings at once, and the batch of kinetics of sampled pixels.

A recording that can't be analysed doesn't stop the others: it is told in a table of failures. A method that fails for a recording
leaves it the labels of the method before, and their status names it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import activity, bandpass, baseline, clustering, encoder, features, graphs, kinetics, sampling, scalar, tiles
from .recording import Grid, Params, pack, unpack

PIXEL = scalar.PIXEL


@dataclass(frozen=True)
class Analysis:
    """Results as lazy tables keyed by recording_id."""

    corrected: DataFrame
    filtered: DataFrame
    pulsatility: DataFrame
    mask: DataFrame
    trace: DataFrame
    beats: DataFrame
    activation: DataFrame
    features: DataFrame
    labels: DataFrame
    scores: DataFrame
    synchronicity: DataFrame
    failures: DataFrame


def prepare(raw: DataFrame, frames: int, height: int, params: Params) -> DataFrame:
    """Signals of raw tiles: normalised, blurred, binned, a pixel for each block; all recordings have ``frames`` frames of ``height`` rows."""
    sigma = height / 204.8 if params.sigma is None else params.sigma
    smooth = tiles.blur(tiles.normalise(raw), params.tile, sigma)
    cells = tiles.binned(smooth, params.tile, params.bin_size)
    step = params.duration(frames) / max(frames - 1, 1)
    return cells.select("recording_id", (F.col("y") * F.col("width") + F.col("x")).cast("int").alias("pixel_id"), "t", (F.col("t") * step).alias("time_s"), "v")


def analyse_raw(raw: DataFrame, frames: int, height: int, width: int, params: Params) -> Analysis:
    """The whole analysis of raw tiles of frames of ``height`` x ``width`` pixels."""
    grid = Grid(-(-width // params.bin_size), frames, params.duration(frames))
    return analyse(prepare(raw, frames, height, params), grid, params.model, params.epochs)


def sound(signals: DataFrame, most: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """The signals of recordings that can be analysed, and (recording_id, error) of the others: over ``most`` of the values aren't finite, or there is one frame at most."""
    told = signals.groupBy("recording_id").agg(F.avg((~scalar.finite(F.col("v"))).cast("double")).alias("share"), F.max("t").alias("last"))
    error = F.when(F.col("share") > most, "too few finite values").when(F.col("last") < 1, "no frames to compare")
    judged = told.select("recording_id", error.alias("error"))
    return signals.join(judged.where("error IS NULL").select("recording_id"), "recording_id"), judged.where("error IS NOT NULL")


def cascade(pixels: DataFrame, stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(recording_id, pixel_id, method, label, map_value, status): labels of every pixel by each method in turn.

    A stage's rows are (recording_id, pixel_id, label); a recording without any, or with a null label, has failed there and keeps the labels of the stage
    before, which ``status`` names; before the first all are -2 with the status ``none``.
    """
    out, before = None, pixels.select(*PIXEL, F.lit(-2).alias("label"), F.lit("none").alias("status"))
    for name, found in stages:
        well = found.groupBy("recording_id").agg(F.count("*").alias("rows"), F.count("label").alias("labels")).where("rows = labels").select("recording_id", F.lit(True).alias("well"))
        own = found.where("label IS NOT NULL").select(*PIXEL, F.col("label").alias("own"))
        told = before.join(own, PIXEL, "left").join(well, "recording_id", "left")
        label = F.when(F.col("well"), F.coalesce("own", F.lit(-2))).otherwise(F.col("label"))
        before = told.select(*PIXEL, label.alias("label"), F.when(F.col("well"), name).otherwise(F.col("status")).alias("status"))
        stage = before.select(*PIXEL, F.lit(name).alias("method"), "label", scalar.map_value(F.col("label")).alias("map_value"), "status")
        out = stage if out is None else out.unionByName(stage)
    return out


def analyse(signals: DataFrame, grid: Grid, model: str = "Single Exp", epochs: int = 100, contrastive: bool = True) -> Analysis:
    """The chain from signals to labels by three methods: density of features, communities of correlation, communities of embeddings.

    What several results read (corrected signals, the mask, labels of each method) is written once to the shared folder.
    """
    good, failures = sound(signals)
    packed = cut(pack(scalar.sanitise(baseline.corrected(good, grid.frames, model))))
    corrected = unpack(packed, grid)
    filtered = cut(bandpass.bandpass(packed, grid.fps))
    maps = cut(activity.pulsatility(filtered.select(*PIXEL, F.explode("v").alias("v"))))
    mask = cut(activity.activity_mask(maps))
    trace = activity.reference_trace(corrected, mask)
    beats = cut(activity.beats(trace, grid.fps))
    active = mask.where("active").select(*PIXEL)
    told = features.features(packed, filtered, mask, beats, grid.fps, grid.duration)
    stages = [("features", cut(clustering.cluster_features(told, features.FEATURES)))]
    signals_of = packed.join(active, PIXEL)
    edges = {"correlation": cut(graphs.correlation_graph(signals_of, grid.width))}
    if contrastive:
        edges["contrastive"] = cut(graphs.cosine_graph(encoder.embed(signals_of, encoder.train_encoders(signals_of, epochs)), grid.width))
    stages += [(name, clustering.first_that_holds(active, e)) for name, e in edges.items()]
    scores = None
    for name, found in stages[1:]:
        score = graphs.cluster_score(edges[name], found).withColumn("method", F.lit(name))
        scores = score if scores is None else scores.unionByName(score)
    return Analysis(
        corrected, filtered, maps, mask, trace, beats, activity.activation_map(packed, mask, beats, grid.fps, grid.duration), told, cascade(mask, stages), scores,
        activity.synchronicity(filtered.join(active, PIXEL)), failures,
    )


def batch(signals: DataFrame, grid: Grid, samples: int = 10, seed: int | None = 42) -> tuple[DataFrame, DataFrame]:
    """Kinetics of a weighted sample of each recording's active pixels over boundary baselines, and (recording_id, error) of recordings that failed.

    Without a seed the heaviest pixels are taken. Recordings without an active pixel have no row.
    """
    good, failures = sound(signals)
    packed = cut(pack(scalar.sanitise(baseline.corrected(good, grid.frames, "Boundary"))))
    maps = cut(activity.pulsatility(bandpass.bandpass(packed, grid.fps).select(*PIXEL, F.explode("v").alias("v"))))
    mask = activity.activity_mask(maps)
    weights = sampling.amplitudes(packed.join(mask.where("active").select(*PIXEL), PIXEL))
    chosen = (sampling.heaviest(weights, samples) if seed is None else sampling.weighted_sample(weights, samples, seed)).select(*PIXEL)
    rows = scalar.coordinates(kinetics.single_transient(packed.join(chosen, PIXEL), grid.duration), grid.width)
    named = rows.withColumnsRenamed({"recording_id": "Filename", "pixel_id": "ID", "x": "X (Binned)", "y": "Y (Binned)"})
    return sampling.batch_columns(named), failures
