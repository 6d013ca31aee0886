"""Raw frames as tiles: normalising, blurring and binning of frames of any size, no frame in one row or task.

A tile is a row (recording_id, t, ty, tx, height, width, pixels): ``size`` x ``size`` pixels in row order, less at a frame's right and lower
edge; height and width are the frame's. For a blur each tile sends its neighbours the strips that reach into their halo, so a tile
meets (2 ceil(radius / size) + 1)^2 pieces at most. Blocks for binning lie inside tiles and need no neighbour.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import exact_quantiles
from .spatial import gaussian_weights

KEY = ["recording_id", "t", "ty", "tx"]
TILES = "recording_id string, t int, ty int, tx int, height int, width int, pixels array<double>"


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def scattered(places: pd.Series, values: pd.Series, rows: pd.Series, columns: pd.Series, size: pd.Series) -> pd.Series:
    """Tiles in row order of ``values`` at ``places`` (row times ``size`` and column); 0 elsewhere."""
    out = []
    for at, v, h, w, n in zip(places, values, rows, columns, size, strict=True):
        tile = np.zeros(h * w)
        if at is not None:
            at = np.asarray(at, np.int64)
            tile[at // n * w + at % n] = v
        out.append(tile)
    return pd.Series(out)


def to_tiles(pixels: DataFrame, size: int, width: int | None = None) -> DataFrame:
    """Tiles of (recording_id, t, y, x, v); a pixel without a row is 0. ``width`` is the frames', by default up to a recording's last column with a row."""
    wide = F.max("x") + 1 if width is None else F.lit(width)
    frames = pixels.groupBy("recording_id").agg((F.max("y") + 1).cast("int").alias("height"), wide.cast("int").alias("width"))
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / size).cast("int")))
    grid = pixels.select("recording_id", "t").distinct().join(frames, "recording_id").withColumn("ty", axis("height")).withColumn("tx", axis("width"))
    local = lambda c: F.floor(F.col(c) / size).cast("int")
    place = ((F.col("y") % size) * size + F.col("x") % size).cast("int")
    cells = pixels.select("recording_id", "t", local("y").alias("ty"), local("x").alias("tx"), F.struct(place.alias("i"), F.coalesce("v", F.lit(0.0)).alias("v")).alias("cell"))
    known = cells.groupBy(*KEY).agg(F.collect_list("cell").alias("known"))
    rows, columns = (F.least(F.lit(size), F.col(n) - F.col(t) * size) for n, t in (("height", "ty"), ("width", "tx")))
    return grid.join(known, KEY, "left").select(*KEY, "height", "width", scattered("known.i", "known.v", rows, columns, F.lit(size)).alias("pixels"))


def pixels_of(tiles: DataFrame, size: int) -> DataFrame:
    """(recording_id, t, v, y, x) of tiles."""
    wide = F.least(F.lit(size), F.col("width") - F.col("tx") * size)
    each = tiles.select(*KEY, wide.alias("wide"), F.posexplode("pixels").alias("i", "v"))
    y, x = F.col("ty") * size + F.floor(F.col("i") / F.col("wide")).cast("int"), F.col("tx") * size + F.col("i") % F.col("wide")
    return each.select("recording_id", "t", "v", y.cast("int").alias("y"), x.cast("int").alias("x"))


def frames_to_tiles(frames: DataFrame, size: int) -> DataFrame:
    """Tiles of decoded frames (recording_id, t, height, width, pixels)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, t, height, width, pixels in zip(*(pdf[c] for c in ("recording_id", "t", "height", "width", "pixels")), strict=True):
                image = np.asarray(pixels, float).reshape(int(height), int(width))
                at = [(ty, tx) for ty in range(-(-image.shape[0] // size)) for tx in range(-(-image.shape[1] // size))]
                cut = [image[ty * size : (ty + 1) * size, tx * size : (tx + 1) * size].ravel() for ty, tx in at]
                yield pd.DataFrame({"recording_id": name, "t": t, "ty": [a for a, _ in at], "tx": [b for _, b in at], "height": height, "width": width, "pixels": cut})

    return frames.select("recording_id", "t", "height", "width", "pixels").mapInPandas(run, TILES)


def normalise(tiles: DataFrame, frames: int = 16, low: float = 0.004, high: float = 0.996) -> DataFrame:
    """Clip to the percentiles of a recording's first frames and scale to 0..255; a flat image gets a range of one."""
    first = tiles.where(F.col("t") < frames).select("recording_id", F.explode("pixels").alias("v"))
    bounds = exact_quantiles(first, "recording_id", "v", [low, high]).select("recording_id", F.col("q")[0].alias("least"), F.col("q")[1].alias("most"))
    bounds = bounds.withColumn("most", F.when(F.col("most") <= F.col("least"), F.col("least") + 1).otherwise(F.col("most")))
    scaled = F.transform("pixels", lambda v: (F.least(F.greatest(v, F.col("least")), F.col("most")) - F.col("least")) / (F.col("most") - F.col("least")) * 255)
    return tiles.join(bounds, "recording_id").withColumn("pixels", scaled).select(*KEY, "height", "width", "pixels")


def halos(tiles: DataFrame, size: int, radius: int) -> DataFrame:
    """(key, height, width, pieces): for each tile the parts (y, x, h, w, pixels) of tiles within ``radius`` of it, its own among them."""
    reach = range(-math.ceil(radius / size), math.ceil(radius / size) + 1)
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in reach for dx in reach])).alias("step")
    sent = tiles.select("*", steps).withColumns({"to_y": F.col("ty") + F.col("step.dy"), "to_x": F.col("tx") + F.col("step.dx")})
    sent = sent.where((F.col("to_y") >= 0) & (F.col("to_x") >= 0) & (F.col("to_y") * size < F.col("height")) & (F.col("to_x") * size < F.col("width")))

    def span(n: str, own: str, to: str):
        """The first and the end of a tile's rows (or columns) that another one needs, from the frame's edge."""
        begin, end = F.col(own) * size, F.least((F.col(own) + 1) * size, F.col(n))
        return F.greatest(begin, F.col(to) * size - radius), F.least(end, (F.col(to) + 1) * size + radius)

    (y0, y1), (x0, x1) = span("height", "ty", "to_y"), span("width", "tx", "to_x")
    wide = F.least(F.lit(size), F.col("width") - F.col("tx") * size)
    row = lambda y: F.slice("pixels", (y - F.col("ty") * size) * wide + x0 - F.col("tx") * size + 1, x1 - x0)
    piece = F.struct(y0.alias("y"), x0.alias("x"), (y1 - y0).alias("h"), (x1 - x0).alias("w"), F.flatten(F.transform(F.sequence(y0, y1 - 1), row)).alias("pixels"))
    # in one select the new ty and tx would be taken for the old ones inside of the transform
    parts = sent.where((y0 < y1) & (x0 < x1)).select("recording_id", "t", "to_y", "to_x", "height", "width", piece.alias("piece")).withColumnsRenamed({"to_y": "ty", "to_x": "tx"})
    return parts.groupBy(*KEY, "height", "width").agg(F.collect_list("piece").alias("pieces"))


def blur(tiles: DataFrame, size: int, sigma: float) -> DataFrame:
    """Each frame blurred by a separable Gaussian out to four sigma, mirrored at the frame's edges."""
    weights = gaussian_weights(sigma)
    radius = len(weights) // 2

    def along(a: np.ndarray) -> np.ndarray:
        n = len(a) - 2 * radius
        return sum(w * a[k : k + n] for k, w in enumerate(weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ty, tx, height, width, pieces in zip(*(pdf[c] for c in ("ty", "tx", "height", "width", "pieces")), strict=True):
                (a, b), (c, d) = ((k * size - radius, min((k + 1) * size, n) + radius) for k, n in ((ty, height), (tx, width)))
                top, left = max(a, 0), max(c, 0)
                patch = np.empty((min(b, height) - top, min(d, width) - left))
                for p in pieces:
                    patch[p["y"] - top :, p["x"] - left :][: p["h"], : p["w"]] = np.asarray(p["pixels"], float).reshape(p["h"], p["w"])
                patch = np.pad(patch, ((top - a, b - min(b, height)), (left - c, d - min(d, width))), "symmetric")
                out.append(along(along(patch).T).T.ravel())
            yield pdf.drop(columns="pieces").assign(pixels=out)

    return halos(tiles, size, radius).mapInPandas(run, TILES)


def binned(tiles: DataFrame, size: int, block: int) -> DataFrame:
    """(recording_id, t, y, x, width, v): means of ``block`` x ``block`` pixels, filled up with zeros over the edge; width is that of the binned frame."""
    if size % block:
        raise ValueError(f"tiles of {size} pixels don't hold whole blocks of {block}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ty, tx, height, width, pixels in zip(*(pdf[c] for c in ("ty", "tx", "height", "width", "pixels")), strict=True):
                h, w = min(size, height - ty * size), min(size, width - tx * size)
                rows, columns = -(-h // block), -(-w // block)
                full = np.zeros((rows * block, columns * block))
                full[:h, :w] = np.asarray(pixels, float).reshape(h, w)
                out.append((full.reshape(rows, block, columns, block).sum((1, 3)) / (block * block)).ravel())
            yield pdf.assign(pixels=out)

    means = tiles.mapInPandas(run, TILES)
    columns = F.ceil(F.least(F.lit(size), F.col("width") - F.col("tx") * size) / block).cast("int")
    each = means.select(*KEY, F.ceil(F.col("width") / block).cast("int").alias("width"), columns.alias("columns"), F.posexplode("pixels").alias("i", "v"))
    y, x = (F.col(t) * (size // block) + f for t, f in (("ty", F.floor(F.col("i") / F.col("columns")).cast("int")), ("tx", F.col("i") % F.col("columns"))))
    return each.select("recording_id", "t", y.alias("y"), x.alias("x"), "width", "v")
