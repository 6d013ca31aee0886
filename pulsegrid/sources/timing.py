"""Frame rates from what files say about themselves, by precedence; and the sidecar that keeps a stated rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def info_times(info: Column) -> Column:
    """Frame times in milliseconds from numbered value and unit lines, in order of their numbers."""
    keys = lambda what: F.regexp_extract_all(info, F.lit(rf"(?m)^\s*{what} #(\d+)\s*=\s*(.+?)\s*$"), F.lit(1))
    values = lambda what: F.regexp_extract_all(info, F.lit(rf"(?m)^\s*{what} #(\d+)\s*=\s*(.+?)\s*$"), F.lit(2))
    units = F.map_from_arrays(keys("Units"), values("Units"))
    entries = F.arrays_zip(keys("Value").alias("k"), values("Value").alias("v"))
    timed = F.filter(entries, lambda e: F.coalesce(F.contains(F.element_at(units, e["k"]), F.lit("10^-3s^1")), F.lit(False)))
    return F.transform(F.array_sort(F.transform(timed, lambda e: F.struct(e["k"].cast("int").alias("n"), e["v"].cast("double").alias("v")))), lambda e: e["v"])


def timing(metadata: DataFrame) -> DataFrame:
    """``metadata`` with fps, n_frames, fps_source and timestamps (seconds); the first hit of the chain wins.

    Columns, any of them null: path, sidecar (JSON text), ets_frames, series_frames, finterval, fps_tag, software, ome (XML), summary (JSON text), info.
    """
    path = F.lower("path")
    tiff, vsi = path.rlike(r"\.tiff?$"), path.endswith(".vsi")
    sidecar = F.get_json_object("sidecar", "$.fps").cast("double")
    interval = F.col("finterval").cast("double")
    ours = (interval == 1.0) & F.contains(F.lower(F.coalesce("software", F.lit(""))), F.lit("tifffile"))
    attribute = lambda name: F.nullif(F.expr(f"xpath_string(ome, \"//*[local-name()='Pixels']/@{name}\")"), F.lit(""))
    step, unit = attribute("TimeIncrement").cast("double"), F.coalesce(attribute("TimeIncrementUnit"), F.lit("s"))
    seconds = step * F.when(F.lower(unit).isin("ms", "millisecond", "milliseconds"), 1e-3).when(F.lower(unit).isin("min", "minutes"), 60.0).otherwise(1.0)
    summary = F.get_json_object("summary", "$.Interval_ms").cast("double")
    times = info_times(F.col("info"))
    gap = (F.element_at(times, -1) - F.get(times, 0)) / (F.size(times) - 1)
    chain = [
        ("sidecar", sidecar > 0, sidecar),
        ("finterval", tiff & (interval > 0) & ~ours, F.bround(1 / interval, 4)),
        ("fps", tiff & (F.col("fps_tag") > 0), F.bround("fps_tag", 4)),
        ("ome", tiff & (seconds > 0), F.bround(1 / seconds, 4)),
        ("summary", tiff & (summary > 0), F.bround(1000 / summary, 4)),
        ("info", tiff & (F.size(times) >= 2) & (gap > 0), F.bround(1000 / gap, 4)),
    ]
    found = metadata
    fps = source = None
    for name, holds, value in chain:
        holds = F.coalesce(holds, F.lit(False))
        fps = F.when(holds, value) if fps is None else fps.when(holds, value)
        source = F.when(holds, name) if source is None else source.when(holds, name)
    found = found.withColumns({"fps": fps, "fps_source": source, "n_frames": F.when(vsi, F.col("ets_frames")).when(tiff, F.col("series_frames"))})
    return found.withColumn("timestamps", F.when(F.col("fps_source") == "info", F.transform(times, lambda t: t / 1000)))


def batch_rate(finterval: Column, use_fps: Column, value: Column) -> tuple[Column, Column]:
    """(use_fps, value) of a batch: a stated interval makes it a rate."""
    stated = F.coalesce(finterval > 0, F.lit(False))
    return stated | use_fps, F.when(stated, 1 / finterval).otherwise(value)


def sidecars(recordings: DataFrame) -> DataFrame:
    """(path, content): the JSON sidecar ``<stem>.fps`` of each recording (path, fps)."""
    base = F.element_at(F.split("path", "/"), -1)
    return recordings.select(F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit(".fps")).alias("path"), F.to_json(F.struct("fps", base.alias("path"))).alias("content"))
