"""Beats of pixels as their events arrive: open frames and the last closed ones are state, the watermark closes frames.

A frame is a span of event time; its value is the mean of its events. A frame closes when the watermark passes its end, so late events within
the watermark's delay still count, and later ones are dropped. A closed frame is a beat once ``apart`` frames on either side are known: none
before is higher, none after is as high, and it stands ``rise`` above the least of those before. Frames without events are 0. The state of a
pixel is its open frames and 2 * apart + 1 closed ones, whatever the stream's length.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BEATS = "pixel_id int, t int, v double"


def numbered(events: DataFrame, origin: str, seconds: int) -> DataFrame:
    """(pixel_id, at, t, value) of events (ts, user_id, value): the frame that holds each."""
    at = F.col("ts").cast("timestamp")
    t = F.floor((F.unix_micros(at) - F.unix_micros(F.lit(origin).cast("timestamp"))) / (seconds * 1_000_000)).cast("int")
    return events.select(F.col("user_id").cast("int").alias("pixel_id"), at.alias("at"), t.alias("t"), F.col("value").cast("double").alias("value"))


def known_beats(held: list, last: int, frames: list, apart: int, rise: float) -> tuple[list, list]:
    """The beats (t, v) that are known once ``frames`` (t, v) in order are, ``held`` being the frames up to ``last``; and what is held then."""
    found, whole = [], 2 * apart + 1
    for t, value in frames:
        k = last
        while k < t:
            # inside a long gap the frames held are all empty, and none is a beat
            k = k + 1 if k < last + whole else t
            held = [*held, value if k == t else 0.0][-whole:]
            if len(held) == whole:
                middle, before, after = held[apart], held[:apart], held[apart + 1 :]
                if middle >= max(before) and middle > max(after) and middle - min(before) >= rise:
                    found.append((k - apart, middle))
        last = max(last, t)
    return found, held


class Beats(StatefulProcessor):
    """The state of one pixel: the last closed frames."""

    def __init__(self, apart: int, rise: float):
        self.apart, self.rise = apart, rise

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.closed = handle.getValueState("closed", "last int, v array<double>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        frames = sorted((r["t"], r["v"]) for r in rows)
        last, held = self.closed.get() or (-1, [])
        found, held = known_beats(list(held), last, frames, self.apart, self.rise)
        self.closed.update((frames[-1][0], held))
        return iter([Row(pixel_id=key[0], t=t, v=v) for t, v in found])


def beats(events: DataFrame, origin: str, seconds: int, late: str, apart: int = 3, rise: float = 0.0) -> DataFrame:
    """(pixel_id, t, v) of a stream of events (ts, user_id, value); needs the RocksDB state store.

    Open frames are a windowed aggregate, which tells a frame when the watermark passes its end; a pixel's function then runs once a batch over
    the frames that closed.
    """
    session = events.sparkSession
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start = session.sql(f"SELECT unix_micros(timestamp'{origin}') AS us").first()["us"]
    timed = numbered(events, origin, seconds).where("t >= 0").withWatermark("at", late)
    frame = F.window("at", f"{seconds} seconds", startTime=f"{start % (seconds * 1_000_000)} microseconds")
    means = timed.groupBy(frame.alias("frame"), "pixel_id").agg(F.avg("value").alias("v"))
    t = ((F.unix_micros("frame.start") - start) / (seconds * 1_000_000)).cast("int")
    return means.select("pixel_id", t.alias("t"), "v").groupBy("pixel_id").transformWithState(Beats(apart, rise), BEATS, "append", "none")


def batch_beats(events: DataFrame, origin: str, seconds: int, until: int, apart: int = 3, rise: float = 0.0) -> DataFrame:
    """The same beats of a table of events, of frames up to ``until``: what a stream that saw everything in time has told by then."""
    cells = numbered(events, origin, seconds).where(F.col("t") <= until).groupBy("pixel_id", "t").agg(F.avg("value").alias("v"))
    ends = cells.groupBy("pixel_id").agg(F.max("t").alias("last"))
    every = ends.select("pixel_id", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("t")).join(cells, ["pixel_id", "t"], "left").na.fill(0.0, ["v"])
    frames = Window.partitionBy("pixel_id").orderBy("t")
    before, after = frames.rowsBetween(-apart, -1), frames.rowsBetween(1, apart)
    told = every.select(
        "pixel_id", "t", "v", F.max("v").over(before).alias("b"), F.min("v").over(before).alias("low"), F.max("v").over(after).alias("a"),
        F.count("v").over(before).alias("nb"), F.count("v").over(after).alias("na"),
    )
    return told.where((F.col("nb") == apart) & (F.col("na") == apart) & (F.col("v") >= F.col("b")) & (F.col("v") > F.col("a")) & (F.col("v") - F.col("low") >= rise)).select("pixel_id", "t", "v")
