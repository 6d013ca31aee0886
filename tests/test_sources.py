"""Files, timing and streams."""

import json
import struct

import numpy as np
import pytest

from pulsegrid.sources import stacks, timing
from pulsegrid.streaming import arrivals


def ets(frames, order, kind):
    t, h, w = frames.shape
    body, entries = b"", []
    for k in order:
        raw = frames[k].astype(kind).tobytes()
        at = 128 + len(body)
        entries.append(struct.pack("<11I", 0, 0, 0, k, 0, 0, 0, at & 0xFFFFFFFF, at >> 32, len(raw), 0))
        body += raw
    head = bytearray(128)
    head[:3] = b"SIS"
    struct.pack_into("<QQ", head, 32, 128 + len(body), t)
    struct.pack_into("<I", head, 92, w)
    struct.pack_into("<I", head, 96, h)
    return bytes(head) + body + b"".join(entries)


@pytest.mark.parametrize("kind", ["u1", "<u2"])
def test_ets_frames_in_order(kind):
    frames = np.arange(24).reshape(4, 2, 3)
    assert (stacks.decode_ets(ets(frames, [2, 0, 3, 1], kind)) == frames).all()
    assert stacks.ets_frame_count(ets(frames, [0, 1, 2, 3], kind)) == 4


def test_ets_errors():
    with pytest.raises(ValueError):
        stacks.decode_ets(b"XYZ" + bytes(200))
    with pytest.raises(ValueError):
        stacks.decode_ets(ets(np.zeros((0, 2, 2)), [], "u1"))


@pytest.mark.parametrize("dtype", ["u1", "u2", "f4"])
def test_tiff_round_trip(dtype):
    stack = np.arange(30).reshape(5, 2, 3).astype(dtype)
    assert (stacks.decode_tiff(stacks.encode_tiff(stack)) == stack).all()
    assert stacks.decode_tiff(stacks.encode_tiff(stack[:1])).shape == (2, 3)


def test_ranks():
    assert stacks.as_stack(np.zeros((3, 4))).shape == (1, 3, 4)
    assert stacks.as_stack(np.zeros((5, 3, 4))).shape == (5, 3, 4)
    assert stacks.as_stack(np.zeros((5, 2, 3, 4)), "TCYX").shape == (5, 3, 4)
    assert stacks.as_stack(np.zeros((2, 5, 3, 4)), "ZTYX").shape == (5, 3, 4)
    assert stacks.as_stack(np.zeros((9, 2, 8, 8))).shape == (9, 8, 8)
    assert stacks.as_stack(np.zeros((9, 7, 8, 8))).shape == (7, 8, 8)
    with pytest.raises(ValueError):
        stacks.as_stack(np.zeros(3))


def test_read_convert_and_choose(spark, tmp_path):
    frames = np.arange(24).reshape(4, 2, 3)
    (tmp_path / "a.tif").write_bytes(stacks.encode_tiff(frames.astype("u2")))
    (tmp_path / "bad.tif").write_bytes(b"nothing")
    folder = tmp_path / "_cell_" / "stack1"
    folder.mkdir(parents=True)
    (folder / "frame.ets").write_bytes(ets(frames, [3, 2, 1, 0], "u1"))
    (folder / "small.ETS").write_bytes(b"SIS")
    chosen = stacks.companions(spark, str(tmp_path)).collect()
    assert [r["recording_id"] for r in chosen] == ["cell"] and chosen[0]["path"].endswith("frame.ets")
    read = stacks.read_stacks(spark, [str(tmp_path / "a.tif"), str(folder / "frame.ets"), str(tmp_path / "bad.tif")], strict=False)
    rows = read.orderBy("recording_id", "t").collect()
    assert [r["recording_id"] for r in rows] == ["a"] * 4 + ["bad"] + ["cell"] * 4 and rows[4]["error"]
    assert rows[3]["pixels"] == rows[-1]["pixels"] == frames[3].ravel().tolist()
    pixel = stacks.frame_pixels(read).where("recording_id = 'a' AND t = 2 AND y = 1 AND x = 2").first()
    assert pixel["v"] == frames[2, 1, 2]
    done = {r["recording_id"]: r for r in stacks.converted(read).collect()}
    assert not done["bad"]["ok"] and (stacks.decode_tiff(bytes(done["cell"]["content"])) == frames).all()


INFO = "\n".join([*[f" Value #{i} = {v}" for i, v in ((2, 80), (1, 0), (3, 160), (4, 7))], *[f" Units #{i} = {u}" for i, u in ((1, "10^-3s^1"), (2, "10^-3s^1"), (3, "10^-3s^1"), (4, "m"))]])
OME = '<OME xmlns="http://x"><Image><Pixels TimeIncrement="50" TimeIncrementUnit="ms"/></Image></OME>'


@pytest.mark.parametrize(
    ("row", "fps", "source"),
    [
        ({"sidecar": json.dumps({"fps": 12.34567})}, 12.34567, "sidecar"),
        ({"sidecar": "broken", "finterval": 0.3}, 3.3333, "finterval"),
        ({"finterval": 1.0, "software": "tifffile.py", "fps_tag": 25.0}, 25.0, "fps"),
        ({"finterval": 1.0}, 1.0, "finterval"),
        ({"ome": OME}, 20.0, "ome"),
        ({"summary": json.dumps({"Interval_ms": 40})}, 25.0, "summary"),
        ({"info": INFO}, 12.5, "info"),
        ({"path": "/x/a.vsi", "ets_frames": 9, "finterval": 0.5}, None, None),
        ({"path": "/x/a.png", "finterval": 0.5}, None, None),
        ({}, None, None),
    ],
)
def test_timing_chain(spark, row, fps, source):
    schema = "path string, sidecar string, ets_frames int, series_frames int, finterval double, fps_tag double, software string, ome string, summary string, info string"
    names = [c.split()[0] for c in schema.split(", ")]
    got = timing.timing(spark.createDataFrame([tuple(({"path": "/x/a.TIF", "series_frames": 5} | row).get(n) for n in names)], schema)).first()
    assert (got["fps"], got["fps_source"]) == (fps, source)
    assert got["n_frames"] == (9 if "ets_frames" in row else None if row.get("path", "").endswith("png") else 5)
    assert got["timestamps"] == ([0.0, 0.08, 0.16] if source == "info" else None)


def test_sidecar_of_a_recording(spark):
    row = timing.sidecars(spark.createDataFrame([("/x/a.b.tif", 7.5)], "path string, fps double")).first()
    assert row["path"] == "/x/a.b.fps" and json.loads(row["content"]) == {"fps": 7.5, "path": "a.b.tif"}


def test_stream_tells_closed_windows_once(spark, tmp_path):
    events = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_dt_interval(0, id * 6) AS ts, CAST(id % 2 AS BIGINT) AS user_id, CAST(id AS DOUBLE) AS value FROM range(40)")
    source, seen = str(tmp_path / "in"), []
    events.where("value < 20").write.parquet(source)
    cells = arrivals.cells(arrivals.event_stream(spark, source, events.schema))
    handle = lambda df, _: seen.extend(df.collect())
    arrivals.each_batch(cells, handle, str(tmp_path / "state")).awaitTermination(60)
    first = len(seen)
    events.where("value >= 20").write.mode("append").parquet(source)
    arrivals.each_batch(cells, handle, str(tmp_path / "state")).awaitTermination(60)
    keys = [(r["pixel_id"], r["start"]) for r in seen]
    assert 0 < first < len(seen) and len(keys) == len(set(keys))
    assert all(r["n"] == 1 for r in seen)


def test_stream_beats_equal_batch_beats_and_late_rows_are_dropped(spark, tmp_path):
    from pulsegrid.streaming import beats

    origin, hour = "2024-01-01 00:00:00", 3600
    made = spark.sql(f"SELECT timestamp'{origin}' + make_dt_interval(0, CAST(id AS INT)) AS ts, u AS user_id, CAST(xxhash64(id, u) % 100 AS DOUBLE) AS value, id AS h FROM range(80) LATERAL VIEW explode(array(1L, 2L)) AS u WHERE id % 9 <> 4")
    source, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    late = spark.sql(f"SELECT timestamp'{origin}' + make_dt_interval(0, 10) AS ts, 1L AS user_id, 1e9 AS value")

    def go():
        stream = beats.beats(arrivals.event_stream(spark, source, late.schema), origin, hour, "2 hours")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(map(tuple, spark.read.parquet(out).collect()))

    made.where("h < 40").drop("h").write.parquet(source)
    first = go()
    assert first == sorted(map(tuple, beats.batch_beats(made.where("h < 40"), origin, hour, 36).collect())) and first
    made.where("h >= 40").drop("h").unionByName(late).coalesce(1).write.mode("append").parquet(source)
    assert go() == sorted(map(tuple, beats.batch_beats(made, origin, hour, 76).collect()))


def test_a_stream_works_once_a_pixel_and_not_once_a_frame(spark):
    from pulsegrid.streaming import beats

    # frames that close together go in one step, and a long gap is not walked through
    assert beats.known_beats([], -1, [(3, 1.0), (10**9, 2.0), (10**9 + 4, 0.5)], 3, 0.0)[0] == [(3, 1.0), (10**9, 2.0)]
    one = beats.known_beats([], -1, [(t, float(t * 7 % 11)) for t in range(40)], 3, 0.0)
    held, last, found = [], -1, []
    for t in range(40):
        more, held = beats.known_beats(held, last, [(t, float(t * 7 % 11))], 3, 0.0)
        last, found = t, found + more
    assert (found, held) == one and found


def test_listing_reads_no_contents(spark, tmp_path):
    for name, size in (("_a_/stack1/frame.ets", 10), ("_a_/stack2/frame.ETS", 20), ("_b_/x.ets", 5), ("_b_/y.tif", 50), ("plain/z.ets", 99)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    found = stacks.companions(spark, str(tmp_path))
    assert sorted((r["recording_id"], r["path"].rpartition("/")[2], r["length"]) for r in found.collect()) == [("a", "frame.ETS", 20), ("b", "x.ets", 5)]
    assert "content:binary" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_second_write_changes_nothing_and_other_partitions_stay(spark, tmp_path):
    from pulsegrid.sources import sinks

    path, schema = str(tmp_path / "t"), "v int, name string"
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(["007", "a b", "x/y", "007", "z"])], schema)
    read = lambda: sorted(map(tuple, sinks.read(spark, path, schema).select("v", "name").collect()))
    sinks.overwrite(rows, path, "name")
    want = sorted(map(tuple, rows.collect()))
    assert read() == want
    sinks.overwrite(rows.where("name = '007'"), path, "name")
    assert read() == want
    sinks.overwrite(rows.where("name = 'z'").withColumn("v", rows["v"] + 100), path, "name")
    assert read() == sorted([(104, "z"), *(r for r in want if r[1] != "z")])


def test_sidecars_come_back(spark, tmp_path):
    from pulsegrid.sources import sinks

    made = timing.sidecars(spark.createDataFrame([("/x/a.tif", 7.5), ("/y/b.tif", 2.0)], "path string, fps double"))
    for _ in range(2):
        sinks.save_sidecars(made, str(tmp_path / "s"))
    assert sorted(map(tuple, sinks.load_sidecars(spark, str(tmp_path / "s")).collect())) == sorted(map(tuple, made.collect()))
