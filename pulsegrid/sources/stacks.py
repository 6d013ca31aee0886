"""Image stacks from files: frame files with a tile directory (ETS) and plain TIFF, decoded on the executors.

``binaryFile`` lists and reads the files, so any store that Spark reads will do; listings prune the contents. A file that can't be
decoded gives one row with its error instead of frames, unless ``strict``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = "recording_id string, t int, height int, width int, pixels array<double>, error string"

# Fixed values of the ETS layout: offsets of the header's fields, and the fields of a 44-byte directory entry.
ETS_MAGIC = b"SIS"
ETS_DIRECTORY, ETS_COUNT, ETS_WIDTH, ETS_HEIGHT = 32, 40, 92, 96
ETS_ENTRY, ENTRY_T, ENTRY_LOW, ENTRY_HIGH, ENTRY_SIZE = 44, 3, 7, 8, 9


def decode_ets(data: bytes) -> np.ndarray:
    """(T, H, W) in order of the frame index; one tile for each frame."""
    if data[:3] != ETS_MAGIC:
        raise ValueError("not an ETS file")
    at, count = struct.unpack_from("<Q", data, ETS_DIRECTORY)[0], struct.unpack_from("<Q", data, ETS_COUNT)[0]
    width, height = struct.unpack_from("<I", data, ETS_WIDTH)[0], struct.unpack_from("<I", data, ETS_HEIGHT)[0]
    entries = [struct.unpack_from("<11I", data, at + k * ETS_ENTRY) for k in range(count)]
    if not entries:
        raise ValueError("the ETS directory is empty")
    kind = np.dtype("<u2") if entries[0][ENTRY_SIZE] == 2 * width * height else np.dtype("u1")
    frames = []
    for e in sorted(entries, key=lambda e: e[ENTRY_T]):
        if e[ENTRY_SIZE] != width * height * kind.itemsize:
            raise ValueError("a frame of several tiles")
        frames.append(np.frombuffer(data, kind, width * height, e[ENTRY_LOW] | e[ENTRY_HIGH] << 32).reshape(height, width))
    return np.stack(frames)


def ets_frame_count(data: bytes) -> int:
    return struct.unpack_from("<Q", data, ETS_COUNT)[0]


# Fixed values of TIFF: tags that matter here, and the types of values by their code.
TIFF_TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 270: "description", 273: "offsets", 277: "samples", 278: "rows", 279: "counts", 305: "software", 339: "format"}
TIFF_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q"}


def tiff_pages(data: bytes) -> list[dict]:
    """The tags of each page; classic and big files, either byte order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    big = struct.unpack_from(order + "H", data, 2)[0] == 43
    word, n_code, entry, head = ("Q", "Q", 20, 8) if big else ("I", "H", 12, 4)
    at, out = struct.unpack_from(order + word, data, 8 if big else 4)[0], []
    while at:
        n = struct.unpack_from(order + n_code, data, at)[0]
        at += struct.calcsize(n_code)
        page = {"order": order}
        for k in range(n):
            p = at + k * entry
            tag, kind = struct.unpack_from(order + "HH", data, p)
            (count,) = struct.unpack_from(order + word, data, p + 4)
            if tag in TIFF_TAGS and kind in TIFF_TYPES:
                code, p = TIFF_TYPES[kind], p + 4 + head
                fmt = f"{order}{count}s" if code == "s" else order + code * count
                if struct.calcsize(fmt) > head:
                    (p,) = struct.unpack_from(order + word, data, p)
                value = struct.unpack_from(fmt, data, p)
                page[TIFF_TAGS[tag]] = value[0].rstrip(b"\0").decode("utf-8", "replace") if code == "s" else value
        out.append(page)
        at = struct.unpack_from(order + word, data, at + n * entry)[0]
    return out


def decode_tiff(data: bytes) -> np.ndarray:
    """Pages of an uncompressed grey TIFF: (Y, X) for one, else (T, Y, X)."""
    frames = []
    for page in tiff_pages(data):
        if page.get("compression", (1,))[0] != 1 or page.get("samples", (1,))[0] != 1:
            raise ValueError("only uncompressed grey TIFF is read")
        kind = {1: "u", 2: "i", 3: "f"}[page.get("format", (1,))[0]]
        dtype = np.dtype(f"{page['order']}{kind}{page.get('bits', (8,))[0] // 8}")
        raw = b"".join(data[a : a + n] for a, n in zip(page["offsets"], page["counts"], strict=True))
        frames.append(np.frombuffer(raw, dtype).reshape(page["height"][0], page["width"][0]))
    stack = np.stack(frames)
    return stack[0] if len(stack) == 1 else stack


def encode_tiff(stack: np.ndarray) -> bytes:
    """A plain little-endian TIFF of a (T, Y, X) stack, a page for each frame."""
    stack = np.ascontiguousarray(stack)
    kind, out, link = {"u": 1, "i": 2, "f": 3}[stack.dtype.kind], bytearray(b"II*\0\0\0\0\0"), 4
    for frame in stack.astype(stack.dtype.newbyteorder("<")):
        start = len(out)
        out += frame.tobytes()
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        tags = [(256, frame.shape[1]), (257, frame.shape[0]), (258, stack.dtype.itemsize * 8), (259, 1), (262, 1), (273, start), (277, 1), (278, frame.shape[0]), (279, frame.nbytes), (339, kind)]
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def as_stack(image: np.ndarray, axes: str = "") -> np.ndarray:
    """(T, Y, X) of an image of two to four dimensions.

    Two get a T of one; three are taken as they are; of four one is dropped by its first element: C if it is labelled, Z beside T, the
    axis that is none of T, Y, X, the smallest of at most four long, or else the first.
    """
    if image.ndim == 2:
        return image[None]
    if image.ndim == 3:
        return image
    if image.ndim != 4:
        raise ValueError(f"an image of {image.ndim} dimensions")
    axes = axes.upper() if len(axes) == 4 else ""
    others = [a for a in axes if a not in "TYX"]
    if "C" in axes:
        drop = axes.index("C")
    elif "T" in axes and "Z" in axes:
        drop = axes.index("Z")
    elif others:
        drop = axes.index(others[0])
    else:
        small = int(np.argmin(image.shape))
        drop = small if image.shape[small] <= 4 else 0
    return np.take(image, 0, drop)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of all files in the ``_<stem>_`` folders of ``folder``, from the store's listing: contents aren't read.

    The pattern is part of the path, as Spark's readers pass over folders whose names begin with an underscore unless they are named.
    """
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/_*_").select("path", "length")


def largest(files: DataFrame) -> DataFrame:
    """(recording_id, path, length): of the frame files (path, length) in each ``_<stem>_`` folder the largest, of equals the first path."""
    found = files.where(F.lower("path").endswith(".ets")).withColumn("recording_id", F.regexp_extract("path", r"/_([^/]*)_/", 1)).where("recording_id <> ''")
    best = F.min(F.struct((-F.col("length")).alias("minus"), "path")).alias("best")
    return found.groupBy("recording_id").agg(best).select("recording_id", F.col("best.path").alias("path"), (-F.col("best.minus")).alias("length"))


def companions(spark: SparkSession, folder: str) -> DataFrame:
    """(recording_id, path, length): the frame file of each recording in ``folder``."""
    return largest(listing(spark, folder))


def read_stacks(spark: SparkSession, paths: str | list[str], strict: bool = True) -> DataFrame:
    """Frames (recording_id, t, height, width, pixels, error) of TIFF and ETS files.

    A recording is named by its file, an ETS file by the ``_<stem>_`` folder it lies in. A frame is one row; a file is decoded by one task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    named = F.coalesce(F.nullif(F.regexp_extract("path", r"/_([^/]*)_/", 1), F.lit("")), stem(F.col("path")))
    chosen = files.where(F.lower("path").rlike(r"\.(tiff?|ets)$")).select(named.alias("recording_id"), "path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, path, content in zip(pdf["recording_id"], pdf["path"], pdf["content"], strict=True):
                try:
                    stack = decode_ets(content) if path.lower().endswith(".ets") else as_stack(decode_tiff(content))
                except Exception as e:
                    if strict:
                        raise
                    yield pd.DataFrame({"recording_id": [name], "t": [None], "height": [None], "width": [None], "pixels": [None], "error": [str(e)]})
                    continue
                for a in range(0, len(stack), 16):
                    part = stack[a : a + 16]
                    yield pd.DataFrame({"recording_id": name, "t": range(a, a + len(part)), "height": part.shape[1], "width": part.shape[2], "pixels": [f.ravel().astype(float) for f in part], "error": None})

    return chosen.mapInPandas(run, FRAMES)


def frame_pixels(frames: DataFrame) -> DataFrame:
    """(recording_id, t, y, x, v): a row for each pixel of each frame."""
    long = frames.where("error IS NULL").select("recording_id", "t", "width", F.posexplode("pixels").alias("i", "v"))
    return long.select("recording_id", "t", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).alias("x"), "v")


def converted(frames: DataFrame) -> DataFrame:
    """(recording_id, ok, message, content): a TIFF of each recording, written by whoever has the table; errors become messages."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["recording_id"].iloc[0]
        bad = pdf["error"].dropna()
        try:
            if len(bad):
                raise ValueError(bad.iloc[0])
            pdf = pdf.sort_values("t")
            stack = np.stack([np.asarray(p).reshape(h, w) for p, h, w in zip(pdf["pixels"], pdf["height"].astype(int), pdf["width"].astype(int), strict=True)])
            kind = np.uint8 if stack.max() < 256 else np.uint16
            return pd.DataFrame({"recording_id": [name], "ok": [True], "message": [f"{name}.tif"], "content": [encode_tiff(stack.astype(kind))]})
        except Exception as e:
            return pd.DataFrame({"recording_id": [name], "ok": [False], "message": [str(e)], "content": [None]})

    return frames.groupBy("recording_id").applyInPandas(run, "recording_id string, ok boolean, message string, content binary")
