"""Band-pass by a fourth-order Butterworth filter run forwards and backwards, as second-order sections.

A section is a linear recurrence, run as a scan: blocks of frames are filtered side by side as if each began at rest, the state that each
block begins in follows from the one before by a power of the transition matrix, and what that state adds is laid on top. A signal of n
frames takes about 2 sqrt(n) steps of numpy instead of n, for all signals of a batch together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .scalar import PIXEL

STACK = 1024  # signals filtered side by side, which bounds a task's memory


def design(low: float, high: float, order: int = 4) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a digital band-pass; ``low`` and ``high`` are shares of the Nyquist rate."""
    w1, w2 = np.tan(np.pi * np.array([low, high]) / 2)
    width, centre2 = w2 - w1, w1 * w2
    analog = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))  # poles of the low-pass
    half = analog * width / 2
    root = np.sqrt(half**2 - centre2 + 0j)
    poles = np.concatenate([half + root, half - root])
    digital = (1 + poles) / (1 - poles)
    upper = digital[digital.imag > 1e-14]
    upper = upper[np.argsort(-np.abs(upper))][::-1]
    real = np.sort(digital[np.abs(digital.imag) <= 1e-14].real)
    pairs = [(p, p.conjugate()) for p in upper] + list(zip(real[::2], real[1::2], strict=True))
    sections = np.array([[1, 0, -1, 1, -(a + b).real, (a * b).real] for a, b in pairs])
    # unit gain in the middle of the band
    middle = np.exp(1j * 2 * np.arctan(np.sqrt(centre2)))
    z = np.array([1, middle**-1, middle**-2])
    gain = np.prod([(s[:3] @ z) / (s[3:] @ z) for s in sections])
    sections[0, :3] /= np.abs(gain)
    return sections


def _settled(sections: np.ndarray) -> list[np.ndarray]:
    """States of the sections after a long run of ones."""
    out, scale = [], 1.0
    for b0, b1, b2, _, a1, a2 in sections:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        z2 = b2 - a2 * gain
        out.append(scale * np.array([b1 - a1 * gain + z2, z2]))
        scale *= gain
    return out


def recurrence(section: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """One section over the rows of ``x``; ``state`` has a row's two states before its first frame."""
    b0, b1, b2, _, a1, a2 = section
    rows, n = x.shape
    size = max(int(np.ceil(np.sqrt(n))), 1)
    count = -(-n // size)
    blocks = np.zeros((rows, count * size))
    blocks[:, :n] = x
    blocks = blocks.reshape(rows, count, size)
    z1 = z2 = np.zeros((rows, count))
    y = np.empty_like(blocks)
    for i in range(size):
        v = blocks[:, :, i]
        y[:, :, i] = o = b0 * v + z1
        z1, z2 = b1 * v - a1 * o + z2, b2 * v - a2 * o
    step = np.array([[-a1, 1.0], [-a2, 0.0]])
    whole = np.linalg.matrix_power(step, size)
    begin = np.empty((rows, count, 2))
    for k in range(count):
        begin[:, k] = state
        state = state @ whole.T + np.stack([z1[:, k], z2[:, k]], 1)
    # what a state adds to the frames of its block: the first row of each power of the step
    adds, row = np.empty((size, 2)), np.array([1.0, 0.0])
    for i in range(size):
        adds[i] = row
        row = row @ step
    return (y + begin @ adds.T).reshape(rows, -1)[:, :n]


def _run(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    first = x[:, :1]
    for section, z in zip(sections, _settled(sections), strict=True):
        x = recurrence(section, x, first * z)
    return x


def zero_phase(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filter the rows of ``x`` forwards and backwards, with ends mirrored about their last values; too short signals stay as they are."""
    pad = 3 * (2 * len(sections) + 1)
    if x.shape[1] <= pad:
        return x
    before, after = 2 * x[:, :1] - x[:, pad:0:-1], 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]
    y = _run(sections, np.concatenate([before, x, after], 1))
    return _run(sections, y[:, ::-1])[:, ::-1][:, pad:-pad]


def band(fps: float, low: float = 0.3, high: float = 5.0) -> tuple[float, float] | None:
    """The band as shares of the Nyquist rate, or None where there is none."""
    nyquist = fps / 2
    top = min(high, 0.9 * nyquist)
    return (low / nyquist, top / nyquist) if low < top and nyquist > low else None


def bandpass(packed: DataFrame, fps: float) -> DataFrame:
    """Packed signals filtered; a signal with a value that isn't finite stays as it is."""
    edges = band(fps)
    if edges is None:
        return packed.select(*PIXEL, "v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sections = design(*edges)
        for pdf in batches:
            out = [np.asarray(v, float) for v in pdf["v"]]
            for n in {len(v) for v in out}:
                rows = [i for i, v in enumerate(out) if len(v) == n and np.isfinite(v).all()]
                for begin in range(0, len(rows) if n else 0, STACK):
                    some = rows[begin : begin + STACK]
                    for i, y in zip(some, zero_phase(sections, np.stack([out[i] for i in some])), strict=True):
                        out[i] = y.copy()  # without the mirrored ends, which a view would keep
            yield pdf.assign(v=out)

    return packed.select(*PIXEL, "v").mapInPandas(run, "recording_id string, pixel_id int, v array<double>")
