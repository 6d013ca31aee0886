"""A contrastive encoder of signals: one-dimensional convolutions in numpy, trained for each recording in a task of its own.

Three convolutions (1-32 of width 7, 32-64 of 5, 64-128 of 3), each normalised over the batch and rectified, the first two followed
by pooling of pairs; the mean over time is the 128-wide vector used later, a head 128-128-64 of length one serves training only.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scalar import zscore

LAYERS = ((1, 32, 7), (32, 64, 5), (64, 128, 3))


def new_weights(seed: int = 42) -> dict[str, np.ndarray]:
    rng, w = np.random.default_rng(seed), {}
    for i, (a, b, k) in enumerate(LAYERS):
        bound = 1 / np.sqrt(a * k)
        w |= {f"c{i}": rng.uniform(-bound, bound, (b, a, k)), f"cb{i}": rng.uniform(-bound, bound, b), f"g{i}": np.ones(b), f"s{i}": np.zeros(b), f"m{i}": np.zeros(b), f"v{i}": np.ones(b)}
    for i, (a, b) in enumerate(((128, 128), (128, 64))):
        bound = 1 / np.sqrt(a)
        w |= {f"h{i}": rng.uniform(-bound, bound, (b, a)), f"hb{i}": rng.uniform(-bound, bound, b)}
    return w


def trained(w: dict[str, np.ndarray]) -> list[str]:
    """Names of the weights that training changes; running means and variances aren't among them."""
    return [k for k in w if k[0] not in "mv"]


def _windows(x: np.ndarray, k: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (0, 0), (k // 2, k // 2))), k, 2)


def forward(w: dict[str, np.ndarray], x: np.ndarray, training: bool) -> tuple[np.ndarray, np.ndarray, list]:
    """Vectors h and projections z of signals (batch x time), and what the way back needs. Training moves the running statistics."""
    a, kept = x[:, None, :], []
    for i, (_, _, k) in enumerate(LAYERS):
        win = _windows(a, k)
        y = np.einsum("bctk,ock->bot", win, w[f"c{i}"], optimize=True) + w[f"cb{i}"][:, None]
        if training:
            mean, var, n = y.mean((0, 2)), y.var((0, 2)), y.shape[0] * y.shape[2]
            w[f"m{i}"] = 0.9 * w[f"m{i}"] + 0.1 * mean
            w[f"v{i}"] = 0.9 * w[f"v{i}"] + 0.1 * var * n / max(n - 1, 1)
        else:
            mean, var = w[f"m{i}"], w[f"v{i}"]
        scale = 1 / np.sqrt(var + 1e-5)
        unit = (y - mean[:, None]) * scale[:, None]
        out = np.maximum(unit * w[f"g{i}"][:, None] + w[f"s{i}"][:, None], 0)
        first = None
        if i < 2:
            t = out.shape[2] // 2
            pairs = out[:, :, : 2 * t].reshape(*out.shape[:2], t, 2)
            first = pairs[..., 0] >= pairs[..., 1]
            pooled = pairs.max(3)
        else:
            pooled = out
        kept.append((win, unit, scale, out, first))
        a = pooled
    h = a.mean(2)
    u = h @ w["h0"].T + w["hb0"]
    r = np.maximum(u, 0)
    p = r @ w["h1"].T + w["hb1"]
    length = np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
    kept.append((h, u, r, p, length))
    return h, p / length, kept


def backward(w: dict[str, np.ndarray], kept: list, dz: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the trained weights from that of the projections, for a forward run in training."""
    h, u, r, p, length = kept[-1]
    z = p / length
    dp = (dz - z * (dz * z).sum(1, keepdims=True)) / length
    g = {"h1": dp.T @ r, "hb1": dp.sum(0)}
    du = (dp @ w["h1"]) * (u > 0)
    g |= {"h0": du.T @ h, "hb0": du.sum(0)}
    time = kept[2][3].shape[2]
    da = np.repeat((du @ w["h0"])[:, :, None] / time, time, 2)
    for i in (2, 1, 0):
        win, unit, scale, out, first = kept[i]
        if first is not None:
            full = np.zeros_like(out)
            t = da.shape[2]
            full[:, :, 0 : 2 * t : 2], full[:, :, 1 : 2 * t : 2] = da * first, da * ~first
            da = full
        d = da * (out > 0)
        g[f"s{i}"], g[f"g{i}"] = d.sum((0, 2)), (d * unit).sum((0, 2))
        d = d * w[f"g{i}"][:, None]
        n = d.shape[0] * d.shape[2]
        dy = (d - d.sum((0, 2))[:, None] / n - unit * (d * unit).sum((0, 2))[:, None] / n) * scale[:, None]
        g[f"c{i}"], g[f"cb{i}"] = np.einsum("bot,bctk->ock", dy, win, optimize=True), dy.sum((0, 2))
        if i:
            k = LAYERS[i][2]
            da = np.einsum("botk,ock->bct", _windows(dy, k)[..., ::-1], w[f"c{i}"], optimize=True)
    return g


def contrastive_loss(za: np.ndarray, zb: np.ndarray, temperature: float = 0.5) -> tuple[float, np.ndarray, np.ndarray]:
    """Cross entropy of finding each row's partner among all other rows, and its gradients."""
    z, n = np.concatenate([za, zb]), len(za)
    logits = z @ z.T / temperature
    np.fill_diagonal(logits, -np.inf)
    logits -= logits.max(1, keepdims=True)
    chance = np.exp(logits)
    chance /= chance.sum(1, keepdims=True)
    partner = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    rows = np.arange(2 * n)
    loss = float(-np.log(np.maximum(chance[rows, partner], 1e-300)).mean())
    chance[rows, partner] -= 1
    dz = (chance + chance.T) @ z / temperature / (2 * n)
    return loss, dz[:n], dz[n:]


def augment(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Each row changed in one of four ways: turned in time, scaled by 0.6 to 1.4, noise of 5 % of its range, a slow sine of 10 %."""
    out, t = x.copy(), x.shape[1]
    for i, kind in enumerate(rng.integers(0, 4, len(x))):
        span = np.ptp(x[i])
        if kind == 0:
            out[i] = np.roll(x[i], rng.integers(-(t // 2), t // 2 + 1))
        elif kind == 1:
            out[i] = x[i] * rng.uniform(0.6, 1.4)
        elif kind == 2:
            out[i] = x[i] + rng.normal(0, 0.05 * span, t)
        else:
            out[i] = x[i] + 0.1 * span * np.sin(2 * np.pi * np.arange(t) / t + rng.uniform(0, 2 * np.pi))
    return out


def train(x: np.ndarray, epochs: int = 100, batch: int = 256, rate: float = 3e-4, decay: float = 1e-5, seed: int = 42) -> tuple[dict[str, np.ndarray], list[float]]:
    """Weights and losses; one batch for each epoch, Adam, the rate falling along a cosine to 1e-5. Under two signals stay untrained."""
    rng, w = np.random.default_rng(seed), new_weights(seed)
    if len(x) < 2:
        return w, []
    names, losses = trained(w), []
    one, two = ({k: np.zeros_like(w[k]) for k in names} for _ in range(2))
    deal = rng.permutation(len(x)) if len(x) >= epochs * batch else None  # enough for every batch to be new
    for epoch in range(epochs):
        some = x[rng.choice(len(x), min(batch, len(x)), replace=False) if deal is None else deal[epoch * batch : (epoch + 1) * batch]]
        _, za, ka = forward(w, augment(some, rng), True)
        _, zb, kb = forward(w, augment(some, rng), True)
        loss, da, db = contrastive_loss(za, zb)
        ga, gb = backward(w, ka, da), backward(w, kb, db)
        step = 1e-5 + (rate - 1e-5) * (1 + np.cos(np.pi * epoch / epochs)) / 2
        for k in names:
            g = ga[k] + gb[k] + decay * w[k]
            one[k] = 0.9 * one[k] + 0.1 * g
            two[k] = 0.999 * two[k] + 0.001 * g * g
            w[k] = w[k] - step * (one[k] / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(two[k] / (1 - 0.999 ** (epoch + 1))) + 1e-8)
        losses.append(loss)
    return w, losses


def train_encoders(packed: DataFrame, epochs: int = 100, seed: int = 42, batch: int = 256) -> DataFrame:
    """(recording_id, weights, first_loss, last_loss): an encoder for each recording's active signals.

    An epoch is one batch, so training draws epochs x batch signals whatever the recording's size: all signals, or of more than
    that those of the smallest hashes, each once. These reach the recording's task, the others don't.
    """
    order = Window.partitionBy("recording_id").orderBy(F.xxhash64("pixel_id"), "pixel_id")
    some = zscore(packed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= epochs * batch))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pixel_id")
        w, losses = train(np.stack([np.asarray(v, float) for v in pdf["v"]]), epochs, batch, seed=seed)
        out = io.BytesIO()
        np.savez(out, **w)
        return pd.DataFrame({"recording_id": [pdf["recording_id"].iloc[0]], "weights": [out.getvalue()], "first_loss": [losses[0] if losses else None], "last_loss": [losses[-1] if losses else None]})

    return some.select("recording_id", "pixel_id", "v").groupBy("recording_id").applyInPandas(run, "recording_id string, weights binary, first_loss double, last_loss double")


def embed(packed: DataFrame, encoders: DataFrame, block: int = 4096) -> DataFrame:
    """(recording_id, pixel_id, embedding): vectors of length one. Blocks of a recording's signals meet its weights (0.25 MB) by an equi-join."""

    def run(signals: pd.DataFrame, encoder: pd.DataFrame) -> pd.DataFrame:
        if not len(signals) or not len(encoder):
            return pd.DataFrame({"recording_id": [], "pixel_id": [], "embedding": []})
        w = dict(np.load(io.BytesIO(encoder["weights"].iloc[0])))
        signals = signals.sort_values("pixel_id")
        x = np.stack([np.asarray(v, float) for v in signals["v"]])
        h = np.concatenate([forward(w, x[a : a + 256], False)[0] for a in range(0, len(x), 256)])
        h /= np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)
        return pd.DataFrame({"recording_id": signals["recording_id"], "pixel_id": signals["pixel_id"], "embedding": list(h.astype(np.float32))})

    key = ["recording_id", "block"]
    dealt = packed.withColumn("block", F.floor(F.col("pixel_id") / block))
    signals = zscore(dealt).select(*key, "pixel_id", "v").toDF(*key, "pixel_id", "v")
    weights = dealt.select(*key).distinct().toDF(*key).join(encoders.select("recording_id", "weights").toDF("recording_id", "weights"), "recording_id")
    return signals.groupBy(key).cogroup(weights.select(*key, "weights").groupBy(key)).applyInPandas(run, "recording_id string, pixel_id int, embedding array<float>")
