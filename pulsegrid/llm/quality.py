"""Quality rules by gradient-boosted trees over document statistics.

Every whole text is reduced to a row of statistics. Trees are grown on quantile bins of the statistics of at most
``max_labelled`` labelled documents (the smallest hashes of the id), with monotonic constraints: more symbols, repeated lines,
repeated word runs or shouting can only lower the score. The ensemble is flattened into numpy arrays of nodes, so a batch is
scored by a fixed number of array steps. A document is kept when the base rules pass and the score is at least ``least``.

Null and empty texts have no word, so they fail the base rules. Without labels of both classes the score is the share of good
labels (1 without any). Rows are kept one for one, repeated and null ids included, as a score depends on the text alone; texts of any length are
read whole; of splits that gain alike the first statistic and the lowest threshold is taken; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, read_table, settled, smallest, spread
from .wordhash import Words, windows

# The statistics that trees may use, with the sign of the constraint on each.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "bars_per_word": -1, "dup_lines": -1, "repeated_words": -1,
    "distinct_words": 0, "upper": -1, "digits": 0, "marks": 0, "words_per_line": 0, "commonest_word": -1, "stops_per_word": 0,
    "exclamations_per_word": -1, "same_neighbours": -1,
}
SYMBOLS = b"#*$%&|<>"


def _class(of: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


_CLASSES = [_class(x) for x in (SYMBOLS, b"|", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b".,;:", b"!")]
_CONTINUES = _class(bytes(range(128, 192)))


def statistics(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per text the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the features."""
    data = [t.encode("utf-8", "replace") for t in texts]
    words = Words(data)
    h, starts = words.hashes(), np.cumsum([0] + [len(d) + 1 for d in data])
    sums = [np.concatenate([[0], np.cumsum(c[words.bytes])]) for c in (*_CLASSES, _CONTINUES)]
    # every text ends in a line feed of its own, so its range is never empty
    of = [s[starts[1:] - 1] - s[starts[:-1]] for s in sums]
    length = np.concatenate([[0], np.cumsum(words.end - words.start)])
    counts, features = np.zeros((len(data), 5), np.int64), np.zeros((len(data), len(FEATURES)))
    for i, d in enumerate(data):
        a, b = words.first[i], words.first[i + 1]
        n = int(b - a)
        lines = [x for x in d.split(b"\n") if x.strip()]
        dup = len(lines) - len(set(lines))
        own = h[a:b]
        runs, covered = windows(own, 5), 0
        if len(runs) > 1:
            _, inverse, times = np.unique(runs, return_inverse=True, return_counts=True)
            if len(times) < len(runs):
                again = times[inverse] > 1
                edge = np.zeros(n + 1, np.int64)
                at = np.flatnonzero(again)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + 5, -1)
                covered = int((np.cumsum(edge)[:n] > 0).sum())
        chars = int(length[b] - length[a] - of[-1][i])
        counts[i] = n, chars, of[0][i], dup, covered
        if n:
            distinct, times = np.unique(own, return_counts=True)
            letters = max(of[2][i] + of[3][i], 1)
            features[i] = (
                np.log1p(n), chars / n, of[0][i] / n, of[1][i] / n, dup / len(lines), covered / n,
                len(distinct) / np.sqrt(n), of[2][i] / letters, of[4][i] / max(chars, 1), of[5][i] / max(chars, 1), n / len(lines), times.max() / n, of[5][i] / n,
                of[6][i] / n, float((own[1:] == own[:-1]).mean()) if n > 1 else 0.0,
            )
    return counts, features


# ---- boosted trees


class Forest:
    """Trees as arrays of nodes: feature (-1 at a leaf), threshold, left, right, value; ``roots`` has the trees' first nodes."""

    def __init__(self, base: float, deep: int):
        self.base, self.deep = base, deep
        self.feature, self.threshold, self.left, self.right, self.value, self.roots = [], [], [], [], [], []

    def node(self) -> int:
        for column, x in ((self.feature, -1), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column.append(x)
        return len(self.feature) - 1

    def flatten(self) -> Forest:
        for name, kind in (("feature", np.int32), ("threshold", np.float64), ("left", np.int32), ("right", np.int32), ("value", np.float64), ("roots", np.int32)):
            setattr(self, name, np.array(getattr(self, name), kind))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, for all rows and trees a level at a time."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.deep):
            f = self.feature[at]
            inner = f >= 0
            goes_left = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)
        return 1 / (1 + np.exp(-np.clip(self.base + self.value[at].sum(1), -40, 40)))


def fit_forest(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 80, deep: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0, least: int = 8) -> Forest:
    """Logistic boosting by histograms; a split that would break a constraint isn't taken, and its middle value bounds both sides."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    forest = Forest(float(np.log(share / (1 - share))), deep)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    odds = np.full(len(y), forest.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        g, h = y - p, p * (1 - p)
        root = forest.node()
        forest.roots.append(root)
        todo = [(root, np.arange(len(y)), -np.inf, np.inf, 0)]
        while todo:
            node, rows, low, high, depth = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, None)
            if depth < deep and len(rows) >= 2 * least:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[rows, j]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
                    gr, hr = gs - gl, hs - hl
                    vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
                    gain = gl * vl - (hl + ridge) * vl**2 / 2 + gr * vr - (hr + ridge) * vr**2 / 2
                    gain -= gs * (v := np.clip(gs / (hs + ridge), low, high)) - (hs + ridge) * v**2 / 2
                    gain[(nl < least) | (len(rows) - nl < least) | (signs[j] * (vr - vl) < 0)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (j, k, vl[k], vr[k]))
            if best[1] is None:
                forest.value[node] = rate * float(np.clip(gs / (hs + ridge), low, high))
                odds[rows] += forest.value[node]
                continue
            j, k, vl, vr = best[1]
            forest.feature[node], forest.threshold[node] = j, float(cuts[j][k])
            forest.left[node], forest.right[node] = forest.node(), forest.node()
            goes_left, middle = binned[rows, j] <= k, (vl + vr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(signs[j])]
            todo.append((forest.left[node], rows[goes_left], *bounds[0], depth + 1))
            todo.append((forest.right[node], rows[~goes_left], *bounds[1], depth + 1))
    return forest.flatten()


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 16_384) -> Forest | float:
    """Trees from ``labels`` (doc_id, quality 0 or 1); a constant score where they have one class only."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = smallest(known, max_labelled, "doc_id", "quality")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [statistics(texts)[1] for texts in chunks(pdf["text"])]
            if found:
                yield pd.DataFrame(np.concatenate(found), columns=list(FEATURES)).assign(quality=pdf["quality"].to_numpy())

    # bounded: max_labelled ids, and for each a row of numbers
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").repartition("doc_id").select("text", "quality")
    rows = sample.mapInPandas(settled(run), ", ".join(f"{f} double" for f in FEATURES) + ", quality int").toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")
    y = rows["quality"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 1.0
    return fit_forest(rows[list(FEATURES)].to_numpy(), y, np.array(list(FEATURES.values())))


def judge(docs: DataFrame, model: Forest | float, least: float = 0.5) -> DataFrame:
    """Per document of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            ids = iter(pdf["doc_id"])
            for texts in chunks(pdf["text"]):
                counts, x = statistics(texts)
                failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
                score = np.full(len(x), model) if isinstance(model, float) else model.score(x)
                out = pd.DataFrame(counts, columns=names).assign(base_failed=failed, score=score, kept=~failed & (score >= least))
                out.insert(0, "doc_id", pd.array([next(ids) for _ in texts], "Int64"))
                yield out

    return docs.select("doc_id", "text").mapInPandas(settled(run), "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, score double, kept boolean")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(spread(docs, "doc_id"), fit(docs, read_table(spark, sf_dir, "labels")))
