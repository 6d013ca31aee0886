"""Clusters of active pixels: by density of features, by communities of a similarity graph.

k-means, communities and the spectral method are rounds of joins and aggregates over all recordings at once, each round cut off by
a written table, so neither a recording's pixels nor its graph meet in one task. Density clusters need a recording's points in order
of distance: those are found in one task for each recording, with memory in proportion to its pixels.
Labels: -2 inactive, -1 noise, 0 and up a cluster. Every choice is fixed by a seed or an order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .scalar import standardise

LABELS = "recording_id string, pixel_id int, label int, status string"
RID = "recording_id"
BLOCK = 1024  # pixels of a block


# ---- by density


LEAF = 32  # points of a leaf, about


class Boxes:
    """Points halved along the widest side of their box until a leaf has about ``LEAF``: boxes of each level, and leaves as rows of point numbers."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.x, self.levels = x, max(int(np.ceil(np.log2(n / LEAF))), 0)
        self.order, self.at = np.arange(n), [n * np.arange((1 << d) + 1) // (1 << d) for d in range(self.levels + 1)]
        for d in range(self.levels):
            for k in range(1 << d):
                part = self.order[self.at[d][k] : self.at[d][k + 1]]
                side = x[part, np.ptp(x[part], axis=0).argmax()]
                part[:] = part[np.argpartition(side, self.at[d + 1][2 * k + 1] - self.at[d][k])]
        laid = x[self.order]
        self.low = [np.minimum.reduceat(laid, at[:-1], axis=0) for at in self.at]
        self.high = [np.maximum.reduceat(laid, at[:-1], axis=0) for at in self.at]
        first, size = self.at[-1][:-1, None], np.diff(self.at[-1])[:, None]
        slot = np.arange(size.max())[None]
        for a, b in zip(self.at[-1][:-1], self.at[-1][1:], strict=True):
            self.order[a:b].sort()
        self.leaves, self.empty = self.order[first + np.minimum(slot, size - 1)], slot >= size

    def of(self, values: np.ndarray, how: np.ufunc) -> list[np.ndarray]:
        """``how`` (a minimum or maximum) of the points' values in the boxes of each level."""
        return [how.reduceat(values[self.order], at[:-1]) for at in self.at]

    def searched(self, bound: Callable[[], np.ndarray], meet: Callable[[np.ndarray, np.ndarray, np.ndarray], None], least: np.ndarray | None = None, of: np.ndarray | None = None) -> None:
        """``meet(p, q, distances)`` for points p, each once in a call, and rows q of the points of a leaf, nearest leaves first, unless these are farther
        than the point's ``bound()``. ``least`` is a lower bound of every length at a point, and points and boxes of one class of ``of`` don't meet.
        """
        bounds, a, b = self.of(bound(), np.maximum), np.zeros(1, int), np.zeros(1, int)
        floor = None if least is None else self.of(least, np.minimum)
        ends = None if of is None else (self.of(of, np.minimum), self.of(of, np.maximum))
        for d in range(self.levels + 1):
            if d:
                a, b = (2 * a[:, None] + [0, 0, 1, 1]).ravel(), (2 * b[:, None] + [0, 1, 0, 1]).ravel()
            kept, far = [], []
            for k in range(0, len(a), 1 << 20):
                i, j = a[k : k + (1 << 20)], b[k : k + (1 << 20)]
                gap = np.maximum(np.maximum(self.low[d][i] - self.high[d][j], self.low[d][j] - self.high[d][i]), 0)
                length = np.sqrt((gap**2).sum(1)) * (1 - 1e-12)
                if floor is not None:
                    length = np.maximum(length, np.maximum(floor[d][i], floor[d][j]))
                good = length <= bounds[d][i]
                if ends is not None:
                    good &= ~((ends[0][d][i] == ends[1][d][j]) & (ends[1][d][i] == ends[0][d][j]))
                kept.append(k + np.flatnonzero(good))
                far.append(length[good])
            kept = np.concatenate(kept)
            a, b, far = a[kept], b[kept], np.concatenate(far)
        order = np.lexsort((b, far, a))
        a, b, far = a[order], b[order], far[order]
        turn = np.arange(len(a)) - np.searchsorted(a, a)
        order = np.argsort(turn, kind="stable")
        a, b, far, cuts = a[order], b[order], far[order], np.cumsum(np.bincount(turn))
        for k, end in enumerate(cuts):
            begin, now = cuts[k - 1] if k else 0, bound()
            near = begin + np.flatnonzero(far[begin:end] <= self.of(now, np.maximum)[-1][a[begin:end]])
            p, leaf = self.leaves[a[near]], np.broadcast_to(b[near, None], (len(near), self.leaves.shape[1]))
            gap = sum(np.maximum(np.maximum(self.low[-1][leaf, c] - self.x[p, c], self.x[p, c] - self.high[-1][leaf, c]), 0) ** 2 for c in range(self.x.shape[1]))
            good = ~self.empty[a[near]] & (np.sqrt(gap) * (1 - 1e-12) <= now[p])
            if ends is not None:
                good &= ~((ends[0][-1][leaf] == of[p]) & (ends[1][-1][leaf] == of[p]))
            p, leaf = p[good], leaf[good]
            for i in range(0, len(p), 1 << 15):
                points, others = p[i : i + (1 << 15)], leaf[i : i + (1 << 15)]
                q = self.leaves[others]
                square = sum((self.x[points, c][:, None] - self.x[q, c]) ** 2 for c in range(self.x.shape[1]))
                meet(points, q, np.where(self.empty[others], np.inf, np.sqrt(square)))


def point_tree(x: np.ndarray, samples: int = 2) -> np.ndarray:
    """The edges of ``spanning_tree`` for points, whose time isn't to the square of their number: equal points first meet in one, which takes the others on
    at its own least length; the tree of the rest grows from all points at once (Boruvka), by search in boxes. Of equal lengths the lower numbers go first."""
    n, samples = len(x), min(samples, len(x) - 1)
    _, firsts, of, copies = np.unique(x, axis=0, return_index=True, return_inverse=True, return_counts=True)
    rank = np.argsort(np.argsort(firsts))
    of, copies, firsts = rank[of.ravel()], copies[np.argsort(firsts)], np.sort(firsts)
    boxes, m = Boxes(x[firsts]), len(firsts)

    # the nearest different points, itself among them, and which they are
    k, known = min(samples + 1, m), min(max(samples + 1, 6), m)
    nearest, which = np.full((m, known), np.inf), np.zeros((m, known), int)

    def gather(p: np.ndarray, q: np.ndarray, length: np.ndarray) -> None:
        if length.shape[1] > known:
            at = np.argpartition(length, known - 1, axis=1)[:, :known]
            length, q = np.take_along_axis(length, at, 1), np.take_along_axis(q, at, 1)
        both, those = np.concatenate([nearest[p], length], 1), np.concatenate([which[p], q], 1)
        first = np.argsort(both, axis=1, kind="stable")[:, :known]
        nearest[p], which[p] = np.take_along_axis(both, first, 1), np.take_along_axis(those, first, 1)

    start = np.full(m, np.inf)  # a leaf's own points bound what is farther
    for i in range(0, len(boxes.leaves), 2048):
        leaf = np.arange(i, min(i + 2048, len(boxes.leaves)))
        p = x[firsts][boxes.leaves[leaf]]
        square = sum((p[:, :, None, c] - p[:, None, :, c]) ** 2 for c in range(p.shape[2]))
        square = np.where(boxes.empty[leaf][:, None, :], np.inf, square)
        if square.shape[2] >= known:
            start[boxes.leaves[leaf]] = np.sqrt(np.partition(square, known - 1, axis=2)[:, :, known - 1])
    boxes.searched(lambda: np.minimum(start, nearest[:, -1]), gather)
    counts = np.where(np.isfinite(nearest), copies[which], 0)
    core = nearest[np.arange(m), (np.cumsum(counts, 1) > samples).argmax(1)]

    tree, group = [], np.arange(m)
    while True:
        groups = int(group.max()) + 1
        if groups == 1:
            break
        best, ends = np.full(groups, np.inf), np.full((groups, 2), m)

        def offer(p: np.ndarray, q: np.ndarray, length: np.ndarray, best=best, ends=ends, group=group) -> None:
            use = length <= best[group[p]]
            p, q, length = p[use], q[use], length[use]
            low, high, g = np.minimum(p, q), np.maximum(p, q), group[p]
            order = np.lexsort((high, low, length, g))
            order = order[np.flatnonzero(np.diff(g[order], prepend=-1))]
            g, told = g[order], np.stack([low[order], high[order]], 1)
            less = (length[order] < best[g]) | ((length[order] == best[g]) & ((told[:, 0] < ends[g, 0]) | ((told[:, 0] == ends[g, 0]) & (told[:, 1] < ends[g, 1]))))
            best[g[less]], ends[g[less]] = length[order][less], told[less]

        def across(p: np.ndarray, q: np.ndarray, length: np.ndarray, best=best, group=group, offer=offer) -> None:
            length = np.maximum(length, np.maximum(core[p][:, None], core[q]))
            length = np.where(group[p][:, None] == group[q], np.inf, length)
            at = length.argmin(1)[:, None]  # of equal ones the lowest number
            length = np.take_along_axis(length, at, 1)[:, 0]
            use = np.isfinite(length) & (length <= best[group[p]])
            offer(p[use], np.take_along_axis(q, at, 1)[use, 0], length[use])

        # neighbours in the order of the boxes give every group some way out, near points mostly a short one
        p = np.concatenate([boxes.order[:-1], np.repeat(np.arange(m), known)])
        q = np.concatenate([boxes.order[1:], np.where(np.isfinite(nearest), which, np.arange(m)[:, None]).ravel()])
        apart = group[p] != group[q]
        p, q = p[apart], q[apart]
        length = np.maximum(np.sqrt(sum((x[firsts[p], c] - x[firsts[q], c]) ** 2 for c in range(x.shape[1]))), np.maximum(core[p], core[q]))
        offer(p, q, length)
        offer(q, p, length)
        boxes.searched(lambda best=best, group=group: best[group], across, core, group)

        found = np.unique(np.column_stack([ends, np.arange(groups)]), axis=0)
        found = found[np.flatnonzero(np.diff(found[:, 0], prepend=-1) | np.diff(found[:, 1], prepend=-1))]
        tree.append(np.column_stack([found[:, :2], best[found[:, 2]]]))
        up = np.arange(groups)
        pairs = group[found[:, :2].astype(int)]
        while True:  # the least number spreads along the edges, halving the way each time
            least = np.minimum(up[pairs[:, 0]], up[pairs[:, 1]])
            after = up.copy()
            for side in (0, 1):
                np.minimum.at(after, up[pairs[:, side]], least)
            after = after[after]
            if (after == up).all():
                break
            up = after
        group = np.unique(up[group], return_inverse=True)[1]

    own = np.flatnonzero(firsts[of] != np.arange(n))
    edges = np.concatenate([np.column_stack([firsts[t[:, :2].astype(int)], t[:, 2]]) for t in tree] + [np.column_stack([firsts[of[own]], own, core[of[own]]])])
    # walked from the first point on, always along the shortest edge, as spanning_tree does
    ends = np.concatenate([edges[:, 0], edges[:, 1]]).astype(int)
    order = np.argsort(ends, kind="stable")
    others, lengths = np.concatenate([edges[:, 1], edges[:, 0]]).astype(int)[order].tolist(), np.tile(edges[:, 2], 2)[order].tolist()
    at = np.searchsorted(ends[order], np.arange(n + 1)).tolist()
    inside, ahead, here, walked = [False] * n, [], 0, []
    for turn in range(n - 1):
        inside[here] = True
        for i in range(at[here], at[here + 1]):
            if not inside[others[i]]:
                heappush(ahead, (lengths[i], others[i], turn, here))
        length, nxt, _, source = heappop(ahead)
        walked.append((source, nxt, length))
        here = nxt
    walked = np.array(walked).reshape(-1, 3)
    return walked[np.argsort(walked[:, 2], kind="stable")]


def spanning_tree(n: int, row: Callable[[int], np.ndarray], samples: int) -> np.ndarray:
    """(a, b, length) of the minimum spanning tree of mutual reachability, shortest edges first.

    ``row`` gives a point's distances to all; a pair is no nearer than either point's ``samples``-th neighbour, the point itself counted.
    """
    core = np.array([np.partition(row(i), min(samples, n - 1))[min(samples, n - 1)] for i in range(n)])
    near, source, inside = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    at, edges = 0, []
    for _ in range(n - 1):
        inside[at] = True
        length = np.maximum(row(at), np.maximum(core, core[at]))
        closer = ~inside & (length < near)
        near[closer], source[closer] = length[closer], at
        nxt = int(np.where(inside, np.inf, near).argmin())
        edges.append((source[nxt], nxt, near[nxt]))
        at = nxt
    edges.sort(key=lambda e: e[2])
    return np.array(edges).reshape(-1, 3)


def density_clusters(n: int, row: Callable[[int], np.ndarray], least: int, samples: int = 2) -> np.ndarray:
    """Labels of the clusters of most excess mass in the tree of points condensed to groups of ``least`` or more; -1 for noise."""
    return condensed(n, spanning_tree(n, row, samples), least)


def condensed(n: int, edges: np.ndarray, least: int) -> np.ndarray:
    """The same of a tree's ``edges``, shortest first."""
    if n < 2:
        return np.full(n, -1)
    parent, size = list(range(2 * n - 1)), [1] * n + [0] * (n - 1)
    children: dict[int, tuple[int, int, float]] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, (a, b, length) in enumerate(edges):
        x, y, new = find(int(a)), find(int(b)), n + k
        parent[x] = parent[y] = new
        children[new] = (x, y, float(length))
        size[new] = size[x] + size[y]

    def points(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            x = todo.pop()
            if x < n:
                out.append(x)
            else:
                todo += children[x][:2]
        return out

    # each cluster: its birth, its mass, its child clusters, its points
    clusters: list[dict] = [{"birth": 0.0, "mass": 0.0, "sub": [], "node": 2 * n - 2, "up": -1}]
    todo = [(2 * n - 2, 0)]
    while todo:
        node, of = todo.pop()
        if node < n:
            continue
        x, y, length = children[node]
        leave = 1 / max(length, 1e-12)
        big = [c for c in (x, y) if size[c] >= least]
        clusters[of]["mass"] += (leave - clusters[of]["birth"]) * (size[node] if len(big) != 1 else size[node] - size[big[0]])
        if len(big) == 1:
            todo.append((big[0], of))
        elif len(big) == 2:
            for c in big:
                clusters.append({"birth": leave, "mass": 0.0, "sub": [], "node": c, "up": of})
                clusters[of]["sub"].append(len(clusters) - 1)
                todo.append((c, len(clusters) - 1))
    chosen = set()
    best = [0.0] * len(clusters)
    for i in range(len(clusters) - 1, 0, -1):  # children come after their parents; the whole is never a cluster
        below = sum(best[j] for j in clusters[i]["sub"])
        if clusters[i]["mass"] >= below or not clusters[i]["sub"]:
            best[i] = clusters[i]["mass"]
            gone = list(clusters[i]["sub"])
            while gone:
                j = gone.pop()
                chosen.discard(j)
                gone += clusters[j]["sub"]
            chosen.add(i)
        else:
            best[i] = below
    labels = np.full(n, -1)
    for label, i in enumerate(sorted(chosen)):
        labels[points(clusters[i]["node"])] = label
    return labels


# ---- k-means


def _square(x: Column, c: Column) -> Column:
    return F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of points to centres, dimensions added in order; what isn't a number is farthest."""
    far = np.zeros((len(x), len(centres)))
    for d in range(x.shape[1]):
        far += (x[:, d, None] - centres[None, :, d]) ** 2
    return np.where(np.isnan(far), np.inf, far)


def k_means(points: DataFrame, dims: int, most: int, starts: int = 10, rounds: int = 100, seed: int = 42) -> DataFrame:
    """(recording_id, pixel_id, label) of ``points`` (recording_id, pixel_id, k, x of ``dims`` numbers), k up to ``most``.

    The best of several runs from starting points drawn by their squared distance; all runs of all recordings go on together, until
    no centre moves or for ``rounds`` rounds. Fewer different points than k give as many clusters. Points lie in blocks of ``BLOCK``
    pixels, one row each, so a round meets a block with the centres of all runs at once and sends on sums of the block.
    """
    key = [RID, "start"]
    row = F.struct("pixel_id", "x")
    blocks = points.groupBy(RID, F.floor(F.col("pixel_id") / BLOCK).alias("block")).agg(F.max("k").alias("k"), F.array_sort(F.collect_list(row)).alias("rows"))
    blocks = cut(blocks.select(RID, "block", "k", F.col("rows.pixel_id").alias("pixels"), F.flatten("rows.x").alias("x")))

    def drawn(step: int) -> Column:
        """For each run and pixel of a block -log of a chance that only they, the step and the seed decide."""
        chance = lambda p, s: (F.xxhash64(p, s, F.lit(step), F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + 1) / F.lit(float(1 << 52))
        return F.transform("starts", lambda s: F.transform("pixels", lambda p: -F.log(chance(p, s))))

    def met(centres: DataFrame) -> DataFrame:
        """The blocks, each with the runs of its recording: their numbers and their centres."""
        run = F.array_sort(F.collect_list(F.struct("start", F.flatten("centres").alias("flat"))))
        runs = centres.groupBy(RID).agg(run.alias("runs")).select(RID, F.col("runs.start").alias("starts"), F.col("runs.flat").alias("flats"))
        return blocks.select(RID, "pixels", "x").join(runs, RID)

    def each(pdf: pd.DataFrame) -> Iterator[tuple]:
        """(row, start, points, centres, squares) of each run of each block."""
        for i in range(len(pdf)):
            x = np.asarray(pdf["x"].iloc[i], float).reshape(-1, dims)
            for j, start in enumerate(pdf["starts"].iloc[i]):
                centres = np.asarray(pdf["flats"].iloc[i][j], float).reshape(-1, dims)
                yield i, j, int(start), x, squares(x, centres)

    def nearest_draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, j, start, x, far in each(pdf):
                least = far.min(1)
                draw = np.where(least > 0, np.asarray(pdf["draws"].iloc[i][j], float) / np.where(least > 0, least, 1.0), np.inf)
                at = int(draw.argmin())
                if np.isfinite(draw[at]):
                    out.append((pdf[RID].iloc[i], start, draw[at], x[at]))
            yield pd.DataFrame(out, columns=[*key, "draw", "x"])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, _, start, x, far in each(pdf):
                of = far.argmin(1)
                n = np.bincount(of, minlength=far.shape[1])
                total = np.stack([np.bincount(of, x[:, d], far.shape[1]) for d in range(dims)], 1)
                out += [(pdf[RID].iloc[i], start, c + 1, int(n[c]), total[c]) for c in np.flatnonzero(n)]
            yield pd.DataFrame(out, columns=[*key, "of", "n", "total"])

    def costs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(pdf[RID].iloc[i], start, far.min(1).sum()) for i, _, start, _, far in each(pdf)], columns=[*key, "cost"])

    def labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, _, _, _, far in each(pdf):
                yield pd.DataFrame({RID: pdf[RID].iloc[i], "pixel_id": np.asarray(pdf["pixels"].iloc[i], np.int32), "label": far.argmin(1).astype(np.int32)})

    # a run's first centre is the point of the smallest draw, all being equally likely
    runs = blocks.withColumn("starts", F.sequence(F.lit(0), F.lit(starts - 1))).withColumn("draws", drawn(0))
    least = F.transform("draws", lambda d: F.struct(F.array_min(d).alias("draw"), (F.array_position(d, F.array_min(d)) - 1).cast("int").alias("at")))
    firsts = runs.select(RID, "k", "x", F.posexplode(least).alias("start", "e")).select(*key, "k", "e.draw", F.slice("x", F.col("e.at") * dims + 1, dims).alias("x"))
    centres = cut(firsts.groupBy(key).agg(F.max("k").alias("k"), F.array(F.min_by("x", "draw")).alias("centres")))
    for step in range(1, most):
        draws = met(centres).withColumn("draws", drawn(step)).mapInPandas(nearest_draw, f"{RID} string, start int, draw double, x array<double>")
        more = draws.groupBy(key).agg(F.min_by("x", "draw").alias("more"))
        grown = F.when((F.size("centres") < F.col("k")) & F.col("more").isNotNull(), F.concat("centres", F.array("more"))).otherwise(F.col("centres"))
        centres = cut(centres.join(more, key, "left").select(*key, "k", grown.alias("centres")), centres)
    table = centres
    for _ in range(rounds):
        found = met(centres).mapInPandas(sums, f"{RID} string, start int, of int, n long, total array<double>")
        means = found.groupBy(*key, "of").agg(F.array(*[F.sum(F.col("total")[i]) / F.sum("n") for i in range(dims)]).alias("mean"))
        means = means.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("of", "mean"))).alias("means"))  # k entries
        moved = F.transform("centres", lambda c, i: F.coalesce(F.try_element_at("means", i + 1), c))
        after = cut(centres.join(means, key).select(*key, "k", moved.alias("centres"), F.col("centres").alias("was")), table)
        still = after.where(F.exists(F.zip_with("centres", "was", _square), lambda d: d > 1e-16)).isEmpty()
        table, centres = after, after.drop("was")
        if still:
            break
    cost = met(centres).mapInPandas(costs, f"{RID} string, start int, cost double").groupBy(key).agg(F.round(F.sum("cost"), 9).alias("cost"))
    best = cost.groupBy(RID).agg(F.min_by("start", F.struct("cost", "start")).alias("start"))
    return met(centres.join(best, key, "left_semi")).mapInPandas(labels, f"{RID} string, pixel_id int, label int")


# ---- by a graph


def _both_ways(pixels: DataFrame, edges: DataFrame) -> DataFrame:
    """(recording_id, u, v, w): the edges of a weight over 0 between ``pixels``, each from either end."""
    good = edges.where("weight > 0 and src <> dst")
    ends = [good.select(RID, F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"), "weight") for a, b in (("src", "dst"), ("dst", "src"))]
    for end in "uv":
        known = pixels.select(RID, F.col("pixel_id").cast("long")).distinct().toDF(RID, end)
        ends = [e.join(known, [RID, end], "left_semi") for e in ends]
    return ends[0].unionAll(ends[1]).groupBy(RID, "u", "v").agg(F.sum("weight").alias("w"))


def _local_moves(links: DataFrame, resolution: float, rounds: int) -> DataFrame:
    """(recording_id, u, c): nodes of ``links`` in communities that no single move betters, or that ``rounds`` rounds reached.

    In each round half of the nodes, by a hash, go to the neighbouring community of most gain, so neighbours don't swap places forever.
    """
    degree = links.groupBy(RID, "u").agg(F.sum("w").alias("degree"))
    total = degree.groupBy(RID).agg(F.sum("degree").alias("total"))
    state = table = cut(degree.join(total, RID).withColumn("c", F.col("u")))
    for turn in range(rounds):
        mass = state.groupBy(RID, "c").agg(F.sum("degree").alias("mass"))
        near = links.where("u <> v").join(state.select(RID, F.col("u").alias("v"), "c"), [RID, "v"]).select(RID, "u", "c", "w")
        near = near.unionAll(state.select(RID, "u", "c", F.lit(0.0))).groupBy(RID, "u", "c").agg(F.sum("w").alias("near"))
        options = near.join(mass, [RID, "c"]).join(state.withColumnRenamed("c", "home"), [RID, "u"])
        home = F.col("c") == F.col("home")
        gain = F.col("near") - resolution * (F.col("mass") - F.when(home, F.col("degree")).otherwise(0.0)) * F.col("degree") / F.col("total")
        best = options.withColumn("gain", F.round(gain, 9)).groupBy(RID, "u", "degree", "total", "home").agg(
            F.max_by("c", F.struct("gain", home, -F.col("c"))).alias("c")
        )
        awake = F.pmod(F.xxhash64("u", F.lit(turn)), F.lit(2)) == 0
        wish = F.col("c") != F.col("home")
        after = cut(best.select(RID, "u", "degree", "total", F.when(awake, F.col("c")).otherwise(F.col("home")).alias("c"), wish.alias("wish")), table)
        table, state = after, after.drop("wish")
        if after.where("wish").isEmpty():
            break
    return state.select(RID, "u", "c")


def communities(pixels: DataFrame, edges: DataFrame, resolution: float = 1.0, rounds: int = 40) -> DataFrame:
    """(recording_id, pixel_id, label) by modularity: nodes move, communities become nodes, until none join. A pixel without edges is alone."""
    links = cut(_both_ways(pixels, edges))
    labels = pixels.select(RID, "pixel_id").distinct().withColumn("c", F.col("pixel_id").cast("long"))
    while True:
        of = _local_moves(links, resolution, rounds)
        sizes = of.agg(F.count("*").alias("nodes"), F.count_distinct(RID, "c").alias("communities")).first()
        if sizes["nodes"] == sizes["communities"]:
            break
        ends = [of.toDF(RID, end, f"{end}_c") for end in "uv"]
        links = cut(links.join(ends[0], [RID, "u"]).join(ends[1], [RID, "v"]).groupBy(RID, F.col("u_c").alias("u"), F.col("v_c").alias("v")).agg(F.sum("w").alias("w")), links)
        labels = cut(labels.join(of.toDF(RID, "c", "up"), [RID, "c"], "left").select(RID, "pixel_id", F.coalesce("up", "c").alias("c")))
    names = labels.groupBy(RID, "c").agg(F.min("pixel_id").alias("least")).withColumn("label", F.row_number().over(Window.partitionBy(RID).orderBy("least")) - 1)
    return labels.join(names, [RID, "c"]).select(RID, "pixel_id", "label")


def spectral(pixels: DataFrame, edges: DataFrame, most: int = 8, rounds: int = 40, seed: int = 42) -> DataFrame:
    """(recording_id, pixel_id, label): k-means of the leading vectors of the normalised affinity, k a tenth of the pixels, 2 to ``most``.

    The vectors come from ``rounds`` rounds of orthogonal iteration: a product along the edges by a join, then a change of basis from
    the ``most`` x ``most`` products of the vectors, one small matrix for each recording. Nodes lie in blocks of ``BLOCK`` pixels and edges in
    blocks of two such; a round joins these and writes one table, and the change of basis is done where the next round reads it.
    """
    links = _both_ways(pixels, edges).withColumn("w", F.least("w", F.lit(1.0)))
    degree = links.groupBy(RID, "u").agg(F.sum("w").alias("degree"))
    of = {end: degree.toDF(RID, end, f"d_{end}") for end in "uv"}
    links = links.join(of["u"], [RID, "u"]).join(of["v"], [RID, "v"]).select(RID, "u", "v", (F.col("w") / F.sqrt(F.col("d_u") * F.col("d_v"))).alias("w"))
    in_block = lambda c: F.floor(F.col(c) / BLOCK)
    entry = F.array_sort(F.collect_list(F.struct("u", "v", "w"))).alias("e")
    matrix = links.groupBy(RID, in_block("u").alias("to"), in_block("v").alias("block")).agg(entry)
    matrix = cut(matrix.select(RID, "to", "block", F.col("e.u").alias("us"), F.col("e.v").alias("vs"), F.col("e.w").alias("ws")))
    start = F.array(*[F.xxhash64("u", F.lit(i), F.lit(seed)) / F.lit(float(1 << 63)) for i in range(most)])
    nodes = pixels.select(RID, F.col("pixel_id").cast("long").alias("u")).distinct()
    rows = nodes.select(RID, in_block("u").alias("block"), F.struct("u", start.alias("x")).alias("row")).groupBy(RID, "block").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    vectors = cut(rows.select(RID, "block", F.col("rows.u").alias("ids"), F.flatten("rows.x").alias("x")))

    def as_vectors(flat) -> np.ndarray:
        return np.asarray(flat, float).reshape(-1, most)

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, some in pdf.groupby(RID):
                yield pd.DataFrame({RID: [name], "gram": [np.sum(np.stack(some["gram"]), 0)]})

    @F.pandas_udf("array<double>")
    def basis(grams: pd.Series) -> pd.Series:
        """The change of basis that makes the vectors orthogonal and of length one; directions that have vanished become zero."""
        out = []
        for some in grams:
            values, q = np.linalg.eigh(as_vectors(some).reshape(-1, most, most).sum(0))
            good = values > max(values.max(), 1e-300) * 1e-13
            out.append((q * np.where(good, 1 / np.sqrt(np.where(good, values, 1.0)), 0.0))[:, ::-1].ravel())
        return pd.Series(out)

    @F.pandas_udf("array<double>")
    def rotate(x: pd.Series, turn: pd.Series) -> pd.Series:
        return pd.Series([(as_vectors(a) @ as_vectors(t)).ravel() for a, t in zip(x, turn, strict=True)])

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ids, flat, us, vs, ws in zip(pdf["ids"], pdf["x"], pdf["us"], pdf["vs"], pdf["ws"], strict=True):
                x = as_vectors(flat)[np.searchsorted(ids, vs)]
                reached, at = np.unique(us, return_inverse=True)
                out.append((reached, np.stack([np.bincount(at, ws * x[:, i], len(reached)) for i in range(most)], 1).ravel()))
            yield pd.DataFrame({RID: pdf[RID], "block": pdf["to"], "us": [u for u, _ in out], "y": [y for _, y in out]})

    def step(own: pd.DataFrame, products: pd.DataFrame) -> pd.DataFrame:
        # half of the vector itself stays, so that eigenvalues near -1 don't lead
        ids, x = own["ids"].iloc[0], as_vectors(own["x"].iloc[0])
        y = np.zeros_like(x)
        for us, flat in zip(products["us"], products["y"], strict=True):
            y[np.searchsorted(ids, us)] += as_vectors(flat)
        ahead = x + y
        return pd.DataFrame({RID: own[RID], "block": own["block"], "ids": own["ids"], "x": [ahead.ravel()], "gram": [(ahead.T @ ahead).ravel()]})

    def turned(v: DataFrame) -> DataFrame:
        if "gram" not in v.columns:
            return v
        grams = v.select(RID, "gram").mapInPandas(added, f"{RID} string, gram array<double>")
        turns = grams.groupBy(RID).agg(F.flatten(F.collect_list("gram")).alias("grams")).select(RID, basis("grams").alias("turn"))
        return v.join(turns, RID).select(RID, "block", "ids", rotate("x", "turn").alias("x"))

    for _ in range(rounds):
        now = turned(vectors)
        products = matrix.join(now, [RID, "block"]).mapInPandas(multiply, f"{RID} string, block long, us array<long>, y array<double>")
        both = now.toDF(*now.columns).groupBy(RID, "block").cogroup(products.groupBy(RID, "block"))
        vectors = cut(both.applyInPandas(step, f"{RID} string, block long, ids array<long>, x array<double>, gram array<double>"), vectors)

    def apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, ids, flat in zip(pdf[RID], pdf["ids"], pdf["x"], strict=True):
                yield pd.DataFrame({RID: name, "u": np.asarray(ids), "x": list(as_vectors(flat))})

    found = turned(vectors).mapInPandas(apart, f"{RID} string, u long, x array<double>")
    k = F.least(F.lit(most), F.greatest(F.lit(2), F.floor(F.count("*") / 10).cast("int")))
    ks = nodes.groupBy(RID).agg(k.alias("k"))
    lead = F.array(*[F.when(F.col("k") > i, F.col("x")[i] / F.sqrt(F.coalesce("degree", F.lit(1.0)))).otherwise(0.0) for i in range(most)])
    points = found.join(ks, RID).join(degree, [RID, "u"], "left").select(RID, F.col("u").cast("int").alias("pixel_id"), "k", lead.alias("x"))
    return k_means(cut(points), most, most, seed=seed)


# ---- all methods


def guarded(run: Callable[..., pd.DataFrame], sides: int = 1) -> Callable[..., pd.DataFrame]:
    """``run`` over the rows of a recording, of one table or of two; where it fails there is one row without a label, and the error as its status."""

    def safe(*frames: pd.DataFrame) -> pd.DataFrame:
        try:
            return run(*frames)
        except Exception as e:
            name = next(f[RID].iloc[0] for f in frames if len(f))
            return pd.DataFrame({RID: [name], "pixel_id": pd.array([None], "Int32"), "label": pd.array([None], "Int32"), "status": [f"failed: {e}"]})

    # Spark counts a function's arguments
    return (lambda pdf: safe(pdf)) if sides == 1 else lambda left, right: safe(left, right)


def density_labels(features: np.ndarray) -> np.ndarray:
    """Labels of active pixels by the density of their features: all -2 for under three, all 0 where no feature varies."""
    n = len(features)
    if n < 3:
        return np.full(n, -2)
    std = features.std(0)
    good = std > 1e-10
    if not good.any():
        return np.zeros(n, int)
    x = np.nan_to_num((features[:, good] - features[:, good].mean(0)) / std[good], nan=0.0, posinf=0.0, neginf=0.0)
    return condensed(n, point_tree(x), max(3, n // 15))


def graph_density_labels(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Labels by distances 1 - weight, 1 without an edge; noise becomes a cluster of its own."""
    if n == 1:
        return np.zeros(1, int)
    ends, others, length = np.concatenate([src, dst]), np.concatenate([dst, src]), 1 - np.clip(np.concatenate([weight, weight]), 0, 1)
    order = np.argsort(ends, kind="stable")
    others, length, at = others[order], length[order], np.searchsorted(ends[order], np.arange(n + 1))

    def row(i: int) -> np.ndarray:
        out = np.ones(n)
        out[others[at[i] : at[i + 1]]] = length[at[i] : at[i + 1]]
        out[i] = 0
        return out

    labels = density_clusters(n, row, max(3, n // 15))
    labels[labels == -1] = labels.max() + 1
    return labels


def cluster_features(features: DataFrame, columns: list[str], method: str = "density") -> DataFrame:
    """(recording_id, pixel_id, label, status) of the rows of ``features``."""
    if method == "k-means":
        told = features.select(RID, "pixel_id", *columns)
        n = told.groupBy(RID).agg(F.count("*").alias("n"))
        k = F.least(F.lit(4), F.greatest(F.lit(2), F.floor(F.col("n") / 5).cast("int")))
        points = cut(standardise(told, columns).join(n, RID).select(RID, "pixel_id", "n", k.alias("k"), F.array(*columns).alias("x")))
        found = k_means(points.where("n >= 3").drop("n"), len(columns), 4).unionAll(points.where("n < 3").select(RID, "pixel_id", F.lit(-2)))
        return found.withColumn("status", F.lit(method))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pixel_id")
        labels = density_labels(pdf[columns].to_numpy(float))
        return pd.DataFrame({RID: pdf[RID], "pixel_id": pdf["pixel_id"], "label": labels.astype(np.int32), "status": method})

    return features.select(RID, "pixel_id", *columns).groupBy(RID).applyInPandas(guarded(run), LABELS)


def cluster_graph(active: DataFrame, edges: DataFrame, method: str = "communities") -> DataFrame:
    """(recording_id, pixel_id, label, status) of ``active`` pixels by ``edges`` (src, dst, weight) between them."""
    if method != "density":
        found = {"communities": communities, "spectral": spectral}[method](active.select(RID, "pixel_id"), edges)
        return found.withColumn("status", F.lit(method))

    def run(pixels: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(pixels["pixel_id"].unique())
        if not len(ids):
            return pd.DataFrame({RID: [], "pixel_id": [], "label": [], "status": []})
        links = links[links["src"].isin(ids) & links["dst"].isin(ids)].sort_values(["src", "dst"])
        src, dst = (np.searchsorted(ids, links[c]) for c in ("src", "dst"))
        labels = graph_density_labels(len(ids), src, dst, links["weight"].to_numpy(float))
        return pd.DataFrame({RID: pixels[RID].iloc[0], "pixel_id": ids.astype(np.int32), "label": labels.astype(np.int32), "status": method})

    # new names for columns that both sides may have from one table
    left = active.select(RID, "pixel_id").toDF(RID, "pixel_id").groupBy(RID)
    right = edges.select(RID, "src", "dst", "weight").toDF(RID, "src", "dst", "weight").groupBy(RID)
    return left.cogroup(right).applyInPandas(guarded(run, 2), LABELS)


def first_that_holds(active: DataFrame, edges: DataFrame, methods: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] | None = None) -> DataFrame:
    """(recording_id, pixel_id, label, status) by the first method that labels a recording; where all fail its pixels are one cluster, ``single``.

    A method takes active pixels and edges, and has failed for a recording without a label for each of its pixels. A later method sees only the recordings
    that are left, and isn't run if there are none. By default: communities, spectral, density.
    """
    if methods is None:
        methods = {m: lambda a, e, m=m: cluster_graph(a, e, m) for m in ("communities", "spectral", "density")}
    left, out = active.select(RID, "pixel_id").distinct(), None
    for name, run in methods.items():
        known = edges.join(left.select(RID).distinct(), RID, "left_semi")
        found = run(left, known).where("label IS NOT NULL").select(RID, "pixel_id", "label", F.lit(name).alias("status"))
        told = cut(left.join(found, [RID, "pixel_id"], "left"))
        well = told.groupBy(RID).agg((F.count("*") == F.count("label")).alias("well")).where("well").select(RID)
        done = told.join(well, RID, "left_semi")
        out, left = done if out is None else out.unionByName(done), told.select(RID, "pixel_id").join(well, RID, "left_anti")
        if left.isEmpty():
            return out
    return out.unionByName(left.select(RID, "pixel_id", F.lit(0).alias("label"), F.lit("single").alias("status")))
