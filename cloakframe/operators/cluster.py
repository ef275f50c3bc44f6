"""Clustering for k-anonymity: nearest neighbours, k-member, one-pass k-means and graded centres.

These are greedy and sequential. Rows are first grouped into blocks (a column given by the
caller, such as a coarse hierarchy value); each block is clustered by itself, in one task.
One block is the exact method; blocks bound a task's rows and work. A block with fewer
than k rows goes to one cluster and is reported as such by the size column.

Distances are normalised certainty penalties: a category's is the share of leaves under
the lowest common node (0 if equal), a number's the share of its domain.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Tree:
    """A hierarchy from root paths (leaf first)."""

    paths: dict[str, list[str]]
    index: dict[str, int] = field(init=False)

    def __post_init__(self):
        names = dict.fromkeys(x for p in self.paths.values() for x in p)
        self.index = {x: i for i, x in enumerate(names)}
        self.names = list(names)
        n = len(names)
        up = {p[i]: p[i:] for p in self.paths.values() for i in range(len(p))}
        leaves = np.zeros(n, int)
        for p in self.paths.values():
            for x in p:
                leaves[self.index[x]] += 1
        inner = np.array([x not in self.paths or len(up[x]) == 1 for x in names])
        self.width = np.where(inner, leaves / max(1, len(self.paths)), 0.0)
        self.level = np.array([len(up[x]) - 1 for x in names])
        down = np.full((n, int(self.level.max(initial=0)) + 1), -1)  # each node's path from the root
        for x in names:
            down[self.index[x], : len(up[x])] = [self.index[y] for y in up[x][::-1]]
        shared = np.cumprod((down[:, None] == down[None]) & (down[:, None] >= 0), axis=2).sum(2)
        self.lca = down[np.arange(n)[:, None], shared - 1].astype(np.int32)
        self.depth = max(map(len, self.paths.values())) - 1


class Space:
    """Rows as category codes and numbers, with their generalisations."""

    def __init__(self, cats: np.ndarray, nums: np.ndarray, trees: list[Tree], ranges: np.ndarray):
        self.cats, self.nums, self.trees, self.ranges = cats, nums, trees, np.where(ranges > 0, ranges, 1.0)

    def start(self, i: int):
        return self.cats[i].copy(), self.nums[i].copy(), self.nums[i].copy()

    def ncp(self, cat: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The penalty of generalisations, one per row."""
        out = ((hi - lo) / self.ranges).sum(-1) if self.nums.shape[1] else np.zeros(len(cat))
        for j, t in enumerate(self.trees):
            out = out + t.width[cat[..., j]]
        return out

    def joined(self, g, rows: np.ndarray):
        """The generalisation of g with each of the rows."""
        cat = np.stack(
            [t.lca[g[0][j], self.cats[rows, j]] for j, t in enumerate(self.trees)],
            -1,
        ) if self.trees else np.zeros((len(rows), 0), int)
        return cat, np.minimum(g[1], self.nums[rows]), np.maximum(g[2], self.nums[rows])

    def add(self, g, i: int):
        cat, lo, hi = self.joined(g, np.array([i]))
        return cat[0], lo[0], hi[0]

    def distance(self, g, rows: np.ndarray) -> np.ndarray:
        return 2 * self.ncp(*self.joined(g, rows))


def _first(values: np.ndarray) -> int:
    return int(np.argmin(np.round(values, 12)))


class _Clusters:
    """Generalisations of all clusters side by side."""

    def __init__(self, space: Space, gens: list):
        self.space = space
        self.cat, self.lo, self.hi = (np.array([g[k] for g in gens]) for k in range(3))

    def nearest(self, i: int, of: np.ndarray | None = None) -> int:
        """The cluster nearest to row i, of those given; it widens to take the row."""
        s = self.space
        of = np.arange(len(self.lo)) if of is None else of
        cat = np.stack(
            [t.lca[self.cat[of, j], s.cats[i, j]] for j, t in enumerate(s.trees)],
            -1,
        ) if s.trees else np.zeros((len(of), 0), int)
        lo, hi = np.minimum(self.lo[of], s.nums[i]), np.maximum(self.hi[of], s.nums[i])
        k = _first(2 * s.ncp(cat, lo, hi))
        c = int(of[k])
        self.cat[c], self.lo[c], self.hi[c] = cat[k], lo[k], hi[k]
        return c


def _rest(space: Space, label: np.ndarray, gens: list, todo: list[int]) -> _Clusters:
    """Rows left over go to the nearest cluster, which widens."""
    clusters = _Clusters(space, gens)
    for i in todo:
        label[i] = clusters.nearest(i)
    return clusters


def knn(space: Space, k: int, rng) -> np.ndarray:
    n = len(space.nums)
    label, left, gens = np.full(n, -1), np.arange(n), []
    while len(left) >= k:
        seed = left[rng.integers(len(left))]
        g = space.start(seed)
        others = left[left != seed]
        near = others[np.argsort(np.round(space.distance(g, others), 12), kind="stable")[: k - 1]]
        for i in near:
            g = space.add(g, i)
        label[[seed, *near]] = len(gens)
        gens.append(g)
        left = left[label[left] < 0]
    _rest(space, label, gens, left.tolist()) if gens else label.fill(0)
    return label


def kmember(space: Space, k: int, rng) -> np.ndarray:
    n = len(space.nums)
    label, left, gens = np.full(n, -1), np.arange(n), []
    seed = int(rng.integers(n)) if n else 0
    while len(left) >= k:
        d = np.round(space.distance(space.start(seed), left), 12)
        seed = int(left[len(d) - 1 - int(np.argmax(d[::-1]))])  # the last of the furthest
        g, size = space.start(seed), 1
        label[seed] = len(gens)
        left = left[left != seed]
        while size < k:
            increase = space.ncp(*space.joined(g, left)) * (size + 1) - space.ncp(*(x[None] for x in g))[0] * size
            i = int(left[_first(increase)])
            g, size = space.add(g, i), size + 1
            label[i] = len(gens)
            left = left[left != i]
        gens.append(g)
    _rest(space, label, gens, left.tolist()) if gens else label.fill(0)
    return label


def oka(space: Space, k: int, rng) -> np.ndarray:
    n = len(space.nums)
    m = max(1, n // k)
    if n < k:
        return np.zeros(n, int)
    seeds = rng.permutation(n)[:m]
    label = np.full(n, -1)
    gens = [space.start(i) for i in seeds]
    label[seeds] = np.arange(m)
    todo = [i for i in range(n) if label[i] < 0]
    wide = _rest(space, label, gens, todo)
    spare = []
    for c in range(m):  # the rows beyond k that are furthest from the centre leave
        own = np.flatnonzero(label == c)
        if len(own) > k:
            g = (wide.cat[c], space.nums[own].mean(0), space.nums[own].mean(0))
            order = own[np.argsort(np.round(space.distance(g, own), 12), kind="stable")]
            label[order[k:]] = -1
            spare += order[k:].tolist()
    gens = []
    for c in range(m):
        own = np.flatnonzero(label == c)
        g = space.start(own[0])
        for i in own[1:]:
            g = space.add(g, i)
        gens.append(g)
    size = np.bincount(label[label >= 0], minlength=m)
    clusters = _Clusters(space, gens)
    for i in sorted(spare):  # short clusters fill first
        short = np.flatnonzero(size < k)
        label[i] = clusters.nearest(i, short if len(short) else None)
        size[label[i]] += 1
    return label


def gccg(space: Space, k: int, rng) -> np.ndarray:
    """Centres by grade; its neighbours are the first rows at a distance below 1, or else the nearest."""
    n = len(space.nums)
    if n < k:
        return np.zeros(n, int)
    grade = (space.nums / k).sum(1) if space.nums.shape[1] else np.zeros(n)
    for j in range(len(space.trees)):
        grade = grade + (np.bincount(space.cats[:, j])[space.cats[:, j]] / n)
    order = np.argsort(-np.round(grade, 12), kind="stable")
    label, gens = np.full(n, -1), []
    ups = [_ups(t) for t in space.trees]
    for c in range(n // k):
        left = order[label[order] < 0]
        centre, others = left[0], left[1:]
        d = np.abs((space.nums[others] - space.nums[centre]) / space.ranges).sum(1)
        for j, t in enumerate(space.trees):
            d = d + ups[j][space.cats[others, j], space.cats[centre, j]] / max(1, t.depth)
        close = others[np.floor(d + 1e-12) == 0]
        near = close[: k - 1] if len(close) >= k - 1 else others[np.argsort(np.round(d, 12), kind="stable")[: k - 1]]
        g = space.start(centre)
        for i in near:
            g = space.add(g, i)
        label[[centre, *near]] = c
        gens.append(g)
    _rest(space, label, gens, np.flatnonzero(label < 0).tolist())
    return label


def _ups(t: Tree) -> np.ndarray:
    """Steps to the lowest common node, the larger of both sides."""
    at = t.level[t.lca]
    return np.maximum(t.level[:, None] - at, t.level[None] - at).astype(float)


METHODS = {"knn": knn, "kmember": kmember, "oka": oka, "gccg": gccg}


def anonymize(
    df: DataFrame,
    method: str,
    k: int,
    numeric: list[str],
    hierarchies: dict[str, dict[str, list[str]]],
    rid: str = "rid",
    block: str | None = None,
    seed: int = 0,
    domains: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """rid, block, cluster, size, ncp and the generalised columns: c_lo, c_hi for numbers, c for categories.

    hierarchies: root paths (leaf first) of each category's values. domains: the least and the
    largest value that a number can have; without it, those that it has.
    """
    if method not in METHODS:
        raise ValueError(f"no method {method}")
    cats = list(hierarchies)
    known = domains or {}
    seen = [c for c in numeric if c not in known]
    ranges = df.agg(*[(F.max(c) - F.min(c)).cast("double").alias(c) for c in seen]).first().asDict() if seen else {}
    span = np.array([known[c][1] - known[c][0] if c in known else ranges[c] or 0.0 for c in numeric], float)
    trees = [Tree(hierarchies[c]) for c in cats]
    rows = df.select(
        F.col(rid).cast("long").alias("rid"),
        (F.col(block).cast("string") if block else F.lit("")).alias("block"),
        *[F.col(c).cast("double").alias(c) for c in numeric],
        *[F.col(c).cast("string").alias(c) for c in cats],
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid").reset_index(drop=True)
        code = np.stack(
            [pdf[c].map(t.index).to_numpy(int) for c, t in zip(cats, trees, strict=True)],
            1,
        ) if cats else np.zeros((len(pdf), 0), int)
        space = Space(code, pdf[numeric].to_numpy(float), trees, span)
        label = METHODS[method](space, k, np.random.default_rng(seed))
        out = pd.DataFrame({"rid": pdf["rid"], "block": pdf["block"], "cluster": label})
        for c in numeric:
            out[f"{c}_lo"], out[f"{c}_hi"] = pdf.groupby(label)[c].transform("min"), pdf.groupby(label)[c].transform("max")
        general = np.zeros_like(code)
        for c in np.unique(label):
            own = np.flatnonzero(label == c)
            g = space.start(own[0])
            for i in own[1:]:
                g = space.add(g, i)
            general[own] = g[0]
        for j, c in enumerate(cats):
            out[c] = [trees[j].names[x] for x in general[:, j]]
        out["size"] = np.bincount(label, minlength=label.max() + 1)[label]
        lo, hi = (out[[f"{c}_{e}" for c in numeric]].to_numpy(float) for e in ("lo", "hi"))
        out["ncp"] = space.ncp(general, lo, hi)
        return out[names]

    names = ["rid", "block", "cluster", "size", "ncp", *[f"{c}_{e}" for c in numeric for e in ("lo", "hi")], *cats]
    kinds = ["long", "string", "long", "long", "double", *["double"] * (2 * len(numeric)), *["string"] * len(cats)]
    return rows.groupBy("block").applyInPandas(run, ", ".join(f"`{n}` {t}" for n, t in zip(names, kinds, strict=True)))


def global_ncp(result: DataFrame, n_columns: int) -> DataFrame:
    """The mean penalty per row and column, in percent."""
    return result.agg(F.round(F.lit(100.0) * F.sum("ncp") / F.count("*") / n_columns, 6).alias("ncp"))
