"""Approximate nearest neighbours by inner product: a vantage-point tree a shard.

Largest inner products become nearest neighbours when every vector gets one more
component, sqrt(M^2 - |x|^2) with M the shard's largest length (0 for queries):
then |q - x|^2 = |q|^2 + M^2 - 2 q.x. A tree splits its rows at the median
distance to a vantage point and keeps the least and largest distance of each
half. By the triangle inequality a half whose distances are in [lo, hi] is at
least max(lo - d, d - hi) from a query at distance d of the vantage point; a
leaf's bound is the largest on its path. The leaves with the least bounds are
visited first, and a leaf is skipped if factor * bound is above the k-th
distance so far. factor 1 gives exact search; larger ones prune more. Unless a
factor is given, each shard takes the largest that keeps recall on trial queries.

Defined cases: vectors that are null, zero or hold null or non-finite components
take no part; queries without candidates give no rows; copies of a vector tie,
and the smaller id comes first; rows that share a query's id are its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm.blocks import SHARD_ROWS, TopK, block_search, valid_vectors

LEAF, FIRST = 64, 3
#: Factors that are tried on each shard, and the recall that the first good one reaches for
#: TRIAL of its rows as queries. On the 10,000 test vectors of 64 components, which hardly
#: cluster, factor 2 visits 98 % of leaves, 6 visits 86 % (recall 0.96), 8 visits 64 % (0.84).
FACTORS, TARGET, TRIAL = (8.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.5), 0.95, 64


def build(ids: np.ndarray, x: np.ndarray) -> dict:
    """Rows in leaf order, and for each node its vantage row and the ranges of its halves."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    square = np.einsum("ij,ij->i", x, x)
    top = float(square.max())
    lifted = np.concatenate([x, np.sqrt(np.maximum(0, top - square))[:, None]], axis=1)
    rng = np.random.default_rng(len(ids))
    rows, leaves, paths, vantage, ranges = [], [], [], [], []

    def split(part: np.ndarray, path: list[tuple[int, int]]) -> None:
        if len(part) <= LEAF:
            start = sum(map(len, rows))
            leaves.append((start, start + len(part)))
            rows.append(np.sort(part))
            paths.append(path)
            return
        # of a few random rows, the vantage point with the widest spread of distances
        tries = rng.choice(part, 5, replace=False)
        sample = lifted[rng.choice(part, min(len(part), 256), replace=False)]
        best = max(tries, key=lambda t: np.linalg.norm(sample - lifted[t], axis=1).std())
        d = np.linalg.norm(lifted[part] - lifted[best], axis=1)
        by = np.argsort(d, kind="stable")
        half = len(part) // 2
        node = len(vantage)
        vantage.append(lifted[best])
        ranges.append(((d[by[0]], d[by[half - 1]]), (d[by[half]], d[by[-1]])))
        split(part[by[:half]], [*path, (node, 0)])
        split(part[by[half:]], [*path, (node, 1)])

    split(np.arange(len(ids)), [])
    at = np.concatenate(rows)
    return {"ids": ids[at], "x": x[at], "leaves": leaves, "paths": paths, "vantage": np.array(vantage), "ranges": np.array(ranges), "top": top}


def bounds(index: dict, q: np.ndarray) -> np.ndarray:
    """For each query and leaf, a distance that all rows of the leaf have at least."""
    out = np.zeros((len(q), len(index["leaves"])))
    if not len(index["vantage"]):
        return out
    v = index["vantage"]
    d = np.sqrt(np.maximum(0, np.einsum("ij,ij->i", q, q)[:, None] + np.einsum("ij,ij->i", v, v)[None] - 2 * q @ v[:, :-1].T))
    for leaf, path in enumerate(index["paths"]):
        for node, side in path:
            lo, hi = index["ranges"][node, side]
            np.maximum(out[:, leaf], np.maximum(lo - d[:, node], d[:, node] - hi), out=out[:, leaf])
    return out


def search(index: dict, ids: np.ndarray, q: np.ndarray, k: int, factor: float = 1.0, visits: list | None = None) -> tuple:
    """Each query first visits its FIRST nearest leaves, which gives it a k-th
    distance; then every leaf is visited by all queries that it isn't pruned for."""
    best, low = TopK(len(q), k), bounds(index, q)
    square = np.einsum("ij,ij->i", q, q) + index["top"]
    first = np.argsort(low, axis=1, kind="stable")[:, :FIRST]

    def visit(leaf: int, at: np.ndarray) -> None:
        a, b = index["leaves"][leaf]
        rough = q[at] @ index["x"][a:b].T
        rough[index["ids"][None, a:b] == ids[at][:, None]] = -np.inf
        row, col = np.nonzero((rough >= (best.least(at) - 1e-9 * (1 + square[at]))[:, None]) & (rough > -np.inf))
        if visits is not None:
            visits.append(len(at))
        if len(row):
            # those that may count are summed in one fixed order, so that copies tie exactly
            use, row = np.unique(row, return_inverse=True)
            scores = np.full((len(use), b - a), -np.inf)
            scores[row, col] = (q[at[use[row]]] * index["x"][a + col]).sum(axis=1)
            best.add(at[use], scores, index["ids"][a:b])

    for step in range(first.shape[1]):
        for leaf in np.unique(first[:, step]):
            visit(leaf, np.flatnonzero(first[:, step] == leaf))
    for leaf in range(len(index["leaves"])):
        # the k-th distance so far; the slack covers rounding
        reach = np.sqrt(np.maximum(0, square - 2 * best.least(slice(None)))) + 1e-6 * (1 + np.sqrt(square))
        at = np.flatnonzero((factor * low[:, leaf] <= reach) & ~(first == leaf).any(axis=1))
        if len(at):
            visit(leaf, at)
    return best.found()


def calibrated(index: dict, k: int) -> float:
    """The largest of FACTORS that finds TARGET of the exact results, else 1."""
    at = np.random.default_rng(0).permutation(len(index["ids"]))[:TRIAL]
    ids, q = index["ids"][at], index["x"][at]

    def found(factor: float) -> set:
        at, vec, _ = search(index, ids, q, k, factor)
        return set(zip(at.tolist(), vec.tolist()))

    exact = found(1.0)
    return next((f for f in FACTORS if len(found(f) & exact) >= TARGET * len(exact)), 1.0)


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, factor: float | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found. factor None: each shard finds its own."""
    def make(ids, x):
        index = build(ids, x)
        return index | {"factor": factor or calibrated(index, k)}

    def run(index, ids, q, k):
        return search(index, ids, q, k, index["factor"])

    out = block_search(valid_vectors(df, id_col, vector_col, nonzero=True), every, k, make, run, "double", shard_rows)
    return out.withColumn("rank", F.col("rank").cast("int"))
