"""Exact top-k inner products of integer vectors by norm-bucketed retrieval.

Vectors are dealt to shards by ranges of length, so that a query reaches the
shards of the longest ones first and skips those that are too short. A shard sorts its vectors by length and cuts them into buckets, longest first.
For a query with k-th score so far T, a vector of a bucket with largest length
L needs a cosine of at least t = T / (|q| L). If t is above 1, this bucket and
all later ones are done. Otherwise, if t is low, vectors are pruned by length:
only a prefix of the bucket has |p| >= T / |q|. If t is high, they are pruned by
coordinates: with f the query's largest coordinates (unit length), a unit vector
with cosine t or more has p_f in q_f t +- sqrt((1 - t^2)(1 - q_f^2)). What is
left is verified with whole integer products. Bounds carry a slack for rounding
and only skip what is strictly below T, so ties are kept.

Defined cases: vectors null or with null or non-finite components take no part,
zero vectors do; copies tie, and the smaller id comes first; rows that share a
query's id are its own. Products of a query are whole in doubles if its length
times the largest one of the shard is below 2^53; else candidates are taken with a
margin for rounding and verified in Python integers. Scores beyond 64 bits are
ranked in their shard as they are and returned as the largest or smallest long.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm.blocks import SHARD_ROWS, TopK, block_search, valid_vectors

BUCKET, FOCUS = 256, 3
#: Local cosine threshold from which coordinates prune more than lengths cost.
COORDINATES_FROM = 0.5
SCALE = 256


def build(ids: np.ndarray, x: np.ndarray) -> dict:
    """Longest first; each bucket keeps unit vectors for coordinate pruning."""
    with np.errstate(over="ignore"):
        length = np.sqrt(np.einsum("ij,ij->i", x, x))
    order = np.lexsort((ids, -length))
    ids, x, length = ids[order], x[order], length[order]
    unit = x / np.where(length > 0, length, 1)[:, None]
    return {"ids": ids, "x": x, "length": length, "unit": np.ascontiguousarray(unit.T)}


LONG = (1 << 63) - 1


def _exact(index: dict, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    return index["x"][rows] @ q


def search_whole(index: dict, own: int, q: np.ndarray, length: float, k: int) -> list[tuple[int, int]]:
    """(score, vec_id) of one query whose products may not be whole in doubles."""
    whole, best = [int(c) for c in q], []
    for start in range(0, len(index["ids"]), BUCKET):
        stop, longest = min(len(index["ids"]), start + BUCKET), float(index["length"][start])
        least = float(max(-LONG, min(LONG, best[k - 1][0]))) if len(best) == k else -np.inf
        if length * longest * (1 + 1e-9) < least:
            break
        with np.errstate(over="ignore", invalid="ignore"):
            rough, margin = index["x"][start:stop] @ q, 4 * len(q) * np.finfo(float).eps * length * longest
            rows = start + np.flatnonzero(~(rough + margin < least) & (index["ids"][start:stop] != own))
        for r in rows:
            best.append((sum(a * int(b) for a, b in zip(whole, index["x"][r])), int(index["ids"][r])))
        best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
    return best


def search(index: dict, ids: np.ndarray, q: np.ndarray, k: int, stats: dict | None = None) -> tuple:
    """search_doubles() for queries whose products are whole in doubles, search_whole() for the others."""
    with np.errstate(over="ignore"):
        lengths = np.sqrt(np.einsum("ij,ij->i", q, q))
    large = lengths * index["length"][0] >= 2**53
    small = np.flatnonzero(~large)
    at, vec, score = search_doubles(index, ids[small], q[small], k, stats)
    parts = [(small[at], vec, score)]
    for i in np.flatnonzero(large):
        found = search_whole(index, int(ids[i]), q[i], float(lengths[i]), k)
        parts.append((np.full(len(found), i), np.array([v for _, v in found], np.int64), np.array([max(-LONG - 1, min(LONG, s)) for s, _ in found], np.int64)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def search_doubles(index: dict, ids: np.ndarray, q: np.ndarray, k: int, stats: dict | None = None) -> tuple:
    best, n = TopK(len(q), k), len(index["ids"])
    lengths = np.sqrt(np.einsum("ij,ij->i", q, q))
    slack = 1e-9
    for start in range(0, n, BUCKET):
        stop, longest = min(n, start + BUCKET), index["length"][start]
        shortest = index["length"][stop - 1]
        threshold = best.least(slice(None))
        possible = np.flatnonzero(lengths * longest * (1 + slack) >= threshold)
        if not len(possible):
            break
        t = np.full(len(possible), -1.0)
        product = lengths[possible] * longest
        np.divide(threshold[possible], product, out=t, where=product > 0)
        by_coordinate = t >= COORDINATES_FROM
        whole = possible[~by_coordinate]
        if len(whole):  # by length: rows from the first too short one on can't reach the threshold
            need = np.divide(best.least(whole), lengths[whole], out=np.full(len(whole), -np.inf), where=lengths[whole] > 0) * (1 - slack)
            width = np.searchsorted(-index["length"][start:stop], -need, side="right") if shortest < longest else np.full(len(whole), stop - start)
            reach = int(width.max())
            scores = q[whole] @ index["x"][start : start + reach].T
            scores[index["ids"][None, start : start + reach] == ids[whole][:, None]] = -np.inf
            best.add(whole, scores, index["ids"][start : start + reach])
            if stats is not None:
                stats["length"] = stats.get("length", 0) + int(width.sum())
        for at, cosine in zip(possible[by_coordinate], t[by_coordinate]):
            unit, c = q[at] / lengths[at], min(1.0, cosine)
            keep = np.ones(stop - start, bool)
            for f in np.argsort(-np.abs(unit))[:FOCUS]:
                half = np.sqrt(max(0.0, (1 - c * c) * (1 - unit[f] ** 2))) + 1e-7
                column = index["unit"][f, start:stop]
                low, high = (-2.0, unit[f] * c + half) if -unit[f] >= c else (unit[f] * c - half, 2.0 if unit[f] >= c else unit[f] * c + half)
                keep &= (column >= low) & (column <= high)
            rows = start + np.flatnonzero(keep)
            rows = rows[index["ids"][rows] != ids[at]]
            if stats is not None:
                stats["coordinate"] = stats.get("coordinate", 0) + len(rows)
            if len(rows):
                best.add(np.array([at]), _exact(index, rows, q[at])[None], index["ids"][rows])
    at, vec, score = best.found()
    return at, vec, np.rint(score).astype(np.int64)


def top_products(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, scale: int = SCALE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k largest products of floor(scale * x)."""
    vectors = valid_vectors(df, id_col, vector_col, nonzero=False)
    # doubles of 2^52 or more are whole, and may be too large for floor()
    scaled = F.transform("v", lambda x: x * F.lit(float(scale)))
    whole = F.transform(scaled, lambda y: F.when(F.abs(y) < float(2**52), F.floor(y).cast("double")).otherwise(y))
    vectors = vectors.withColumn("v", whole)
    out = block_search(vectors, every, k, build, search, "long", shard_rows, by="length")
    return out.withColumn("rank", F.col("rank").cast("int"))
