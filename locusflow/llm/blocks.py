"""Queries against all vectors in blocks: what both vector searches share.

Vectors are dealt to cells, by the nearest of some pivots or by length, and a
cell to shards of bounded size by a hash, so copies of a vector spread. Each shard
becomes one index row. A query is searched first in one shard of its home cell;
its k-th score there is a threshold. It is then sent only to the shards of cells
that may hold a larger product: q.x is at most q.c + |q| r in a cell around c with
radius r, and at most |q| times the cell's largest length. Each (shard, block of
queries) is one group of a co-grouped job: no task holds more than a shard and a
block. Only the cells' centres, radii and lengths (MOST_CELLS rows for each
dimension at most, whatever the size of the table) go to the driver and are broadcast.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusflow.llm.common import hash_sample, materialize, prepare

SHARD_ROWS, BLOCK_QUERIES, MOST_CELLS = 8192, 8192, 2048


def valid_vectors(df: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> DataFrame:
    """(vec_id, v: array<double>) without nulls and non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    out = df.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter("vec_id is not null and size(v) > 0")
    out = out.filter("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    return out.filter("exists(v, x -> x <> 0)") if nonzero else out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _lengths(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt(np.einsum("ij,ij->i", x, x))


class Cells:
    """The cells of each dimension: centres (zeros where cells are by length), radii, largest lengths, shards."""

    def __init__(self, by: str, cuts: np.ndarray, pivots: dict[int, np.ndarray]):
        self.by, self.cuts, self.pivots = by, cuts, pivots
        self.table: dict[int, tuple[np.ndarray, ...]] = {}

    def assign(self, dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, distance from its centre, length) of vectors of one dimension."""
        length = _lengths(x)
        if self.by == "length" or dim not in self.pivots:
            cell = np.searchsorted(self.cuts, length, side="right") if self.by == "length" else np.zeros(len(x), np.int64)
            return cell, length, length
        c = self.pivots[dim]
        cell = np.argmin(np.einsum("ij,ij->i", c, c)[None] - 2 * x @ c.T, axis=1)
        return cell, _lengths(x - c[cell]), length

    def fill(self, rows: list) -> None:
        """rows: (dim, cell, n, radius, longest)."""
        for dim in {r["dim"] for r in rows}:
            own = sorted((r for r in rows if r["dim"] == dim), key=lambda r: r["cell"])
            at = np.array([r["cell"] for r in own])
            centre = self.pivots[dim][at] if self.by == "pivot" and dim in self.pivots else np.zeros((len(own), dim))
            self.table[dim] = (at, centre, *(np.array([r[k] for r in own], np.float64) for k in ("radius", "longest")))

    def bounds(self, dim: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells, for each query and cell the largest product there may be)."""
        at, centre, radius, longest = self.table[dim]
        length = _lengths(q)[:, None]
        with np.errstate(over="ignore", invalid="ignore"):
            most = np.minimum(q @ centre.T + length * radius, length * longest)
        return at, np.where(np.isnan(most), np.inf, most * (1 + np.sign(most) * 1e-9) + 1e-9)

    def home(self, dim: int, q: np.ndarray) -> np.ndarray:
        at, centre, _, longest = self.table[dim]
        return at[np.argmax(q @ centre.T, axis=1)] if self.by == "pivot" else np.full(len(q), at[np.argmax(longest)])


def _cells(vectors: DataFrame, by: str, shard_rows: int) -> Cells:
    """Pivots are a fixed sample of vectors (those of the smallest hashes); lengths are cut at quantiles."""
    total = vectors.count()
    wanted = min(MOST_CELLS, max(1, -(-total // shard_rows)))
    if by == "length":
        length = vectors.select(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("l"))
        cuts = length.approxQuantile("l", [i / wanted for i in range(1, wanted)], 1e-3) if wanted > 1 else []
        return Cells(by, np.unique(np.array(cuts, np.float64)), {})
    rows = hash_sample(vectors.select("dim", "v", "vec_id"), [F.col("v"), F.col("vec_id")], wanted, total).collect()
    own: dict[int, list] = {}
    for r in rows:
        own.setdefault(r["dim"], []).append(r["v"])
    return Cells(by, np.empty(0), {d: np.unique(np.array(v, np.float64), axis=0) for d, v in own.items()})


def block_search(vectors: DataFrame, every: int, k: int, build: Callable[[np.ndarray, np.ndarray], object], search: Callable[..., tuple], score_type: str, shard_rows: int = SHARD_ROWS, by: str = "pivot") -> DataFrame:
    """The k best rows for each row whose vec_id is divisible by every.

    build(ids, matrix) makes a shard's index; search(index, query ids, queries)
    gives arrays (query position, vec_id, score). Only vectors of the same
    dimension are compared. Rows that share vec_id with a query are its own.
    Equal query rows are one query.
    """
    spark = vectors.sparkSession
    prepare(spark)
    vectors = materialize(vectors.withColumn("dim", F.size("v")).withColumn("n", F.monotonically_increasing_id()), "vectors")
    cells = _cells(vectors, by, shard_rows)
    dealt = spark.sparkContext.broadcast(cells)

    def each_dim(dims: pd.Series):
        d = dims.to_numpy()
        return ((int(x), np.flatnonzero(d == x)) for x in np.unique(d))

    @F.pandas_udf("struct<cell:bigint,radius:double,longest:double>")
    def assign(dim: pd.Series, v: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"cell": np.zeros(len(v), np.int64), "radius": 0.0, "longest": 0.0})
        for d, rows in each_dim(dim):
            out.loc[rows, "cell"], out.loc[rows, "radius"], out.loc[rows, "longest"] = dealt.value.assign(d, _matrix(v.iloc[rows]))
        return out

    rows = materialize(vectors.withColumn("x", assign("dim", "v")).select("dim", "vec_id", "v", "n", "x.*"), "cells")
    per = materialize(rows.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("radius").alias("radius"), F.max("longest").alias("longest")), "sizes")
    cells.fill(per.collect())  # at most MOST_CELLS rows a dimension
    routed = spark.sparkContext.broadcast(cells)
    splits = per.select("dim", "cell", F.ceil(F.col("n") / shard_rows).alias("shards"))
    keys = ["dim", "cell", "shard"]

    def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        index = build(pdf["vec_id"].to_numpy(np.int64), _matrix(pdf["v"]))
        return pdf[keys].iloc[:1].assign(index=[pickle.dumps(index, protocol=5)])

    rows = rows.join(splits, ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("n"), "shards"))
    index = materialize(rows.select(*keys, "vec_id", "v").groupBy(*keys).applyInPandas(build_shard, "dim int, cell long, shard long, index binary"), "index")
    queries = vectors.filter(F.col("vec_id") % every == 0).select("dim", F.col("vec_id").alias("query_id"), F.col("v").alias("q")).distinct()
    queries = materialize(queries.withColumn("qn", F.monotonically_increasing_id()), "queries")

    def run(block_keys: tuple, index_rows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(index_rows) or not len(block):
            return pd.DataFrame({"qn": [], "query_id": [], "vec_id": [], "score": []})
        ids = block["query_id"].to_numpy(np.int64)
        at, vec, score = search(pickle.loads(index_rows["index"].iloc[0]), ids, _matrix(block["q"]), k)
        return pd.DataFrame({"qn": block["qn"].to_numpy(np.int64)[at], "query_id": ids[at], "vec_id": vec, "score": score})

    def searched(routes: DataFrame) -> DataFrame:
        """routes: (keys, qn). Results of each query in each of its shards."""
        routes = materialize(routes, "routes")
        blocks = materialize(routes.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("blocks")), "blocks")
        left = index.join(blocks, keys).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        right = routes.join(blocks, keys).withColumn("block", F.pmod(F.xxhash64("qn"), "blocks")).join(queries.drop("dim"), "qn")
        by_block = [*keys, "block"]
        right = right.select(*by_block, "qn", "query_id", "q")
        return materialize(left.select(*by_block, "index").groupBy(*by_block).cogroup(right.groupBy(*by_block)).applyInPandas(run, f"qn long, query_id long, vec_id long, score {score_type}"), "found")

    @F.pandas_udf("long")
    def home(dim: pd.Series, q: pd.Series) -> pd.Series:
        out = np.zeros(len(q), np.int64)
        for d, at in each_dim(dim):
            out[at] = routed.value.home(d, _matrix(q.iloc[at]))
        return pd.Series(out)

    @F.pandas_udf("array<long>")
    def reach(dim: pd.Series, q: pd.Series, least: pd.Series) -> pd.Series:
        """Cells that may hold products of least or more; all where it is null."""
        out = pd.Series([None] * len(q), dtype=object)
        floor = least.fillna(-np.inf).to_numpy(np.float64)
        for d, at in each_dim(dim):
            cell, most = routed.value.bounds(d, _matrix(q.iloc[at]))
            for i, row in zip(at, most):
                out.iat[i] = cell[row >= floor[i] - abs(floor[i]) * 1e-12 if np.isfinite(floor[i]) else row > -np.inf].tolist()
        return out

    homes = queries.select("qn", "dim", home("dim", "q").alias("cell")).join(splits, ["dim", "cell"])
    homes = materialize(homes.select("qn", *keys[:2], F.pmod(F.xxhash64("qn"), "shards").alias("shard")), "homes")
    first = searched(homes.select(*keys, "qn"))
    least = first.groupBy("qn").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("least"))
    more = queries.join(least, "qn", "left").select("qn", "dim", F.explode(reach("dim", "q", "least")).alias("cell")).join(splits, ["dim", "cell"])
    more = more.select("qn", "dim", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    found = first.unionByName(searched(more.join(homes, ["qn", *keys], "left_anti").select(*keys, "qn")))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class TopK:
    """The k best (score, vec_id) of each of n queries, ties to smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.ids = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def least(self, at) -> np.ndarray:
        return self.score[at, -1]

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """at: query positions; scores: a row for each of them, a column for each id; -inf is none."""
        if scores.shape[1] > 4 * self.k:  # those below the k-th best, ties aside, can go
            kth = np.partition(scores, -self.k, axis=1)[:, -self.k]
            wide = np.maximum(kth, self.score[at, -1])
            keep = (scores >= wide[:, None]).any(axis=0)
            scores, ids = scores[:, keep], ids[keep]
        if not scores.shape[1]:
            return
        s = np.concatenate([self.score[at], scores], axis=1)
        i = np.concatenate([self.ids[at], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[at], self.ids[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, col = np.nonzero(self.score > -np.inf)
        return at, self.ids[at, col], self.score[at, col]
