"""Tracks as numpy arrays, a file a chromosome and kind, behind one table of where each begins."""

from __future__ import annotations

import io
import itertools
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.sources import sinks
from locusflow.sources.files import located, spread, written

C = F.col
VALUES = 1 << 20
META = "npy_meta.json"
KINDS = ("start", "core", "end")


def _fill(out, lengths: np.ndarray, values: np.ndarray, most: int) -> None:
    """Writes each value as often as its length says, at most so many at once."""
    last = np.cumsum(lengths)
    total, done = int(last[-1]) if len(last) else 0, 0
    while done < total:
        upto = min(total, done + most)
        i, j = np.searchsorted(last, done, "right"), np.searchsorted(last, upto, "left") + 1
        held = np.minimum(last[i:j], upto) - np.maximum(last[i:j] - lengths[i:j], done)
        out.write(np.repeat(values[i:j], held).astype("<u4").tobytes())
        done = upto


def _write(folder: str, most: int):
    def write(frames):
        rows = (r for f in frames for r in f.itertuples(index=False))
        for (kind, chr_), group in itertools.groupby(rows, key=lambda r: (r.kind, r.chr)):
            at = None
            with written(f"{folder}/{chr_}_{kind}.npy") as out:
                while held := list(itertools.islice(group, 50_000)):
                    if at is None:
                        first, end = held[0].first, held[0].last
                        at, head = first, io.BytesIO()
                        np.lib.format.write_array_header_1_0(head, {"descr": "<u4", "fortran_order": False, "shape": (end - first,)})
                        out.write(head.getvalue())
                    start, stop, count = (np.array([getattr(r, n) for r in held], "int64") for n in ("start", "end", "count"))
                    lengths, values = np.empty(2 * len(held), "int64"), np.zeros(2 * len(held), "int64")
                    lengths[0::2], lengths[1::2], values[1::2] = start - np.concatenate([[at], stop[:-1]]), stop - start, count
                    _fill(out, lengths, values, most)
                    at = int(stop[-1])
                _fill(out, np.array([end - at]), np.zeros(1, "int64"), most)
            yield pd.DataFrame({"kind": [kind], "chr": [chr_], "first": [first]})

    return write


def npy(tracks: DataFrame, folder: str, sizes: DataFrame | None = None, step: int = 1, most: int = VALUES) -> None:
    """Runs (kind, chr, start, end, count) that don't meet, positions from 1, as
    folder/chr_kind.npy of unsigned 32-bit numbers and folder/npy_meta.json with
    the first position of each. A value a position that step divides, from the
    first covered one to the last, or to the size of the chromosome with sizes
    (chr, size). A task writes a file as a stream of its sorted runs."""
    x = tracks.select("kind", "chr", F.ceil(C("start") / step).alias("start"), F.ceil(C("end") / step).alias("end"), "count").filter("end > start")
    bounds = x.groupBy("kind", "chr").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    if sizes is not None:
        bounds = bounds.join(sizes, "chr", "left").withColumn("last", F.greatest("last", F.floor(C("size") / step) + 1)).drop("size")
    y = x.join(bounds, ["kind", "chr"]).repartition("kind", "chr").sortWithinPartitions("kind", "chr", "start")
    meta: dict[str, dict[str, int]] = {}
    for r in y.mapInPandas(_write(folder, most), "kind string, chr string, first long").collect():  # a row a file
        meta.setdefault(r["chr"], {"stepsize": step})[r["kind"]] = r["first"] * step
    with written(f"{folder}/{META}") as out:
        out.write(json.dumps(meta, sort_keys=True).encode())


def _read(frames):
    for f in frames:
        for path, chr_, kind, first, step, i, n in f.itertuples(index=False):
            system, inside = located(path)
            with system.open_input_file(inside) as file:
                file.seek(i)
                v = np.frombuffer(file.read(4 * n), "<u4")
            at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            runs = pd.DataFrame({"kind": kind, "chr": chr_, "start": first + at, "end": first + np.append(at[1:], len(v)), "count": v[at].astype("int64"), "step": step})
            yield runs[runs["count"] != 0]


def _slices(most: int):
    def slices(frames):
        for f in frames:
            for path, chr_, kind, first, step in f.itertuples(index=False):
                system, inside = located(path)
                with system.open_input_file(inside) as file:
                    if np.lib.format.read_magic(file) != (1, 0):
                        raise ValueError(f"{path}: not an array file of version 1.0")
                    (n,), _, kind_of = np.lib.format.read_array_header_1_0(file)
                    if kind_of != np.dtype("<u4"):
                        raise ValueError(f"{path}: not an array of unsigned 32-bit numbers")
                    head = file.tell()
                i = np.arange(0, n, most)
                yield pd.DataFrame({"path": path, "chr": chr_, "kind": kind, "first": first // step + i, "step": step, "at": head + 4 * i, "n": np.minimum(most, n - i)})

    return slices


def npy_tracks(spark: SparkSession, folder: str, most: int = VALUES) -> DataFrame:
    """(kind, chr, start, end, count, step) of a folder that npy() wrote: runs other
    than 0, in steps, cut where pieces of so many values are. Pieces are read by many tasks."""
    system, inside = located(f"{folder}/{META}")
    with system.open_input_stream(inside) as f:
        meta = json.loads(f.read())
    names = [(f"{folder}/{c}_{k}.npy", c, k, int(m[k]), int(m["stepsize"])) for c, m in meta.items() for k in m if k != "stepsize"]
    if not names:
        return spark.createDataFrame([], "kind string, chr string, start long, end long, count long, step long")
    files = spread(spark.createDataFrame(names, "path string, chr string, kind string, first long, step long"), min(len(names), 256))
    pieces = files.mapInPandas(_slices(most), "path string, chr string, kind string, first long, step long, at long, n long")
    return spread(pieces, 4 * spark.sparkContext.defaultParallelism).mapInPandas(_read, "kind string, chr string, start long, end long, count long, step long")


def npy_to_wig(spark: SparkSession, folder: str, path: str) -> None:
    """path/kind: fixed-step blocks of the positions that aren't 0, for each kind there is."""
    tracks = npy_tracks(spark, folder)
    there = {(r["kind"], r["step"]) for r in tracks.select("kind", "step").distinct().collect()}  # at most a few kinds
    for kind, step in sorted(there):
        sinks.wig(tracks.filter(C("kind") == kind).drop("kind", "step"), f"{path}/{kind}", step=step)
