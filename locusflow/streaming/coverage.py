"""Coverage of a stream of regions that comes in order of their starts.

The state of a chromosome is the depth so far and the ends that are still open,
so it is bounded by the depth of the data and not by their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from locusflow.operators.coverage import core_events, point_events

_OUT = "chr string, start long, end long, count long"
_STATE = "at long, depth long, pos array<long>, d array<long>"


def _sweep(at: int, depth: int, open_: dict[int, int], until: int | None) -> tuple[list[tuple[int, int, int]], int, int]:
    """Runs of the events before until (None: of all); those are taken out of open_."""
    out = []
    for p in sorted(p for p in open_ if until is None or p < until):
        if depth and p > at:
            out.append((at, p, depth))
        at, depth = p, depth + open_.pop(p)
    if until is not None and depth and until > at:
        out.append((at, until, depth))
    return out, at if until is None else max(at, until), depth


def coverage(regions: DataFrame, kind: str = "core", smooth: int = 0) -> DataFrame:
    """Append-mode runs (chr, start, end, count) of a streaming (chr, start,
    end); kind: core, start or end. Positions before the latest start are final.
    A row with a null end closes its chromosome. Runs are cut where batches are.
    Raises where a region starts before what is final."""
    marks = regions.filter("end is null").selectExpr("chr", "cast(null as long) as pos", "cast(0 as long) as d")
    rows = regions.filter("end is not null")
    # a region's first event is never before that of an earlier region, save for ends
    events = core_events(rows) if kind == "core" else point_events(rows, kind, smooth)
    seen = rows.selectExpr("chr", "start as pos", "cast(0 as long) as d")
    back = 0 if kind == "core" else smooth

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, depth, pos, d = state.get if state.exists else (0, 0, [], [])
        open_ = dict(zip(pos, d))
        close, latest, first = False, None, None
        for f in frames:
            close |= bool(f["pos"].isna().any())
            f = f.dropna(subset=["pos"])
            starts = f.loc[f["d"] == 0, "pos"]
            if len(starts):
                latest = max(int(starts.max()), latest or 0)
            f = f[f["d"] != 0]
            for p, n in f.groupby("pos")["d"].sum().items():
                open_[int(p)] = open_.get(int(p), 0) + int(n)
                first = int(p) if first is None else min(first, int(p))
        if first is not None and first < at:
            raise ValueError(f"{key[0]}: position {first} comes after {at} was final; sort the regions by start")
        # the next region starts at latest or later, so its first event is at latest + 1 - smooth or later
        until = None if close else (at if latest is None else max(at, latest + 1 - back))
        runs, at, depth = _sweep(at, depth, open_, until)
        if close:
            state.remove()
        else:
            state.update((at, depth, list(open_), list(open_.values())))
        yield pd.DataFrame([(key[0], *r) for r in runs], columns=["chr", "start", "end", "count"])

    stream = events.unionByName(seen).unionByName(marks)
    return stream.groupBy("chr").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
