"""Coverage tracks as runs: difference events, running sums, no row per position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.operators.primitives import segments
from locusflow.operators.statistics import neighbours

C = F.col


def _events(df: DataFrame, up, down, score) -> DataFrame:
    rows = F.explode(F.array(F.struct(up.alias("pos"), score.alias("d")), F.struct(down.alias("pos"), (-score).alias("d"))))
    return df.select("chr", rows.alias("x")).select("chr", "x.pos", "x.d")


def core_events(df: DataFrame, score=None) -> DataFrame:
    """Positions start + 1 to end - 1, from 1."""
    return _events(df, C("start") + 1, C("end"), F.lit(1).cast("long") if score is None else score)


def point_events(df: DataFrame, side: str, smooth: int, score=None) -> DataFrame:
    """A window of smooth positions around each start (from 1) or end."""
    p = C("start") + 1 if side == "start" else C("end")
    return _events(df, F.greatest(F.lit(1).cast("long"), p - smooth), p + smooth + 1, F.lit(1).cast("long") if score is None else score)


def runs(events: DataFrame) -> DataFrame:
    """(chr, start, end, count): positions start to end - 1 have this count, not 0; neighbours differ."""
    return segments(events, ["chr"], ["d"], turns=True).filter("d <> 0").select("chr", "start", "end", C("d").alias("count"))


def fixed_step(track: DataFrame, step: int = 1) -> DataFrame:
    """(chr, pos, count) at positions that step divides; as many rows as positions covered."""
    first = F.ceil(C("start") / step) * step
    return track.filter(first < C("end")).select("chr", F.explode(F.sequence(first, C("end") - 1, F.lit(step).cast("long"))).alias("pos"), "count")


def filled(track: DataFrame, max_gap: int) -> DataFrame:
    """The track with runs of 0 between neighbouring runs of a chromosome: none for
    0, those of up to max_gap positions, or all for -1."""
    if max_gap == 0:
        return track
    gaps = neighbours(track).select("chr", C("end").alias("start"), C("after").alias("end"), F.lit(0).cast(track.schema["count"].dataType).alias("count")).filter("end > start")
    return track.unionByName(gaps if max_gap < 0 else gaps.filter(C("end") - C("start") <= max_gap))
