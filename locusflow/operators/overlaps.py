"""Joins on overlap and nearness. Queries and subjects are (chr, start, end, …);
queries need a column id that tells their rows apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusflow.operators.primitives import SWEEP_BIN, asof, carried, iv_join
from locusflow.operators.ranges import midpoint

C = F.col


def zero():
    return F.lit(0).cast("long")


def find_overlaps(q: DataFrame, s: DataFrame, min_overlap: int = 1) -> DataFrame:
    """(id, ids): of each query the sorted ids of the subjects that it overlaps."""
    hits = iv_join(q.select("chr", "start", "end", "id"), s.select("chr", "start", "end", "id"), min_overlap=min_overlap)
    lists = hits.groupBy(C("q_id").alias("id")).agg(F.array_sort(F.collect_set("s_id")).alias("ids"))
    return q.select("id").join(lists, "id", "left").select("id", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))


def count_overlaps(q: DataFrame, s: DataFrame, min_overlap: int = 1) -> DataFrame:
    """(id, n). Pairs are counted before they are shuffled."""
    n = iv_join(q.select("chr", "start", "end", "id"), s.select("chr", "start", "end"), min_overlap=min_overlap).groupBy(C("q_id").alias("id")).agg(F.count("*").alias("n"))
    return q.select("id").join(n, "id", "left").select("id", F.coalesce("n", zero()).alias("n"))


def any_overlaps(q: DataFrame, s: DataFrame, min_overlap: int = 1) -> DataFrame:
    return count_overlaps(q, s, min_overlap).select("id", (C("n") > 0).alias("hit"))


def subset_by_overlaps(s: DataFrame, q: DataFrame) -> DataFrame:
    """The distinct coordinates of s that some row of q overlaps."""
    return iv_join(s.select("chr", "start", "end"), q.select("chr", "start", "end")).select("chr", C("q_start").alias("start"), C("q_end").alias("end")).distinct()


def not_overlapping(q: DataFrame, s: DataFrame) -> DataFrame:
    hits = iv_join(q.select("chr", "start", "end", "id"), s.select("chr", "start", "end")).select(C("q_id").alias("id"))
    return q.join(hits, "id", "left_anti").select(*q.columns)


def closest(q: DataFrame, s: DataFrame, size: int = SWEEP_BIN) -> DataFrame:
    """(id, distance) to the nearest row of s, 0 for overlaps and neighbours that
    touch. Queries on chromosomes that s lacks are dropped.
    One sweep meets each query at its end: of the rows that start before it, the
    largest end is beyond the query's start if one of them overlaps, else it is
    the nearest at the left; the least start from there on is the nearest at the right."""
    rows = q.select("chr", C("end").alias("pos"), C("start").alias("from"), "id").withColumn("__q", F.lit(True))
    x = rows.unionByName(s.select("chr", C("start").alias("pos"), C("end").alias("s_end")), allowMissingColumns=True)
    x = carried(x, ["chr"], "pos", size, {"end": F.max("s_end"), "start": F.min(F.when(C("__q").isNull(), C("pos")))}, {"__l": ("end", "max"), "__r": ("start", "next")})
    w, back = Window.partitionBy("chr", "__bin").orderBy("pos"), Window.partitionBy("chr", "__bin").orderBy(C("pos").desc())
    before = F.greatest(F.max("s_end").over(w.rangeBetween(Window.unboundedPreceding, -1)), C("__l"))
    after = F.least(F.min(F.when(C("__q").isNull(), C("pos"))).over(back.rangeBetween(Window.unboundedPreceding, 0)), C("__r"))
    x = x.withColumn("before", before).withColumn("after", after).filter("__q")
    d = F.least(F.when(C("before").isNotNull(), F.greatest(C("from") - C("before"), zero())), C("after") - C("pos"))
    return x.select("id", d.alias("distance")).filter("distance is not null")


def feature_distances(q: DataFrame, features: DataFrame) -> DataFrame:
    """(id, distance): signed, of the nearest feature midpoint to the query's; a
    tie is the left one. Null where the chromosome has no feature."""
    return _signed(q, features, "id")


def _signed(q: DataFrame, features: DataFrame, *columns: str) -> DataFrame:
    x = asof(q.select("chr", *columns, midpoint().alias("mid")), features.select("chr", midpoint().alias("pos")), ["chr"], "mid")
    l, r = C("__before") - C("mid"), C("__after") - C("mid")
    return x.select(*columns, F.when(r.isNull() | (F.abs(l) <= r), l).otherwise(r).alias("distance"))


def median_distance(q: DataFrame, features: DataFrame, size: int = SWEEP_BIN) -> DataFrame:
    """(median_abs_distance), one row: null if no query has a distance. Distances
    are counted, and the middle one or two looked up in their order, as an exact
    percentile would hold all distinct ones in a task."""
    d = _signed(q, features).select(F.abs("distance").alias("d")).filter("d is not null").groupBy("d").agg(F.count("*").alias("n"))
    x = carried(d, [], "d", size, {"n": F.sum("n")}, {"__before": ("n", "sum"), "__after": ("n", "rest")})
    w = Window.partitionBy("__bin").orderBy("d")
    last = F.coalesce("__before", zero()) + F.sum("n").over(w)
    total = F.coalesce("__before", zero()) + F.coalesce("__after", zero()) + F.sum("n").over(Window.partitionBy("__bin"))
    x = x.select("d", last.alias("last"), (last - C("n") + 1).alias("first"), F.floor((total + 1) / 2).alias("lo"), F.floor((total + 2) / 2).alias("hi"))
    # of an odd number both are the middle one, so the mean of what holds them is the median
    return x.filter("first <= hi and last >= lo").agg(F.avg("d").alias("median_abs_distance"))


def tss_distances(q: DataFrame, tss: DataFrame, sentinel: bool = False) -> DataFrame:
    out = feature_distances(q, tss).select("id", F.abs("distance").alias("distance"))
    return out.fillna({"distance": 4294967295}) if sentinel else out


def hits_per_set(q: DataFrame, sets: DataFrame, min_overlap: int = 1) -> DataFrame:
    """(set_id, pairs, queries): of each set that is hit, its overlaps and the queries that hit it."""
    per = iv_join(q.select("chr", "start", "end", "id"), sets.select("chr", "start", "end", "set_id"), min_overlap=min_overlap)
    per = per.groupBy(C("s_set_id").alias("set_id"), "q_id").agg(F.count("*").alias("n"))
    return per.groupBy("set_id").agg(F.sum("n").alias("pairs"), F.count("*").alias("queries"))
