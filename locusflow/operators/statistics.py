"""Statistics of region sets, and of lists of sets (set_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusflow.operators.primitives import SWEEP_BIN, carried, islands, iv_join, segments
from locusflow.operators.ranges import both_edges, midpoint, overlap_width, reduce, width

C = F.col


def bp(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(width()), F.lit(0)).cast("long").alias(name))


def chromosome_statistics(df: DataFrame) -> DataFrame:
    return df.groupBy("chr").agg(
        F.count("*").alias("n"), F.min("start").alias("first"), F.max("end").alias("last"), F.min(width()).alias("min_width"),
        F.max(width()).alias("max_width"), F.avg(width()).alias("mean_width"), F.percentile(width(), F.lit(0.5)).alias("median_width"),
    )


def distribution(df: DataFrame, bins: int) -> DataFrame:
    """(chr, rid, n) of midpoints in bins of the largest end over bins."""
    top = df.agg(F.greatest(F.lit(1).cast("long"), F.floor(F.max("end") / bins)).alias("size"))
    x = df.select("chr", midpoint().alias("mid")).join(F.broadcast(top))  # one row
    return x.groupBy("chr", F.floor(C("mid") / C("size")).alias("rid")).agg(F.count("*").alias("n"))


def distribution_in(df: DataFrame, sizes: DataFrame, bins: int) -> DataFrame:
    """Bins of the longest chromosome's size over bins; the last bin of a chromosome holds its remainder."""
    top = sizes.agg(F.greatest(F.lit(1).cast("long"), F.floor(F.max("size") / bins)).alias("width"))
    s = sizes.join(F.broadcast(top)).withColumn("n_bins", F.greatest(F.lit(1).cast("long"), F.floor(C("size") / C("width"))))
    return binned(df, s)


def binned(df: DataFrame, s: DataFrame) -> DataFrame:
    """s: (chr, size, width, n_bins)."""
    x = df.select("chr", midpoint().alias("mid")).join(s, "chr").filter("mid < size")
    return x.groupBy("chr", F.least(F.floor(C("mid") / C("width")), C("n_bins") - 1).alias("rid")).agg(F.count("*").alias("n"))


def shared_bases(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, both): bases that rows of a, of b and of both cover, in one sweep."""
    x = segments(both_edges(a, b, ["chr"]), ["chr"], ["a", "b"]).select(width().alias("bp"), (C("a") > 0).alias("a"), (C("b") > 0).alias("b"))
    total = lambda c: F.coalesce(F.sum(F.when(c, C("bp"))), F.lit(0)).cast("long")
    return x.agg(total(C("a")).alias("a"), total(C("b")).alias("b"), total(C("a") & C("b")).alias("both"))


def similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """jaccard, coverage of a by b, overlap coefficient and bases shared, in one row."""
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    return shared_bases(a, b).select(ratio(C("both"), C("a") + C("b") - C("both")).alias("jaccard"), ratio(C("both"), C("a")).alias("coverage"), ratio(C("both"), F.least("a", "b")).alias("overlap_coefficient"), C("both").alias("shared_bp"))


def pairwise_jaccard(sets: DataFrame) -> DataFrame:
    """(i, j, jaccard) for i < j. Sets are reduced once and joined once."""
    r = islands(sets, ["set_id", "chr"])
    size = r.groupBy("set_id").agg(F.sum(width()).alias("bp"))
    hits = iv_join(r.select("chr", "start", "end", "set_id"), r.select("chr", "start", "end", "set_id")).filter("q_set_id < s_set_id")
    both = hits.groupBy(C("q_set_id").alias("i"), C("s_set_id").alias("j")).agg(F.sum(overlap_width("q_", "s_")).alias("both"))
    pairs = size.select(C("set_id").alias("i"), C("bp").alias("a")).join(size.select(C("set_id").alias("j"), C("bp").alias("b")), C("i") < C("j"))
    out = pairs.join(both, ["i", "j"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return out.select("i", "j", F.when(C("a") + C("b") > C("both"), C("both") / (C("a") + C("b") - C("both"))).otherwise(0.0).alias("jaccard"))


def consensus(sets: DataFrame) -> DataFrame:
    """Union regions with the number of sets that overlap each."""
    union = reduce(sets)
    return iv_join(union, sets.select("chr", "start", "end", "set_id"), wide="left").groupBy("chr", C("q_start").alias("start"), C("q_end").alias("end")).agg(F.countDistinct("s_set_id").alias("count"))


def neighbours(df: DataFrame) -> DataFrame:
    """(chr, start, end, before, after): the end of the region before and the start of the one after, by start and end."""
    last = F.max(F.struct("start", "end"))["end"]
    x = carried(df.select("chr", "start", "end"), ["chr"], "start", SWEEP_BIN, {"last": last, "start": F.min("start")}, {"__l": ("last", "last"), "__r": ("start", "next")})
    w = Window.partitionBy("chr", "__bin").orderBy("start", "end")
    return x.select("chr", "start", "end", F.coalesce(F.lag("end").over(w), "__l").alias("before"), F.coalesce(F.lead("start").over(w), "__r").alias("after"))


def neighbor_distances(df: DataFrame) -> DataFrame:
    """Gaps above 0 to the next region of the chromosome."""
    return neighbours(df).select("chr", "start", "end", (C("after") - C("end")).alias("distance")).filter("distance > 0")


def nearest_neighbors(df: DataFrame) -> DataFrame:
    """The smaller of the gaps to the neighbours before and after, 0 for overlaps; lone regions are dropped."""
    zero = F.lit(0).cast("long")
    left, right = F.greatest(zero, C("start") - C("before")), F.greatest(zero, C("after") - C("end"))
    d = F.least(F.when(C("before").isNotNull(), left), F.when(C("after").isNotNull(), right))
    return neighbours(df).select("chr", "start", "end", d.alias("distance")).filter("distance is not null")


def partition_counts(q: DataFrame, parts: DataFrame, names: list[str]) -> DataFrame:
    """(partition, n): each query (id) counts for the first partition (priority) that it overlaps, or as intergenic."""
    hits = iv_join(q.select("chr", "start", "end", "id"), parts.select("chr", "start", "end", "priority"), wide="both").groupBy(C("q_id").alias("id")).agg(F.min("s_priority").alias("priority"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (C("priority") + 1).cast("int"))
    got = hits.groupBy(name.alias("partition")).agg(F.count("*").alias("n"))
    every = q.sparkSession.createDataFrame([(n,) for n in names], "partition string")
    got = every.join(got, "partition", "left").select("partition", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    # the queries are counted, not looked up among the hits again
    rest = got.agg(F.sum("n").alias("used")).join(q.agg(F.count("*").alias("all"))).select(F.lit("intergenic").alias("partition"), (C("all") - C("used")).alias("n"))
    return got.unionByName(rest)


def partition_bp(q: DataFrame, parts: DataFrame, names: list[str]) -> DataFrame:
    """(partition, bp): overlaps with each partition; intergenic is what is left of the queries' width, at least 0."""
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (C("s_priority") + 1).cast("int"))
    got = iv_join(q.select("chr", "start", "end"), parts.select("chr", "start", "end", "priority"), wide="both").groupBy(name.alias("partition")).agg(F.sum(overlap_width("q_", "s_")).alias("bp"))
    every = q.sparkSession.createDataFrame([(n,) for n in names], "partition string")
    got = every.join(got, "partition", "left").select("partition", F.coalesce("bp", F.lit(0)).cast("long").alias("bp"))
    rest = got.agg(F.sum("bp").alias("used")).join(bp(q, "all")).select(F.lit("intergenic").alias("partition"), F.greatest(F.lit(0).cast("long"), C("all") - C("used")).alias("bp"))
    return got.unionByName(rest)


def coverage_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """1 - bp(a without b) / bp(a)."""
    return shared_bases(a, b).select(F.when(C("a") > 0, 1 - (C("a") - C("both")) / C("a")).otherwise(0.0).alias("coverage"))
