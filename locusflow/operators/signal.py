"""Signal of conditions over regions, and its five-number summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusflow.operators.primitives import iv_join

C = F.col


def region_signal(q: DataFrame, signal: DataFrame) -> DataFrame:
    """(chr, start, end, id, condition, value): the largest value of the signal
    rows that a region overlaps; regions without any have no row."""
    hits = iv_join(q.select("chr", "start", "end", "id"), signal)
    x = hits.groupBy("chr", C("q_start").alias("start"), C("q_end").alias("end"), C("q_id").alias("id"), C("s_condition").alias("condition"))
    return x.agg(F.max("s_value").alias("value"))


def five_numbers(values: DataFrame) -> DataFrame:
    """(condition, lower_whisker, lower_hinge, median, upper_hinge,
    upper_whisker) of (condition, value). Hinges are medians of the halves; both
    halves hold the middle value if their number is odd. Whiskers are the
    outermost values within 1.5 times the distance of the hinges."""
    # a value is ranks __lo to __hi of its condition; equal values are one row
    per = values.groupBy("condition", "value").agg(F.count("*").alias("__k"))
    up = Window.partitionBy("condition").orderBy("value")
    x = per.withColumn("__hi", F.sum("__k").over(up)).withColumn("__lo", C("__hi") - C("__k") + 1)
    n = values.groupBy("condition").agg(F.count("*").alias("__n"))
    x = x.join(n, "condition")
    depth = F.floor((C("__n") + 3) / 2) / 2  # rank of the lower hinge; may lie between two
    ranks = {"lower_hinge": depth, "median": (C("__n") + 1) / 2, "upper_hinge": C("__n") + 1 - depth}

    def at(rank):
        return F.max(F.when((C("__lo") <= rank) & (rank <= C("__hi")), C("value")))

    s = x.groupBy("condition").agg(*[((at(F.floor(r)) + at(F.ceil(r))) / 2).alias(k) for k, r in ranks.items()])
    reach = 1.5 * (C("upper_hinge") - C("lower_hinge"))
    both = per.join(s, "condition")
    low = F.min(F.when(C("value") >= C("lower_hinge") - reach, C("value")))
    high = F.max(F.when(C("value") <= C("upper_hinge") + reach, C("value")))
    return both.groupBy("condition", *ranks).agg(low.alias("lower_whisker"), high.alias("upper_whisker")).select("condition", "lower_whisker", *ranks, "upper_whisker")
