"""Enrichment of user sets against a database of region sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusflow.functions.hypergeometric import fisher_udf, odds_udf
from locusflow.operators.overlaps import count_overlaps
from locusflow.operators.primitives import iv_join, reached
from locusflow.operators.ranges import disjoin

C = F.col


def contingency(users: DataFrame, db: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """(user_set, set_id, a, b, c, d). users and universe: (chr, start, end), a row
    a region, users with user_set; db with set_id. No universe: the users' regions
    are it, each in one user set. All pairs of a user set and a db set that hits
    the universe are there; both sides are summaries, a row a set."""
    # a region counts for a set at the first row of it that it overlaps: those
    # before end at its start or earlier. So pairs are counted where they are found
    first = reached(db.select("chr", "start", "end", "set_id"), ["chr", "set_id"]).drop("__bin")

    def hits(rows: DataFrame, *more: str) -> DataFrame:
        pairs = iv_join(rows.select("chr", "start", "end", *more), first).filter("s___reach is null or s___reach <= q_start")
        return pairs.groupBy(*[C(f"q_{m}").alias(m) for m in more], C("s_set_id").alias("set_id")).agg(F.count("*").alias("a"))

    n = users.groupBy("user_set").agg(F.count("*").alias("size"))
    if universe is None:
        entry = F.when(C("user_set").isNotNull(), F.struct("user_set", "a"))
        k = hits(users, "user_set").groupBy("set_id").agg(F.sum("a").alias("hits"), F.map_from_entries(F.collect_list(entry)).alias("m"))
        x = n.withColumn("total", F.sum("size").over(Window.partitionBy())).join(k).withColumn("a", F.coalesce(F.element_at("m", C("user_set")), F.lit(0).cast("long")))
    else:
        k = hits(universe).withColumnRenamed("a", "hits")
        x = n.join(universe.agg(F.count("*").alias("total"))).join(k).join(hits(users, "user_set"), ["user_set", "set_id"], "left").withColumn("a", F.coalesce("a", F.lit(0).cast("long")))
    return x.select("user_set", "set_id", "a", (C("hits") - C("a")).alias("b"), (C("size") - C("a")).alias("c"), (C("total") - C("size") - C("hits") + C("a")).alias("d"))


def fisher(table: DataFrame) -> DataFrame:
    p = table.withColumn("p_value", fisher_udf("a", "b", "c", "d")).withColumn("odds_ratio", odds_udf("a", "b", "c", "d"))
    return p.withColumn("p_value_log", -F.log10(C("p_value") + F.lit(1e-322)))


def ranked(results: DataFrame) -> DataFrame:
    """Ranks by p, odds ratio (NaN last) and support, ties the least, with their largest and mean."""
    w = Window.partitionBy("user_set")
    x = results.withColumn("rnk_pv", F.rank().over(w.orderBy(C("p_value_log").desc())))
    x = x.withColumn("rnk_or", F.rank().over(w.orderBy(F.isnan("odds_ratio"), C("odds_ratio").desc()))).withColumn("rnk_sup", F.rank().over(w.orderBy(C("a").desc())))
    return x.withColumn("max_rnk", F.greatest("rnk_pv", "rnk_or", "rnk_sup")).withColumn("mean_rnk", F.round((C("rnk_pv") + C("rnk_or") + C("rnk_sup")) / 3, 3))


def bh(results: DataFrame) -> DataFrame:
    """Benjamini-Hochberg q-values in each user set."""
    order = Window.partitionBy("user_set").orderBy("p_value", "set_id")
    x = results.withColumn("__k", F.row_number().over(order)).withColumn("__n", F.count("*").over(Window.partitionBy("user_set")))
    back = Window.partitionBy("user_set").orderBy(C("__k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    q = F.min(F.least(F.lit(1.0), C("p_value") * C("__n") / C("__k"))).over(back)
    return x.withColumn("q_value", q).drop("__k", "__n")


def redefine(users: DataFrame, universe: DataFrame) -> DataFrame:
    """(user_set, id): of each user set the universe rows that it overlaps."""
    return iv_join(universe.select("chr", "start", "end", "id"), users.select("chr", "start", "end", "user_set")).select(C("s_user_set").alias("user_set"), C("q_id").alias("id")).distinct()


def check_universe(users: DataFrame, universe: DataFrame) -> DataFrame:
    n = count_overlaps(users, universe)
    return n.agg(F.count(F.when(C("n") > 0, 1)).alias("covered"), F.count(F.when(C("n") > 1, 1)).alias("many"), F.count("*").alias("total"))


def restricted_universe(users: DataFrame) -> DataFrame:
    return disjoin(users)
