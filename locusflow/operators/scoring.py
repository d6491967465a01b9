"""Universes of tokens, and counts of fragments in peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusflow.operators.primitives import iv_join, ranked

C = F.col
SPECIAL = ("unk", "pad", "mask", "cls", "eos", "bos", "sep")


def universe(regions: DataFrame) -> DataFrame:
    """(chr, start, end, token, name) of distinct regions, numbered from 0 by
    chromosome and start: inside a chromosome, plus the chromosomes before it."""
    r = regions.select("chr", "start", "end").distinct()
    per = r.groupBy("chr").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("chr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = ranked(r, ["chr"], "start", ["start", "end"], "__k").join(per.select("chr", before.alias("__b")), "chr")
    return x.select("chr", "start", "end", (C("__b") + C("__k") - 1).cast("long").alias("token"), F.concat("chr", F.lit(":"), "start", F.lit("-"), "end").alias("name"))


def special_tokens(vocabulary: DataFrame) -> DataFrame:
    """(token, name) of the special tokens, numbered after the regions."""
    names = F.posexplode(F.array(*[F.lit(f"<{n}>") for n in SPECIAL])).alias("k", "name")
    return vocabulary.agg(F.count("*").alias("n")).select("n", names).select((C("n") + C("k")).alias("token"), "name")


def tokens(regions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, token) of all universe regions that each region (id) overlaps."""
    return iv_join(regions.select("chr", "start", "end", "id"), vocabulary.select("chr", "start", "end", "token")).select(C("q_id").alias("id"), C("s_token").alias("token"))


def tokenize(regions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """tokens(); if there are none at all, one row of the unknown token."""
    hits = tokens(regions, vocabulary)
    unknown = special_tokens(vocabulary).filter("name = '<unk>'").select(F.lit(None).cast(hits.schema["id"].dataType).alias("id"), "token")
    none = hits.agg(F.count("*").alias("n")).filter("n = 0")
    return hits.unionByName(unknown.join(none).select("id", "token"))


def tokenize_fragments(fragments: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(barcode, tokens) in the order of fragments (id); one without tokens is the unknown token."""
    unknown = vocabulary.agg(F.count("*").alias("unk"))  # one row
    x = fragments.select("id", "barcode").join(tokens(fragments, vocabulary), "id", "left").join(F.broadcast(unknown))
    x = x.select("barcode", "id", F.coalesce("token", "unk").alias("token"))
    return x.groupBy("barcode").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "token"))), lambda r: r["token"]).alias("tokens"))


def peak_counts(fragments: DataFrame, peaks: DataFrame, mode: str = "atac") -> DataFrame:
    """(peak, barcode, n). atac: both cut sites count, shifted by 4 and -5; the
    end site is the inverted interval [e, e - 1). chip: whole fragments count."""
    if mode == "chip":
        sites = fragments.select("chr", "start", "end", "barcode", C("start").alias("lo"), C("end").alias("hi"))
    else:
        cut = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
        both = F.array(cut(C("start") + 4, C("start") + 5), cut(C("end") - 5, C("end") - 6))
        sites = fragments.select("chr", "barcode", F.explode(both).alias("x")).select("chr", "barcode", C("x.lo").alias("lo"), C("x.hi").alias("hi"))
        sites = sites.withColumn("start", F.least("lo", "hi")).withColumn("end", F.greatest("lo", "hi") + 1)
    hits = iv_join(sites.select("chr", "start", "end", "barcode", "lo", "hi"), peaks.select("chr", "start", "end", "id"))
    hits = hits.filter((C("s_start") < C("q_hi")) & (C("s_end") > C("q_lo")))
    return hits.groupBy(C("s_id").alias("peak"), C("q_barcode").alias("barcode")).agg(F.count("*").alias("n"))


def barcode_clusters(fragments: DataFrame, clusters: DataFrame) -> DataFrame:
    """Fragments with the cluster of their (file, barcode); those without one are dropped."""
    return fragments.join(clusters, ["file", "barcode"])
