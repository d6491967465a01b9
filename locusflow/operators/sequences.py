"""Sequences in chunks, substrings of them, and digests and comparison of collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusflow.functions.digests import sha512t24u
from locusflow.operators.primitives import bin_of

C = F.col
CHUNK = 4096


def chunks(sequences: DataFrame, size: int = CHUNK) -> DataFrame:
    """(name, chunk, bases) of (name, seq). One pass over each sequence cuts it:
    substring() would read it from its start for every chunk."""
    pieces = F.posexplode(F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).alias("chunk", "bases")
    return sequences.select("name", pieces)


def extract(pieces: DataFrame, regions: DataFrame, size: int = CHUNK) -> DataFrame:
    """regions (id, name, start, end, ...; id is a key) with bases: what lies
    inside the sequence; empty if nothing does or there is no such sequence."""
    last = F.greatest(C("end") - 1, C("start"))
    want = regions.filter(C("end") > C("start")).select("id", "name", "start", "end", F.explode(F.sequence(bin_of(C("start"), size), bin_of(last, size)).cast("array<int>")).alias("chunk"))
    from_ = F.greatest(C("start") - C("chunk") * size, F.lit(0)).cast("int")
    to = F.least(C("end") - C("chunk") * size, F.lit(size)).cast("int")
    hit = want.join(pieces, ["name", "chunk"]).select("id", "chunk", C("bases").substr(from_ + 1, to - from_).alias("piece"))
    whole = hit.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "piece"))), lambda p: p["piece"]), "").alias("bases"))
    return regions.join(whole, "id", "left").withColumn("bases", F.coalesce("bases", F.lit("")))


def level2(sequences: DataFrame) -> DataFrame:
    """(collection, names, lengths, sequences) arrays of (collection, ord, name, seq), in the order of ord."""
    rows = sequences.select("collection", F.struct("ord", "name", F.length("seq").cast("long").alias("length"), F.concat(F.lit("SQ."), sha512t24u(F.upper("seq"))).alias("sq")).alias("r"))
    x = rows.groupBy("collection").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return x.select("collection", C("r.name").alias("names"), C("r.length").alias("lengths"), C("r.sq").alias("sequences"))


def level1(arrays: DataFrame) -> DataFrame:
    """(collection, digest, names, lengths, sequences and ancillary digests) of
    level2(). Lengths are no part of the collection's digest."""
    # zipped once a row: an array looked up in a lambda is made anew for each element
    pair = lambda p: F.struct(p["lengths"].alias("length"), p["names"].alias("name"))
    x = arrays.withColumn("pairs", F.transform(F.arrays_zip("lengths", "names"), pair))
    listed = lambda c: sha512t24u(F.to_json(c))
    x = x.select(
        "collection", *[listed(C(c)).alias(c) for c in ("names", "lengths", "sequences")],
        listed(F.array_sort("sequences")).alias("sorted_sequences"), listed(C("pairs")).alias("name_length_pairs"),
        listed(F.array_sort(F.transform("pairs", lambda p: sha512t24u(F.to_json(p))))).alias("sorted_name_length_pairs"),
    )
    both = F.concat(F.lit('{"names":"'), "names", F.lit('","sequences":"'), "sequences", F.lit('"}'))
    return x.withColumn("digest", sha512t24u(both))


def elements(arrays: DataFrame, attributes: tuple[str, ...] = ("names", "lengths", "sequences")) -> DataFrame:
    """(collection, attribute, ord, value) of level2()."""
    named = F.array(*[F.struct(F.lit(a).alias("attribute"), C(a).cast("array<string>").alias("v")) for a in attributes])
    x = arrays.select("collection", F.explode(named).alias("a"))
    return x.select("collection", "a.attribute", F.posexplode("a.v").alias("ord", "value"))


def compare(elems: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, attribute, a_count, b_count, a_and_b, same_order) for pairs (a, b)
    of collections. a_and_b counts repeats. same_order is null with fewer than
    two common elements, or where one is repeated unequally."""
    keys = ["a", "b", "attribute"]

    def side(s: str) -> DataFrame:
        return pairs.join(elems.withColumnRenamed("collection", s), s).select(*keys, "value", "ord", F.lit(s).alias("side"))

    x = side("a").unionByName(side("b"))
    of = Window.partitionBy(*keys, "value")
    n = lambda s: F.count(F.when(C("side") == s, 1))
    x = x.withColumn("na", n("a").over(of)).withColumn("nb", n("b").over(of))
    common = (C("na") > 0) & (C("nb") > 0)
    x = x.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "side", common).orderBy("ord"))).withColumn("common", common)
    kth = x.groupBy(*keys, "common", "k").agg(n("a").alias("__a"), n("b").alias("__b"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum(F.when(C("side") == "a", F.least("na", "nb") / C("na")).otherwise(0)).alias("shared"), F.bool_or(C("common") & (C("na") != C("nb"))).alias("uneven"))
    out = kth.groupBy(*keys).agg(F.sum("__a").alias("a_count"), F.sum("__b").alias("b_count"), F.round(F.sum(F.when(C("common"), C("shared")).otherwise(0))).cast("long").alias("a_and_b"), F.bool_or("uneven").alias("uneven"), F.bool_and(~C("common") | (C("lo") == C("hi"))).alias("same"))
    return out.select(*keys, "a_count", "b_count", "a_and_b", F.when((C("a_and_b") >= 2) & ~C("uneven"), C("same")).alias("same_order"))
