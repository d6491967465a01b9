"""Gene models from GTF, and what partitions of a genome would hold by chance."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from locusflow.operators.ranges import reduce
from locusflow.sources.readers import bed, lines

C = F.col
FEATURES = ("gene", "exon", "three_prime_utr", "five_prime_utr", "UTR", "CDS")


def gtf(spark: SparkSession, path: str, protein_coding: bool = False, ucsc: bool = False) -> DataFrame:
    """(chr, start, end, strand, feature, transcript) of FEATURES, 0-based. ucsc: names get the prefix chr."""
    x = lines(spark, path).filter("not startswith(value, '#')").withColumn("f", F.split("value", "\t", -1)).filter("size(f) >= 9")
    x = x.select(*[F.get("f", F.lit(i)).alias(n) for i, n in ((0, "chr"), (2, "feature"), (3, "s"), (4, "e"), (6, "strand"), (8, "attributes"))])
    x = x.filter(C("feature").isin(*FEATURES))
    if protein_coding:
        x = x.filter(C("attributes").rlike('gene_(bio)?type "protein_coding"'))
    name = F.when(C("chr").startswith("chr"), C("chr")).otherwise(F.concat(F.lit("chr"), "chr")) if ucsc else C("chr")
    id_ = F.regexp_extract("attributes", 'transcript_id "([^"]+)"', 1)
    return x.select(name.alias("chr"), F.greatest(C("s").cast("long") - 1, F.lit(0).cast("long")).alias("start"), C("e").cast("long").alias("end"), "strand", "feature", F.when(id_ != "", id_).alias("transcript"))


def model_from_beds(spark: SparkSession, genes: str, exons: str, three_utr: str | None = None, five_utr: str | None = None) -> DataFrame:
    """(chr, start, end, strand, part) of BED files, each part reduced by strand; strand is column 6, * where there is none."""
    out = None
    for part, path in (("gene", genes), ("exon", exons), ("three_utr", three_utr), ("five_utr", five_utr)):
        if path is not None:
            strand = F.get(F.split("rest", "\t", -1), F.lit(2))
            x = bed(spark, path).withColumn("strand", F.when(strand.isin("+", "-"), strand).otherwise("*"))
            x = reduce(x, ["chr", "strand"]).select("chr", "start", "end", "strand", F.lit(part).alias("part"))
            out = x if out is None else out.unionByName(x)
    return out


def gene_model(records: DataFrame) -> DataFrame:
    """(chr, start, end, strand, part): genes, exons, three_utr and five_utr of
    gtf(). An untyped UTR is placed by its middle against the middle of its
    transcript's coding part. If no UTR is given at all, they are what the exons
    of coding transcripts have outside of the coding part."""
    kept = ["chr", "start", "end", "strand"]
    typed = records.filter(C("feature").isin("gene", "exon", "three_prime_utr", "five_prime_utr"))
    part = F.element_at(F.create_map(*[F.lit(v) for p in (("gene", "genes"), ("exon", "exons"), ("three_prime_utr", "three_utr"), ("five_prime_utr", "five_utr")) for v in p]), C("feature"))
    typed = typed.select(*kept, part.alias("part"))
    cds = records.filter("feature = 'CDS' and transcript is not null").groupBy("transcript").agg(F.min("start").alias("cs"), F.max("end").alias("ce"))
    coding = records.join(cds, "transcript")
    middle = lambda a, b: F.floor((C(a) + C(b)) / 2)
    five = F.when(C("strand") == "+", middle("start", "end") < middle("cs", "ce")).otherwise(middle("start", "end") > middle("cs", "ce"))
    placed = coding.filter("feature = 'UTR'").select(*kept, F.when(five, "five_utr").otherwise("three_utr").alias("part"))
    known = typed.unionByName(placed)
    minus = C("strand") == "-"
    before = F.when(C("start") < C("cs"), F.struct("start", F.least("end", "cs").alias("end"), F.when(minus, "three_utr").otherwise("five_utr").alias("part")))
    after = F.when(C("end") > C("ce"), F.struct(F.greatest("start", "ce").alias("start"), "end", F.when(minus, "five_utr").otherwise("three_utr").alias("part")))
    cut = coding.filter("feature = 'exon'").select("chr", "strand", F.explode(F.array(before, after)).alias("u")).filter("u is not null")
    given = known.filter("part in ('three_utr', 'five_utr')").limit(1).agg((F.count("*") > 0).alias("given"))  # one row
    cut = cut.crossJoin(given).filter("not given").select("chr", "u.start", "u.end", "strand", "u.part")
    return known.unionByName(cut)


@F.pandas_udf(DoubleType())
def _chi_square_tail(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or math.isnan(v) else math.erfc(math.sqrt(v / 2)))


def expected(observed: DataFrame, parts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(partition, observed, expected, log10_oe, p) of observed (partition, n),
    every query once; parts: (partition, chr, start, end). The share of a
    partition is its bases, overlaps counted in each; intergenic has the rest of
    the genome. p: goodness of fit with one degree of freedom; 1 if undefined."""
    bp = parts.groupBy("partition").agg(F.sum(C("end") - C("start")).alias("bp"))
    genome = sizes.agg(F.sum("size").alias("genome"))
    totals = genome.crossJoin(bp.agg(F.coalesce(F.sum("bp"), F.lit(0)).alias("covered"))).crossJoin(observed.agg(F.sum("n").alias("total")))  # one row each
    x = observed.join(bp, "partition", "left").crossJoin(totals)
    own = F.when(C("partition") == "intergenic", F.greatest(C("genome") - C("covered"), F.lit(0))).otherwise(F.coalesce("bp", F.lit(0)))
    x = x.select("partition", C("n").cast("double").alias("observed"), (own / C("genome") * C("total")).alias("expected"), "total")
    o, e, t = C("observed"), C("expected"), C("total")
    inf = lambda s: F.lit(s).cast("double")
    log: Column = F.when(o == 0, inf("-inf")).when(e == 0, inf("inf")).otherwise(F.log10(F.try_divide(o, e)))
    chi = F.try_divide((o - e) * (o - e), e) + F.try_divide((o - e) * (o - e), t - e)
    return x.select("partition", "observed", "expected", log.alias("log10_oe"), F.coalesce(_chi_square_tail(chi), F.lit(1.0)).alias("p"))
