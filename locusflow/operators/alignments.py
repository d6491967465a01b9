"""Quality of aligned reads, and the positions of ATAC cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.operators import coverage

C = F.col
MIN_MAPQ = 30
PAIRED, UNMAPPED, REVERSE, FIRST, LAST, DUPLICATE = 0x1, 0x4, 0x10, 0x40, 0x80, 0x400


def has(flag: int) -> Column:
    return C("flag").bitwiseAND(flag) != 0


def mitochondrial(chr_: Column) -> Column:
    c = F.lower(chr_)
    return c.isin("chrm", "mt", "chrmt") | c.contains("rcrsd")


def atac_position() -> Column:
    """The cut of a read (start, end, flag): 4 after its start, or 5 before its end if reversed."""
    return F.when(has(REVERSE), C("end") - 5).otherwise(C("start") + 4)


def library_complexity(reads: DataFrame, order: str = "line") -> DataFrame:
    """One row (total, distinct, one, two, duplicates, mito, nrf, pbc1, pbc2) of
    (qname, flag, chr, pos, mapq, tlen, length, order). Reads below MIN_MAPQ and
    unmapped ones don't count; a missing quality passes. Paired data count pairs
    of one chromosome, by position and template length of both mates; where a
    mate repeats, its last row counts. Mitochondrial reads are only counted.
    Without any counted row the rates are 0."""
    kept = reads.filter((C("mapq").isNull() | (C("mapq") >= MIN_MAPQ)) & ~has(UNMAPPED) & C("chr").isNotNull() & (C("chr") != "*"))
    mito = mitochondrial(C("chr"))
    totals = kept.agg(
        F.count("*").alias("__reads"), F.count(F.when(mito, 1)).alias("mito"), F.count(F.when(has(DUPLICATE), 1)).alias("duplicates"),
        F.coalesce(F.bool_or(~mito & has(PAIRED) & C("pos").isNotNull()), F.lit(False)).alias("__paired"),
    )
    nuclear = kept.filter(~mito & C("pos").isNotNull())
    mate = lambda c: F.max_by(F.when(c, F.struct("pos", "tlen")), F.when(c, C(order)))
    first = has(FIRST)
    pairs = nuclear.filter(has(PAIRED) & C("qname").isNotNull()).groupBy("chr", "qname").agg(mate(first).alias("a"), mate(~first & has(LAST)).alias("b"))
    pairs = pairs.filter("a is not null and b is not null").select("chr", F.lit(1).alias("pair"), C("a.pos").alias("p1"), C("a.tlen").alias("t1"), C("b.pos").alias("p2"), C("b.tlen").alias("t2"))
    zero = F.lit(0).cast("long")
    single = nuclear.filter(~has(PAIRED)).select("chr", F.lit(0).alias("pair"), C("pos").alias("p1"), C("length").alias("t1"), zero.alias("p2"), zero.alias("t2"))
    # single reads and pairs at the same values of one chromosome are one position
    at = pairs.unionByName(single).groupBy("chr", "p1", "t1", "p2", "t2").agg(F.count("*").alias("n"), F.sum("pair").alias("pairs"))
    m = at.agg(F.count("*").alias("distinct"), F.count(F.when(C("n") == 1, 1)).alias("one"), F.count(F.when(C("n") == 2, 1)).alias("two"), F.coalesce(F.sum("pairs"), zero).alias("__pairs"))
    x = totals.crossJoin(m)  # one row each
    x = x.withColumn("total", F.when(C("__paired"), C("__pairs")).otherwise(C("__reads") - C("mito")))
    rate = lambda below: C("one") / F.greatest(C(below), F.lit(1))
    return x.select("total", "distinct", "one", "two", "duplicates", "mito", rate("total").alias("nrf"), rate("distinct").alias("pbc1"), rate("two").alias("pbc2"))


def tracks(reads: DataFrame, sizes: DataFrame, kinds: tuple[str, ...] = ("start", "end", "core"), smooth: int = 0) -> DataFrame:
    """Runs (kind, chr, start, end, count) of the placed reads on the chromosomes of
    sizes (chr, size): windows around starts or ends, or what lies between. Runs
    are cut at the end of their chromosome, where BED tracks go on."""
    out = None
    placed = reads.filter(C("pos").isNotNull() & ~has(UNMAPPED)).select("chr", C("pos").alias("start"), "end")
    for kind in kinds:
        runs = coverage.runs(coverage.core_events(placed) if kind == "core" else coverage.point_events(placed, kind, smooth))
        runs = runs.join(sizes, "chr").withColumn("end", F.least("end", C("size") + 1)).filter("start < end")
        runs = runs.select(F.lit(kind).alias("kind"), "chr", "start", "end", "count")
        out = runs if out is None else out.unionByName(runs)
    return out


def cut_sites(reads: DataFrame) -> DataFrame:
    """(chr, start, end): a region of one base for the cut of each placed read."""
    placed = reads.filter(C("pos").isNotNull() & ~has(UNMAPPED)).withColumn("start", C("pos"))
    return placed.select("chr", atac_position().alias("start")).withColumn("end", C("start") + 1)


def rates(complexity: DataFrame, reads: DataFrame) -> DataFrame:
    """library_complexity() with the shares of duplicates and mitochondrial reads
    in the mapped reads that pass MIN_MAPQ; 0 where there are none."""
    kept = reads.filter((C("mapq").isNull() | (C("mapq") >= MIN_MAPQ)) & ~has(UNMAPPED) & C("chr").isNotNull() & (C("chr") != "*"))
    share = lambda n: F.when(C("__n") == 0, 0.0).otherwise(C(n) / C("__n"))
    x = complexity.crossJoin(kept.agg(F.count("*").alias("__n")))  # one row each
    return x.withColumn("duplicate_rate", share("duplicates")).withColumn("mito_rate", share("mito")).drop("__n")
