"""Transcripts and the coordinates between them and the genome.

A transcript is a row (tx, chr, strand, exons, cds_start, cds_end, ...): exons
an array of (start, end), 0-based half-open on the genome, in any order; the
coding part is null where there is none. Columns that are not named here stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.functions.digests import reverse_complement
from locusflow.operators.sequences import CHUNK, extract

C = F.col


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)


def indexed(transcripts: DataFrame) -> DataFrame:
    """transcripts with placed: (start, end, offset) of the exons in the
    transcript's direction, offset being the bases before; length; and the coding
    part in transcript space, coding_start and coding_end."""
    exons = F.array_sort("exons")
    turned = F.when(C("strand") == "-", F.reverse(exons)).otherwise(exons)
    x = transcripts.withColumn("__e", turned).withColumn("__w", F.transform("__e", lambda e: (e["end"] - e["start"]).cast("long")))
    before = F.transform("__e", lambda e, i: F.struct(e["start"].alias("start"), e["end"].alias("end"), _sum(F.slice("__w", F.lit(1), i)).alias("offset")))
    x = x.withColumn("placed", before).withColumn("length", _sum(C("__w"))).drop("__e", "__w")
    first = offset_of(F.when(C("strand") == "-", C("cds_end") - 1).otherwise(C("cds_start")))
    last = offset_of(F.when(C("strand") == "-", C("cds_start")).otherwise(C("cds_end") - 1))
    return x.withColumn("coding_start", first).withColumn("coding_end", last + 1)


def offset_of(position: Column) -> Column:
    """The place in an indexed() transcript of a genome position; null in introns and outside."""
    hit = F.get(F.filter("placed", lambda e: (e["start"] <= position) & (position < e["end"])), F.lit(0))
    inside = F.when(C("strand") == "-", hit["end"] - 1 - position).otherwise(position - hit["start"])
    return (hit["offset"] + inside).cast("long")


def position_of(offset: Column, intronic: Column | None = None) -> Column:
    """The genome position of a place in an indexed() transcript, moved by intronic in the transcript's direction; null outside."""
    hit = F.get(F.filter("placed", lambda e: (e["offset"] <= offset) & (offset < e["offset"] + e["end"] - e["start"])), F.lit(0))
    move = F.lit(0) if intronic is None else F.coalesce(intronic, F.lit(0))
    inside = offset - hit["offset"]
    return F.when(C("strand") == "-", hit["end"] - 1 - inside - move).otherwise(hit["start"] + inside + move).cast("long")


def coding_offset(number: Column, after_stop: Column) -> Column:
    """The place of c.number; c.1 begins the coding part, c.-1 is before it (c.0
    is null), and behind the stop counting begins anew."""
    n = number.cast("long")
    place = F.when(after_stop, C("coding_end") + n - 1).when(n > 0, C("coding_start") + n - 1).when(n < 0, C("coding_start") + n)
    return F.when((place >= 0) & (place < C("length")), place)


def to_genome(positions: DataFrame, transcripts: DataFrame, by: str = "tx") -> DataFrame:
    """positions (tx, kind c or n, number, after_stop, intronic, ...) with chr,
    strand and position, null where there is no such place. Positions of unknown
    transcripts are dropped. by="gene" takes the transcripts whose mane is true."""
    t = transcripts if by == "tx" else transcripts.filter("mane").drop("tx")
    x = positions.join(indexed(t), by)
    number = C("number").cast("long")
    plain = F.when((number > 0) & (number <= C("length")), number - 1)
    place = F.when(C("kind") == "n", plain).otherwise(coding_offset(number, F.coalesce("after_stop", F.lit(False))))
    return x.withColumn("position", position_of(place, C("intronic"))).select(*positions.columns, "chr", "strand", "position")


def from_genome(positions: DataFrame, transcripts: DataFrame) -> DataFrame:
    """positions (tx, position, ...) with offset: the place in the transcript, null in
    introns and outside. Positions of unknown transcripts are dropped."""
    x = positions.join(indexed(transcripts), "tx")
    return x.withColumn("__o", offset_of(C("position"))).select(*positions.columns, C("__o").alias("offset"))


def coding_length() -> Column:
    """Bases of the exons in the coding part."""
    part = F.transform("exons", lambda e: F.greatest(F.least(e["end"], C("cds_end")) - F.greatest(e["start"], C("cds_start")), F.lit(0)).cast("long"))
    return F.when(C("cds_start").isNotNull() & C("cds_end").isNotNull(), _sum(part))


def mature(transcripts: DataFrame, pieces: DataFrame, size: int = CHUNK) -> DataFrame:
    """(tx, bases): the exons joined, in the transcript's direction. pieces: chunks() of the genome."""
    exons = transcripts.select("tx", "strand", C("chr").alias("name"), F.explode("exons").alias("e")).select("tx", "strand", "name", "e.start", "e.end")
    exons = exons.withColumn("id", F.struct("tx", "start", "end"))
    joined = extract(pieces, exons, size).groupBy("tx", "strand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "bases"))), lambda e: e["bases"]), "").alias("b"))
    return joined.select("tx", F.when(C("strand") == "-", reverse_complement(F.upper("b"))).otherwise(F.upper("b")).alias("bases"))


#: What a summary of MANE transcripts calls its two kinds; fixed values.
SELECT, CLINICAL = "MANE Select", "MANE Plus Clinical"
_RECORDS = "transcripts map<string, struct<id:string,gene_name:string,contig:string,strand:int,cds_start:long,cds_end:long,exons:array<array<long>>>>"


def mane_summary(spark: SparkSession, path: str) -> DataFrame:
    """(accession, clinical), a row an accession, with its version and without it, of both
    name spaces of a MANE summary (tab-separated, a header that may begin with #).
    Where rows differ, clinical wins. Raises where a column is missing."""
    x = spark.read.option("sep", "\t").option("header", True).csv(path)
    x = x.toDF(*[c.strip().lstrip("#").strip() for c in x.columns])
    for c in ("RefSeq_nuc", "Ensembl_nuc", "MANE_status"):
        if c not in x.columns:
            raise ValueError(f"no column {c} in the MANE summary")
    x = x.filter(F.trim("MANE_status").isin(SELECT, CLINICAL))
    names = x.select(F.explode(F.array(F.trim("RefSeq_nuc"), F.trim("Ensembl_nuc"))).alias("a"), (F.trim("MANE_status") == CLINICAL).alias("clinical")).filter("a <> ''")
    both = names.select(F.explode(F.array(C("a"), F.substring_index("a", ".", 1))).alias("accession"), "clinical")
    return both.groupBy("accession").agg(F.bool_or("clinical").alias("clinical"))


def ingest(spark: SparkSession, path: str, contigs: DataFrame, mane: DataFrame | None = None) -> DataFrame:
    """Transcripts (tx, gene, chr, strand, exons, cds_start, cds_end, mane, clinical) of a
    JSON file of records by accession. contigs: (contig, chr); mane: mane_summary(),
    met by accession, or else without the version. Records of other contigs, of a
    strand that isn't 1 or -1, and without exons are left out; a gene that is
    missing is the empty text. A JSON object isn't split, so a task reads a file."""
    t = spark.read.schema(_RECORDS).json(path, multiLine=True).select(F.explode("transcripts").alias("k", "t")).select("t.*")
    strand = F.when(C("strand") == 1, "+").when(C("strand") == -1, "-")
    t = t.filter(C("strand").isin(1, -1) & (F.size("exons") > 0)).join(contigs, "contig")
    exons = F.transform("exons", lambda e: F.struct(F.get(e, F.lit(0)).alias("start"), F.get(e, F.lit(1)).alias("end")))
    t = t.select(C("id").alias("tx"), F.coalesce("gene_name", F.lit("")).alias("gene"), "chr", strand.alias("strand"), exons.alias("exons"), "cds_start", "cds_end", F.substring_index("id", ".", 1).alias("__base"))
    if mane is None:
        return t.drop("__base").withColumn("mane", F.lit(False)).withColumn("clinical", F.lit(False))
    at = lambda key, name: mane.select(C("accession").alias(key), C("clinical").alias(name))
    t = t.join(at("tx", "__exact"), "tx", "left").join(at("__base", "__loose"), "__base", "left")
    found = F.coalesce("__exact", "__loose")
    return t.withColumn("mane", found.isNotNull()).withColumn("clinical", F.coalesce(found, F.lit(False))).drop("__base", "__exact", "__loose")
