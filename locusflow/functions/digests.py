"""Digests and sequence functions, all built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col


def region_digest() -> Column:
    return F.md5(F.concat_ws(",", "chr", "start", "end"))


def region_line(rest: str | None = None) -> Column:
    return F.concat_ws("\t", "chr", "start", "end", *([rest] if rest else []))


def sha512t24u(c: Column) -> Column:
    """The first 24 bytes of SHA-512, base64url: 32 characters."""
    return F.translate(F.base64(F.unhex(F.substring(F.sha2(c.cast("binary"), 512), 1, 48))), "+/", "-_")


def set_identifiers(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, identifier): md5 of the md5s of all chromosomes, starts and ends, in the
    order of the regions. As in file_digest(), a set's regions meet in one row."""
    rows = F.array_sort(F.collect_list(F.struct("chr", "start", "end")))
    x = df.groupBy(*keys).agg(rows.alias("r"))
    part = lambda f: F.md5(F.array_join(F.transform("r", lambda s: s[f].cast("string")), ","))
    return x.select(*keys, F.md5(F.concat_ws(",", part("chr"), part("start"), part("end"))).alias("identifier"))


def file_digest(df: DataFrame) -> DataFrame:
    """md5 of the sorted regions as lines of text. A digest has one input, so all lines of a set meet in one row: for sets of up to some 50 million regions."""
    line = F.struct("chr", "start", "end", *[c for c in ("rest",) if c in df.columns])
    text = F.transform(F.array_sort(F.collect_list(line)), lambda r: F.concat_ws("\t", r["chr"], r["start"], r["end"], *([r["rest"]] if "rest" in df.columns else [])))
    return df.agg(F.md5(F.concat(F.array_join(text, "\n"), F.lit("\n"))).alias("digest"))


def list_identifier(identifiers: DataFrame) -> DataFrame:
    return identifiers.agg(F.md5(F.array_join(F.array_sort(F.collect_list("identifier")), "")).alias("identifier"))


def gc_content(c: Column) -> Column:
    return F.when(F.length(c) == 0, 0.0).otherwise(F.length(F.regexp_replace(F.upper(c), "[^GC]", "")) / F.length(c))


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, "ACGT", "TGCA"))


def dinucleotides(df: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """(id, pair, n) of overlapping pairs of ACGT. Each of the 16 is counted in
    the string itself, as what a replacement of its overlapping occurrences removes."""
    seq = F.upper(C(seq_col))
    pairs = [a + b for a in "ACGT" for b in "ACGT"]
    # a zero-width mark before each occurrence lengthens the string by one
    counts = [F.struct(F.lit(p).alias("pair"), (F.length(F.regexp_replace(seq, f"(?={p})", "|")) - F.length(seq)).cast("long").alias("n")) for p in pairs]
    x = df.select(C(id_col).alias(id_col), F.explode(F.array(*counts)).alias("x"))
    return x.select(id_col, "x.pair", "x.n").filter("n > 0")


def alphabet(c: Column) -> Column:
    """The narrowest alphabet that holds all symbols."""
    s = F.upper(c)
    return (
        F.when(s.rlike("^[ACGT]*$"), "dna2bit").when(s.rlike("^[ACGTNRYX]*$"), "dna3bit").when(s.rlike("^[ACGTNRYKMSWBDHVX*-]*$"), "dnaio")
        .when(s.rlike("^[ACDEFGHIKLMNPQRSTVWYX*-]*$"), "protein").otherwise("ascii")
    )
