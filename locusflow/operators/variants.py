"""Fully justified alleles and their computed identifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructType

from locusflow.functions.digests import sha512t24u
from locusflow.operators.sequences import CHUNK, extract
from locusflow.plans.scratch import materialize

C = F.col
#: Bases read at either side of an allele; what rolls beyond the last is read with its whole sequence.
CONTEXTS = (64, 1 << 14)
_WHOLE = 1 << 31
_RESULT = StructType().add("new_start", LongType()).add("new_end", LongType()).add("allele", StringType()).add("inside", BooleanType()).add("matches", BooleanType())


def justify(context: str, at: int, ref: str, alt: str) -> tuple[int, int, str, int, int]:
    """(start, end, allele, bases rolled left, right) in the context, whose base
    number at is the first of ref. What the alleles begin or end with in common
    goes; a pure insertion or deletion then covers every place it may shift to."""
    short = min(len(ref), len(alt))
    head = next((i for i in range(short) if ref[i] != alt[i]), short)
    ref, alt, short = ref[head:], alt[head:], short - head
    tail = next((i for i in range(short) if ref[-1 - i] != alt[-1 - i]), short)
    ref, alt = ref[: len(ref) - tail], alt[: len(alt) - tail]
    start = at + head
    end = start + len(ref)
    unit = ref or alt
    left = right = 0
    if unit and not (ref and alt):
        while left < start and context[start - 1 - left] == unit[-1 - left % len(unit)]:
            left += 1
        while end + right < len(context) and context[end + right] == unit[right % len(unit)]:
            right += 1
    return start - left, end + right, context[start - left : start] + alt + context[end : end + right], left, right


@F.pandas_udf(_RESULT)
def _justified(bases: pd.Series, start: pd.Series, ref: pd.Series, alt: pd.Series, width: pd.Series) -> pd.DataFrame:
    out = []
    for b, s, r, a, w in zip(bases, start, ref, alt, width):
        first = max(0, s - w)
        at = s - first
        if at > len(b) or b[at : at + len(r)] != r:
            out.append((None, None, None, True, False))
            continue
        new_start, new_end, allele, *_ = justify(b, at, r, a)
        # a roll that stops at the edge of the context may go on, unless the sequence ends there
        inside = (new_start > 0 or first == 0) and (new_end < len(b) or len(b) < at + len(r) + w)
        out.append((new_start + first, new_end + first, allele, inside, True))
    return pd.DataFrame(out, columns=["new_start", "new_end", "allele", "inside", "matches"])


def normalized(variants: DataFrame, pieces: DataFrame, mismatch: str = "raise", size: int = CHUNK, contexts: tuple[int, ...] = CONTEXTS) -> DataFrame:
    """(id, name, start, end, allele) of (id, name, start, ref, alt), id a key;
    pieces: chunks() of the sequences. Where ref isn't what the sequence holds,
    raises, or with mismatch="null" gives nulls. Variants and what is found with
    each context are written: the next one reads only what is left, of the
    sequences that have it, and none if nothing is."""
    rest, done = variants.select("id", "name", C("start").cast("long").alias("start"), F.upper("ref").alias("ref"), F.upper("alt").alias("alt")), []
    rest = materialize(rest, "variants")
    pieces = pieces.withColumn("bases", F.upper("bases"))
    for w in (*contexts, _WHOLE):
        if done:
            if not rest.limit(1).count():
                break
            pieces = pieces.join(rest.select("name").distinct(), "name", "left_semi")
        last = C("s") + F.length("ref") + w
        around = rest.withColumnRenamed("start", "s").withColumn("start", F.greatest(C("s") - w, F.lit(0).cast("long")))
        if w == _WHOLE:  # a sequence of its own length
            ends = pieces.groupBy("name").agg(F.max(C("chunk") * size + F.length("bases")).alias("__length"))
            around = around.join(ends, "name", "left").withColumn("end", F.coalesce("__length", F.lit(0))).drop("__length")
        else:
            around = around.withColumn("end", last)
        x = extract(pieces, around, size).withColumn("r", _justified("bases", "s", "ref", "alt", F.lit(w)))
        x = materialize(x.select("id", "name", "s", "ref", "alt", "r"), "alleles")
        done.append(x.filter("r.inside").select("id", "name", C("s").alias("start"), "ref", "r"))
        rest = x.filter("not r.inside").select("id", "name", C("s").alias("start"), "ref", "alt")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    if mismatch == "raise":
        wrong = F.raise_error(F.concat(F.lit("not the reference: "), "name", F.lit(":"), C("start").cast("string"), F.lit(" "), "ref"))
        out = out.withColumn("r", F.when(C("r.matches"), C("r")).otherwise(wrong))
    return out.select("id", "name", C("r.new_start").alias("start"), C("r.new_end").alias("end"), "r.allele")


def location_digest(accession: Column, start: Column, end: Column) -> Column:
    return sha512t24u(F.concat(F.lit('{"end":'), end.cast("string"), F.lit(',"sequenceReference":{"refgetAccession":"'), accession, F.lit('","type":"SequenceReference"},"start":'), start.cast("string"), F.lit(',"type":"SequenceLocation"}')))


def allele_id(accession: Column, start: Column, end: Column, allele: Column) -> Column:
    state = F.concat(F.lit('{"location":"'), location_digest(accession, start, end), F.lit('","state":{"sequence":"'), allele, F.lit('","type":"LiteralSequenceExpression"},"type":"Allele"}'))
    return F.concat(F.lit("ga4gh:VA."), sha512t24u(state))


def length_allele_id(accession: Column, start: Column, end: Column, length: Column, unit: Column) -> Column:
    """The identifier of an allele given as a length of repeats of a unit's length; its bases are no part of it."""
    state = F.concat(F.lit('{"location":"'), location_digest(accession, start, end), F.lit('","state":{"length":'), length.cast("string"), F.lit(',"repeatSubunitLength":'), unit.cast("string"), F.lit(',"type":"ReferenceLengthExpression"},"type":"Allele"}'))
    return F.concat(F.lit("ga4gh:VA."), sha512t24u(state))


def identified(variants: DataFrame, pieces: DataFrame, accessions: DataFrame, mismatch: str = "raise") -> DataFrame:
    """normalized() with vrs_id. accessions: (name, accession); variants of other sequences are skipped."""
    accessions = materialize(accessions.select("name", "accession"), "accessions")
    known = variants.join(accessions.select("name"), "name", "left_semi")
    x = normalized(known, pieces, mismatch).join(accessions, "name")
    return x.withColumn("vrs_id", allele_id(C("accession"), C("start"), C("end"), C("allele")))
