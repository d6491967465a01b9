"""Variant descriptions (HGVS) parsed in Arrow batches, and their alleles.

Parsed are substitutions, deletions, insertions, deletion-insertions, duplications,
inversions, copies, repeats, = and ? at one position, a range, a range whose
ends are ranges themselves, or the whole sequence, in g., c., n., m., r. and p.
Alleles are made in g., c. and n. of all but inversions, copies, repeats, ?,
whole sequences and uncertain ranges. Other descriptions are not valid.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from locusflow.functions.digests import reverse_complement
from locusflow.operators.sequences import CHUNK, extract
from locusflow.operators.transcripts import to_genome

C = F.col
#: Codes of bases and of ambiguous bases; fixed values.
_BASES = "[ACGTUNRYSWKMBDHVacgtunryswkmbdhv]"
_PLACE = r"(?:\?|[*]?[+-]?[0-9]+(?:[+-][0-9]+)?)"
_END = rf"({_PLACE}|\({_PLACE}_{_PLACE}\))"
_EDIT = rf"(?:({_BASES}+)>({_BASES}+)|(del)(?:({_BASES}*)ins({_BASES}+)|({_BASES}+)|[0-9]*)|(ins)({_BASES}+)|(dup){_BASES}*|(inv){_BASES}*|(copy)([0-9]+)|({_BASES}+)\[([0-9]+)\]|({_BASES}*)(=)|(\?))"
PATTERN = rf"^([^:()\s\x1f]+)(?:\(([^()\x1f]+)\))?:([gcnmr])\.(?:(\()?{_END}(?:_{_END})?{_EDIT}(\))?|([=?]))$"
_GROUPS = (
    "accession", "gene", "kind", "open", "p1", "p2", "sub_ref", "sub_alt", "del", "delins_ref", "delins", "del_ref", "ins", "ins_alt", "dup", "inv",
    "copy", "copies", "repeat", "repeats", "same_ref", "same", "unknown", "close", "whole",
)
_RESIDUE = r"(?:[*]|Ter|[A-Z][a-z]*)[0-9]+"
PROTEIN = rf"^([^:()\s\x1f]+)(?:\(([^()\x1f]+)\))?:p\.(?:(\()?({_RESIDUE})(?:_({_RESIDUE}))?(?:(del)|(dup)|(ins)([A-Za-z*]+)|((?:[A-Z][a-z]*)?(?:fs|ext)[A-Za-z0-9*-]*)|(=)|(\?)|([A-Za-z*]+))(\))?|([=?]))$"
_PROTEIN_GROUPS = ("accession", "gene", "open", "p1", "p2", "del", "dup", "ins", "ins_alt", "fs", "same", "unknown", "sub_alt", "close", "whole")


_MATCH, _MATCH_PROTEIN, _MATCH_PLACE = re.compile(PATTERN), re.compile(PROTEIN), re.compile(r"([*]?)([+-]?[0-9]{1,18})([+-][0-9]{1,18})?")
_NOT = {"valid": False}


def _place(text: str | None) -> dict | None:
    """A place; None of ? and of numbers beyond 18 digits."""
    m = _MATCH_PLACE.fullmatch(text or "")
    return m and {"number": int(m[2]), "after_stop": m[1] == "*", "intronic": int(m[3] or 0)}


def _end(text: str, inner: int) -> dict | None:
    """The place of an end; of a range the inner bound, or else the other."""
    bounds = [_place(b) for b in text.strip("()").split("_")]
    return bounds[inner] or bounds[0] or bounds[-1]


def _residue(text: str | None) -> dict | None:
    digits = text and re.search("[0-9]+$", text)[0]
    return {"number": int(digits), "after_stop": text.startswith(("*", "Ter")), "intronic": 0} if digits and len(digits) <= 18 else None


def _protein(m: re.Match) -> dict:
    t = dict(zip(_PROTEIN_GROUPS, m.groups()))
    if (t["open"] is None) != (t["close"] is None):
        return _NOT
    edit = next((e for e, g in (("del", "del"), ("dup", "dup"), ("ins", "ins"), ("unknown", "fs"), ("unknown", "unknown"), ("same", "same"), ("sub", "sub_alt")) if t[g]), None)
    first = _residue(t["p1"])
    return {"valid": True, "accession": t["accession"], "gene": t["gene"], "kind": "p", "edit": edit or ("same" if t["whole"] == "=" else "unknown"), "alt": t["sub_alt"] or t["ins_alt"], "first": first, "second": _residue(t["p2"]) or first, "uncertain": t["open"] is not None, "whole": t["whole"] is not None, "ranged": False}


def _one(text: str | None) -> dict:
    if text is None:
        return _NOT
    m = _MATCH.fullmatch(text)
    if m is None:
        m = _MATCH_PROTEIN.fullmatch(text)
        return _protein(m) if m else _NOT
    t = dict(zip(_GROUPS, m.groups()))
    edit = next((e for e, g in (("sub", "sub_ref"), ("delins", "delins"), ("del", "del"), ("ins", "ins"), ("dup", "dup"), ("inv", "inv"), ("copy", "copy"), ("repeat", "repeat"), ("same", "same"), ("unknown", "unknown")) if t[g]), None)
    out = {"valid": True, "accession": t["accession"], "gene": t["gene"], "kind": t["kind"], "whole": t["whole"] is not None, "ranged": False, "uncertain": False}
    if t["whole"]:
        return out | {"edit": "same" if t["whole"] == "=" else "unknown"}
    ends = [p for p in (t["p1"], t["p2"]) if p]
    places = [_end(p, inner) for p, inner in zip(ends, (-1, 0))]
    starred = "*" in "".join(ends) and t["kind"] != "c"
    single = edit == "ins" and len(ends) == 1  # an insertion is between two places
    if (t["open"] is None) != (t["close"] is None) or None in places or starred or single:
        return _NOT
    ranged = any(p[0] == "(" for p in ends)
    ref = t["sub_ref"] or t["delins_ref"] or t["del_ref"] or t["repeat"] or t["same_ref"]
    alt = t["sub_alt"] or t["delins"] or t["ins_alt"]
    number = t["copies"] or t["repeats"]
    return out | {"edit": edit, "ref": ref and ref.upper(), "alt": alt and alt.upper(), "copies": number and int(number[:18]), "first": places[0], "second": places[-1], "uncertain": ranged or t["open"] is not None, "ranged": ranged}


_PLACES = pa.struct([("number", pa.int64()), ("after_stop", pa.bool_()), ("intronic", pa.int64())])
_TEXTS = [(n, pa.string()) for n in ("accession", "gene", "kind", "edit", "ref", "alt")]
_ARROW = pa.struct([("valid", pa.bool_()), *_TEXTS, ("copies", pa.int64()), ("first", _PLACES), ("second", _PLACES), *[(n, pa.bool_()) for n in ("uncertain", "whole", "ranged")]])


@F.arrow_udf(from_arrow_type(_ARROW))
def _parse(text: pa.Array) -> pa.Array:
    return pa.array([_one(s) for s in text.to_pylist()], _ARROW)


def parse(column: str) -> Column:
    """struct (valid, accession, gene, kind, edit, ref, alt, copies, first, second,
    uncertain, whole, ranged) of a description; first and second: (number,
    after_stop, intronic). Of an end that is a range, the inner bound stands, or
    the other where that is unknown; ranged says that there was one. copies is
    that of copies and repeats. In p. a residue's number stands, after_stop for
    * and Ter; frame shifts and extensions are unknown. Null isn't valid."""
    return _parse(C(column))


def gene_symbol(name: Column) -> Column:
    """Whether a name is that of a gene rather than an accession or a chromosome: no
    version, no prefix of a namespace (fixed values), no scaffold number."""
    return ~(name.contains(".") | (name == "MT") | name.rlike("^(NC_|NM_|NR_|NG_|NW_|NT_|XM_|XR_|ENST|ENSG|chr|(GL|KI)[0-9])"))


_SINGLE = "h.valid and not h.whole and not h.ranged and h.kind in ('g', 'c', 'n') and h.edit in ('sub', 'del', 'ins', 'delins', 'dup', 'same')"


def alleles(described: DataFrame, pieces: DataFrame, transcripts: DataFrame | None = None, size: int = CHUNK) -> DataFrame:
    """(id, name, start, ref, alt) on the genome, for variants.normalized(), of
    described (id, hgvs), id a key. g. names a sequence of pieces; c. and n. one
    of transcripts (tx, ...). Rows that aren't valid or have no one allele, lie outside
    of their transcript or insert between places that aren't neighbours are dropped."""
    x = described.select("id", parse("hgvs").alias("h")).filter(_SINGLE)
    whole = ~C("h.first.after_stop") & (C("h.first.number") > 0) & (C("h.second.number") > 0) & (C("h.first.intronic") == 0) & (C("h.second.intronic") == 0)
    x = x.select("id", "h.*")
    ground = described.select("id", parse("hgvs").alias("h")).filter(_SINGLE).filter("h.kind = 'g'").filter(whole)
    ground = ground.select("id", C("h.accession").alias("name"), F.lit("+").alias("strand"), (C("h.first.number") - 1).alias("a"), (C("h.second.number") - 1).alias("b"), "h.edit", "h.ref", "h.alt")
    if transcripts is not None:
        ends = x.filter("kind <> 'g'").select("id", C("accession").alias("tx"), "kind", F.posexplode(F.array("first", "second")).alias("e", "p")).select("id", "tx", "kind", "e", "p.*")
        at = to_genome(ends, transcripts).groupBy("id").agg(F.first("chr").alias("name"), F.first("strand").alias("strand"), F.max(F.when(C("e") == 0, C("position"))).alias("p0"), F.max(F.when(C("e") == 1, C("position"))).alias("p1"))
        at = at.filter("p0 is not null and p1 is not null").join(x.select("id", "edit", "ref", "alt"), "id")
        turn = lambda c: F.when(C("strand") == "-", reverse_complement(C(c))).otherwise(C(c)).alias(c)
        ground = ground.unionByName(at.select("id", "name", "strand", F.when(C("strand") == "-", C("p1")).otherwise(C("p0")).alias("a"), F.when(C("strand") == "-", C("p0")).otherwise(C("p1")).alias("b"), "edit", turn("ref"), turn("alt")))
    ground = ground.filter("b >= a and (edit <> 'ins' or b = a + 1)")
    insert = C("edit") == "ins"
    spans = ground.withColumn("start", F.when(insert, C("b")).otherwise(C("a"))).withColumn("end", F.when(insert, C("b")).otherwise(C("b") + 1))
    y = extract(pieces, spans, size)
    held = F.upper("bases")
    given = F.when(insert, "").otherwise(F.coalesce("ref", held))
    alt = F.when(C("edit") == "del", "").when(C("edit") == "dup", F.concat(held, held)).when(C("edit") == "same", given).otherwise(C("alt"))
    return y.select("id", "name", "start", given.alias("ref"), alt.alias("alt"))
