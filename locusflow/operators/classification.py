"""What kind of BED a table is: how many of its leading columns follow the
standard, and which known layout the others have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col
_COLOUR = r"(\d|[1-9]\d|1\d\d|2[0-4]\d|25[0-5])"
_BLOCKS = r"^(\d+(,\d+)*)?,?$"
#: Columns after the standard ones of known layouts: name, columns in all, where the others begin, what they are.
LAYOUTS = (
    ("encode_narrowpeak", 10, 6, ("real", "real", "real", "whole")),
    ("encode_broadpeak", 9, 6, ("real", "real", "real")),
    ("encode_rna_elements", 9, 6, ("real", "real", "counted")),
    ("encode_gappedpeak", 15, 12, ("real", "real", "real")),
)


def fields(df: DataFrame) -> DataFrame:
    """chr, start, end and rest as one array of strings, f."""
    return df.select(F.concat(F.array("chr", C("start").cast("string"), C("end").cast("string")), F.when(C("rest").isNotNull(), F.split("rest", "\t", -1)).otherwise(F.array().cast("array<string>"))).alias("f"))


def classify(df: DataFrame, width: int = 16) -> DataFrame:
    """One row (compliance, format, compliant_columns, other_columns) of a table
    (chr, start, end, rest), in one aggregation. compliance is bedN+M; format is
    ucsc_bed, bed_like or one of LAYOUTS, with _rs where scores exceed 1000. A
    table without rows, or of uneven width, is unknown."""
    x = fields(df)
    cell = lambda i: F.get("f", F.lit(i))
    whole = lambda i: cell(i).try_cast("long")
    every = lambda c: F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(False))
    some = lambda c: F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False))
    natural = lambda i: every(whole(i) >= 0)
    standard = {
        0: every(cell(0).rlike(r"[A-Za-z0-9_]{1,255}")), 1: natural(1), 2: natural(2), 3: every(cell(3).rlike(r"[\x20-\x7e]{1,255}")), 4: natural(4),
        5: every(cell(5).isin("+", "-", ".")), 6: natural(6), 7: natural(7), 8: every(cell(8).rlike(f"^{_COLOUR}(,{_COLOUR}){{0,2}}$")),
        9: every(whole(9).isNotNull()), 10: every(cell(10).rlike(_BLOCKS)), 11: every(cell(11).rlike(_BLOCKS)),
    }
    # a column of numbers is real if some of them has a fraction, or if all are -1
    number = lambda i: cell(i).try_cast("double")
    made = [s.alias(f"s{i}") for i, s in standard.items()]
    for i in range(6, width):
        made += [(every(number(i).isNotNull()) & some(whole(i).isNull()) | every(whole(i) == -1)).alias(f"real{i}"), every(whole(i).isNotNull()).alias(f"whole{i}"), (every(whole(i).isNotNull()) & some(whole(i) != -1)).alias(f"counted{i}")]
    one = x.agg(F.min(F.size("f")).alias("low"), F.max(F.size("f")).alias("high"), every(whole(4) <= 1000).alias("small"), *made)
    good = F.lit(0)
    for i in reversed(range(12)):  # standard columns up to the first that isn't one
        good = F.when(C(f"s{i}") & (C("high") > i), good + 1).otherwise(0)
    one = one.withColumn("good", good).withColumn("relaxed", (C("good") > 4) & ~C("small"))
    layout = F.lit(None).cast("string")
    for name, columns, first, kinds in reversed(LAYOUTS):
        fits = (C("high") == columns) & (C("good") == first)
        for k, kind in enumerate(kinds):
            fits &= C(f"{kind}{first + k}")
        layout = F.when(fits, F.lit(name)).otherwise(layout)
    others = C("high") - C("good")
    plain = F.when((others == 0), "ucsc_bed").otherwise("bed_like")
    known = F.concat(F.coalesce(layout, plain), F.when(C("relaxed"), "_rs").otherwise(""))
    none = C("high").isNull() | (C("low") != C("high")) | (C("high") < 3)
    return one.select(
        F.when(none, "unknown_bed_compliance").otherwise(F.concat(F.lit("bed"), C("good").cast("string"), F.lit("+"), others.cast("string"))).alias("compliance"),
        F.when(none, "unknown").otherwise(known).alias("format"), F.when(none, 0).otherwise(C("good")).cast("long").alias("compliant_columns"), F.when(none, 0).otherwise(others).cast("long").alias("other_columns"),
    )
