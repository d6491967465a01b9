"""Tokenizers: a vocabulary of regions and special tokens, and conversions by joins.

A vocabulary is a table (token, name, chr, start, end, label, score): regions
numbered from 0 by their first appearance, special tokens after them with null
coordinates. Equal regions are one token.
"""

from __future__ import annotations

import os
import tomllib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusflow.operators import scoring
from locusflow.operators.primitives import by_range, iv_join, ranked
from locusflow.plans.scratch import materialize
from locusflow.sources import readers

C = F.col


def universe_rows(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end, label, score, ord) of a BED file with 3 columns or with 5
    and more, as its first line has; any other number of columns raises."""
    x = readers.lines(spark, path).filter("trim(value) <> ''")
    first = x.orderBy("block", "line").select("value").first()
    if first is None:
        raise ValueError(f"{path}: an empty universe")
    tabs, three = len(first["value"].split("\t")), len(first["value"].split()) == 3
    if not three and tabs < 5:
        raise ValueError(f"{path}: a universe has 3 columns, or 5 and more")
    f = F.split(F.trim("value"), r"\s+") if three else F.split("value", "\t", -1)
    x = x.withColumn("f", f)
    good = F.size("f") == 3 if three else F.size("f") >= 5
    wrong = F.raise_error(F.concat(F.lit("not a universe line: "), F.substring("value", 1, 200)))
    place = lambda i: F.when(good, F.get("f", F.lit(i))).otherwise(wrong.cast("string"))
    label, score = (F.lit(None).cast("string"), F.lit(None).cast("double")) if three else (place(3), F.trim(place(4)).cast("double"))
    x = x.select(place(0).alias("chr"), place(1).cast("long").alias("start"), place(2).cast("long").alias("end"), label.alias("label"), score.alias("score"), "block", "line")
    # numbered in each block, behind the blocks before it
    per = x.groupBy("block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("block").orderBy("line"))
    x = x.withColumn("k", inside).join(per.select("block", before.alias("b")), "block")
    return x.select("chr", "start", "end", "label", "score", (C("b") + C("k") - 1).cast("long").alias("ord"))


def vocabulary(regions: DataFrame, special: dict[str, str] | None = None, by_score: bool = False) -> DataFrame:
    """The vocabulary of (chr, start, end, ord) with, where there are, label and
    score: in the order of ord, a number; by_score: the highest score first."""
    more = {"label": "string", "score": "double"}
    x = regions.groupBy("chr", "start", "end").agg(F.min("ord").alias("ord"), *[F.max_by(n, "ord").alias(n) for n in more if n in regions.columns])
    if by_score:
        # scores may be a few values, so bins are ranges of rows; they are written, as ranges come from a sample
        down = -F.coalesce(C("score") if "score" in regions.columns else F.lit(None).cast("double"), F.lit(float("-inf")))
        x = materialize(by_range(x.withColumn("__s", down), "__s", "ord").withColumn("__range", F.spark_partition_id()), "ranges")
        x = ranked(x, [], "__range", ["__s", "ord"], "k", 1)
    else:
        x = ranked(x, [], "ord", ["ord"], "k")
    x = x.withColumns({n: F.lit(None).cast(kind) for n, kind in more.items() if n not in regions.columns})
    name = F.concat("chr", F.lit(":"), "start", F.lit("-"), "end")
    columns = ["token", "name", "chr", "start", "end", "label", "score"]
    out = x.select((C("k") - 1).alias("token"), name.alias("name"), "chr", "start", "end", "label", "score")
    names = [(special or {}).get(n, f"<{n}>") for n in scoring.SPECIAL]
    more = out.agg(F.count("*").alias("n")).select("n", F.posexplode(F.array(*[F.lit(n) for n in names])).alias("k", "name"))
    empty = {c: F.lit(None).cast(out.schema[c].dataType).alias(c) for c in columns[2:]}
    return out.unionByName(more.select((C("n") + C("k")).alias("token"), "name", *empty.values()))


class Tokenizer:
    """Regions to tokens and back. special: kind (unk, pad, ...) to the name of its token."""

    def __init__(self, table: DataFrame, special: dict[str, str] | None = None):
        self.table, self.special = table, {n: (special or {}).get(n, f"<{n}>") for n in scoring.SPECIAL}

    @classmethod
    def from_bed(cls, spark: SparkSession, path: str, special: dict[str, str] | None = None) -> Tokenizer:
        return cls(vocabulary(universe_rows(spark, path), special), special)

    @classmethod
    def from_config(cls, spark: SparkSession, path: str) -> Tokenizer:
        """path: a TOML file on the driver with universe (a path relative to it) and,
        optionally, special_tokens: a list of {name, token}."""
        with open(path, "rb") as f:
            config = tomllib.load(f)
        special = {x["name"]: x["token"] for x in config.get("special_tokens", [])}
        if unknown := sorted(set(special) - set(scoring.SPECIAL)):
            raise ValueError(f"{path}: unknown special tokens {unknown}")
        if config.get("tokenizer_type", "bits") not in ("bits", "ailist"):
            raise ValueError(f"{path}: unknown tokenizer type {config['tokenizer_type']}")
        return cls.from_bed(spark, os.path.join(os.path.dirname(os.path.abspath(path)), config["universe"]), special)

    @classmethod
    def from_auto(cls, spark: SparkSession, path: str) -> Tokenizer:
        if path.endswith(".toml"):
            return cls.from_config(spark, path)
        if path.endswith((".bed", ".bed.gz")):
            return cls.from_bed(spark, path)
        raise ValueError(f"{path}: neither .toml nor .bed nor .bed.gz")

    def regions(self) -> DataFrame:
        return self.table.filter("chr is not null")

    def encode(self, regions: DataFrame) -> DataFrame:
        """(id, token) of regions (chr, start, end, id); a row of the unknown token if none of them has any."""
        return self._encoded(regions, "token")

    def tokenize(self, regions: DataFrame) -> DataFrame:
        """encode() with names."""
        return self._encoded(regions, "token", "name")

    def _encoded(self, regions: DataFrame, *columns: str) -> DataFrame:
        """The hits are written, as they are asked for twice: they are the result, and whether there are any decides on the unknown token."""
        hits = iv_join(regions.select("chr", "start", "end", "id"), self.regions().select("chr", "start", "end", *columns))
        hits = materialize(hits.select(C("q_id").alias("id"), *[C(f"s_{c}").alias(c) for c in columns]), "hits")
        unknown = self.table.filter((C("name") == self.special["unk"]) & C("chr").isNull()).select(F.lit(None).cast(hits.schema["id"].dataType).alias("id"), *columns)
        return hits if hits.limit(1).count() else hits.unionByName(unknown)

    def names_of(self, tokens: DataFrame) -> DataFrame:
        """tokens (token, ...) with name; null where there is no such token."""
        return tokens.join(self.table.select("token", "name"), "token", "left").select(*tokens.columns, "name")

    def decode(self, tokens: DataFrame) -> DataFrame:
        """The same, the unknown token's name where there is no such token."""
        return self.names_of(tokens).withColumn("name", F.coalesce("name", F.lit(self.special["unk"])))

    def tokens_of(self, names: DataFrame) -> DataFrame:
        """names (name, ...) with token; null where there is none."""
        return names.join(self.table.select("name", "token"), "name", "left").select(*names.columns, "token")

    def special_mask(self, name: str = "name"):
        """Whether a column of names holds special tokens."""
        return C(name).isin(*self.special.values())

    def size(self) -> DataFrame:
        return self.table.agg(F.count("*").alias("size"))
