"""A bounded sample of labelled documents, for the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm.common import materialize


def held_out(id_col: str, parts: int, out: int) -> F.Column:
    """crc32 of the id as text, modulo parts, is out. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == out, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, out: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, y): of the labelled ids that aren't held out and have one
    label, those with the rows smallest hashes. The broadcast is of at most rows ids."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col, parts, out))
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("y"), F.max(F.col(label).cast("int")).alias("__y"))
    known = known.filter("y = __y").select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    known = materialize(known, "sample-ids")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return materialize(texts.join(F.broadcast(known), "doc_id"), "sample")
