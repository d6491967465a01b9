"""The corpus pipeline: toxic documents go, one of each near-duplicate group
stays, personal data is masked, sources are mixed, and the rest is packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's docs. All but the last return the
columns of documents. The mix repeats rows where it takes a document more than
once, so packing places each repeat.

Defined cases, for every stage: an empty table gives an empty table; extra
columns stay to the last stage, also under names that an operator uses itself;
rows with a null id or source, repeated rows and very long texts go through
like any others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locusflow.llm import mixing, packing, pii, simhash, toxicity
from locusflow.llm.common import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5. A null text scores as an empty one; with an
    empty or one-sided labels table all score alike, and stay unless labels say toxic."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group that similarity links: the one with the smallest id, null
    ids last. All texts without words are one group."""
    return simhash.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found spans replaced by the name of their kind; n_chars follows
    the new text; a null text stays null."""
    return pii.mask_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to 3 times; those of no words
    never. Null is a source of its own."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places; a null text is its end token."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokens, fingerprints and learned scores have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None
