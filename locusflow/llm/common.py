"""Helpers the corpus operators share: scratch tables and row keys."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusflow.plans.scratch import materialize, scratch, shared_dir  # noqa: F401

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package when it is not installed."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in [_ROOT, *paths] if p)


def fresh(columns: list[str], name: str) -> str:
    """name, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with a key of two columns, and their names: a 64-bit hash of the Parquet
    file's path, and the row's number in it. Copies of a row get different keys; a
    frame that isn't a plain Parquet scan is written first."""
    key = [fresh(df.columns, "__file"), fresh(df.columns, "__row")]

    def keyed(x: DataFrame) -> DataFrame:
        at = x.metadataColumn("_metadata")
        return x.select("*", F.xxhash64(at["file_path"]).alias(key[0]), at["row_index"].alias(key[1]))

    try:
        return keyed(df), key
    except Exception as e:
        if "_metadata" not in str(e):
            raise
    return keyed(materialize(df, "rows")), key


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with the sum of each column of sums over the rows before, in the given
    order. Rows are sorted in ranges; only a row a range is summed over all."""
    part = fresh([*df.columns, *sums], "__part")
    x = df.repartitionByRange(*order).select("*", F.spark_partition_id().alias(part), *[c.alias(f"__v_{n}") for n, c in sums.items()])
    x = materialize(x, "ranges")
    per = x.groupBy(part).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(part, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__t_{n}") for n in sums])
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(per, part)
    return x.select(*df.columns, *[(F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)) + F.col(f"__t_{n}")).alias(n) for n in sums])


def hash_sample(df: DataFrame, by: list[Column], rows: int, total: int) -> DataFrame:
    """The rows rows with the smallest hashes of by. Of a table of total rows only
    about 2 rows + 100 pass a threshold, so no task sends a sample of its own."""
    h = fresh(df.columns, "__hash")
    share = min(1.0, (2 * rows + 100) / max(1, total))
    low = df.withColumn(h, F.xxhash64(*by))
    if share < 1:
        low = low.filter(F.col(h) < int(-(2**63) + share * 2**64))
    return low.orderBy(h).limit(rows).drop(h)
