"""Interval tables made from the test tables, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.operators.primitives import deal

_SQL = {
    "iv_a": """SELECT *, chr || ':' || start || '-' || "end" AS id FROM (SELECT DISTINCT 'chr' || (l_suppkey % 10 + 1) AS chr, l_orderkey * 20 + l_linenumber * 3 AS start, l_orderkey * 20 + l_linenumber * 3 + CAST(l_quantity AS BIGINT) AS "end" FROM lineitem)""",
    "iv_b": """SELECT 'chr' || (o_custkey % 10 + 1) AS chr, o_orderkey * 20 AS start, o_orderkey * 20 + 10 + o_custkey % 40 AS "end", o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM orders""",
    "sizes": """SELECT chr, CAST(max("end") + 100 AS BIGINT) AS size FROM iv_a GROUP BY chr""",
    "sets": """SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS set_id, 'chr' || (l_suppkey % 10 + 1) AS chr, l_orderkey * 20 + l_linenumber * 3 AS start, l_orderkey * 20 + l_linenumber * 3 + CAST(l_quantity AS BIGINT) AS "end" FROM lineitem""",
    "fragments": """SELECT 'chr' || (user_id % 5 + 1) AS chr, event_id * 10 AS start, event_id * 10 + CAST(floor(value) AS BIGINT) % 200 + 10 AS "end", user_id AS barcode, event_id AS id FROM events""",
    "parts": """SELECT chr, start, "end", o % 3 AS priority FROM (SELECT 'chr' || (o_custkey % 10 + 1) AS chr, o_orderkey * 20 + 5 AS start, o_orderkey * 20 + 25 AS "end", o_orderkey AS o FROM orders)""",
}


def with_views(sql: str) -> str:
    """sql behind the definitions of the views that it or they name."""
    used: list[str] = []

    def need(text: str) -> None:
        for name, body in _SQL.items():
            if name in text and name not in used:
                need(body)
                used.append(name)

    need(sql)
    ctes = ", ".join(f"{n} AS ({_SQL[n]})" for n in used)
    body = sql.strip()
    if not ctes:
        return body
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"


class Tables:
    """The same views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _line(self) -> list:
        start = F.col("l_orderkey") * 20 + F.col("l_linenumber") * 3
        return [F.concat(F.lit("chr"), F.col("l_suppkey") % 10 + 1).alias("chr"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end")]

    @property
    def a(self) -> DataFrame:
        return deal(self.read("lineitem").select(*self._line()), "chr", "start", "end").distinct().withColumn("id", F.concat("chr", F.lit(":"), "start", F.lit("-"), "end"))

    @property
    def b(self) -> DataFrame:
        start, key = F.col("o_orderkey") * 20, F.col("o_custkey")
        chr_ = F.concat(F.lit("chr"), key % 10 + 1)
        return self.read("orders").select(chr_.alias("chr"), start.alias("start"), (start + 10 + key % 40).alias("end"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"))

    @property
    def sizes(self) -> DataFrame:
        return self.a.groupBy("chr").agg((F.max("end") + 100).alias("size"))

    @property
    def sets(self) -> DataFrame:
        return deal(self.read("lineitem").select(F.col("l_linenumber").cast("long").alias("set_id"), *self._line()), "set_id", "chr", "start", "end").distinct()

    @property
    def set_ids(self) -> DataFrame:
        return self.read("lineitem").select(F.col("l_linenumber").cast("long").alias("set_id")).distinct()

    @property
    def fragments(self) -> DataFrame:
        start = F.col("event_id") * 10
        return self.read("events").select(F.concat(F.lit("chr"), F.col("user_id") % 5 + 1).alias("chr"), start.alias("start"), (start + F.floor("value") % 200 + 10).alias("end"), F.col("user_id").alias("barcode"), F.col("event_id").alias("id"))

    @property
    def parts(self) -> DataFrame:
        o = F.col("o_orderkey")
        return self.read("orders").select(F.concat(F.lit("chr"), F.col("o_custkey") % 10 + 1).alias("chr"), (o * 20 + 5).alias("start"), (o * 20 + 25).alias("end"), (o % 3).alias("priority"))
