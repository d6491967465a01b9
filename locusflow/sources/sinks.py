"""Text sinks. Every sink writes a folder of part files; where the order counts,
the parts in the order of their names are the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusflow.operators.primitives import SWEEP_BIN, bin_of

C = F.col


def _text(df: DataFrame, path: str, gz: bool = False) -> None:
    df.write.mode("overwrite").option("compression", "gzip" if gz else "none").text(path)


def bed(df: DataFrame, path: str, gz: bool = False) -> None:
    """chr, start, end and, where df has it and it isn't null, rest; sorted."""
    rest = [C("rest")] if "rest" in df.columns else []
    _text(df.orderBy("chr", "start", "end").select(F.concat_ws("\t", "chr", "start", "end", *rest)), path, gz)


def bedgraph(track: DataFrame, path: str) -> None:
    """(chr, start, end, count) runs of positions from 1, as 0-based half-open lines."""
    _text(track.orderBy("chr", "start").select(F.concat_ws("\t", "chr", C("start") - 1, C("end") - 1, "count")), path)


def wig(track: DataFrame, path: str, size: int = SWEEP_BIN, step: int = 1) -> None:
    """Fixed-step blocks; starts and ends are in steps. Runs are cut at bins of
    positions, so no task writes a chromosome; each bin begins a block of its own."""
    bins = F.sequence(bin_of(C("start"), size), bin_of(C("end") - 1, size))
    x = track.withColumn("__bin", F.explode(bins))
    x = x.withColumn("start", F.greatest("start", C("__bin") * size)).withColumn("end", F.least("end", (C("__bin") + 1) * size))
    before = F.lag("end").over(Window.partitionBy("chr", "__bin").orderBy("start"))
    head = F.when(before.isNull() | (before < C("start")), F.concat(F.lit("fixedStep chrom="), "chr", F.lit(" start="), (C("start") * step).cast("string"), F.lit(f" step={step}\n"))).otherwise("")
    values = F.array_join(F.array_repeat(C("count").cast("string"), (C("end") - C("start")).cast("int")), "\n")
    x = x.withColumn("value", F.concat(head, values))
    _text(x.orderBy("chr", "start").select("value"), path)


def fasta(sequences: DataFrame, path: str, width: int = 60) -> None:
    """(name, seq) records with lines of width symbols."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    _text(sequences.select(F.concat(F.lit(">"), "name", F.lit("\n"), body)), path)


def numbered(values: DataFrame, column: str, prefix: int = 4) -> DataFrame:
    """(column, n): distinct values in order, from 1. Each prefix is numbered by itself, behind the prefixes before it."""
    x = values.select(column).distinct().withColumn("__p", F.substring(C(column).cast("string"), 1, prefix))
    per = x.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("__k", F.row_number().over(Window.partitionBy("__p").orderBy(C(column).cast("string"))))
    return x.join(per.select("__p", before.alias("__b")), "__p").select(column, (C("__b") + C("__k")).alias("n"))


def matrix_market(counts: DataFrame, path: str, row: str = "barcode", column: str = "peak", value: str = "n") -> None:
    """path/matrix, path/barcodes and path/features: sorted triplets from 1 behind their header."""
    rows, columns = numbered(counts, row), numbered(counts, column)
    x = counts.join(rows.withColumnRenamed("n", "__r"), row).join(columns.withColumnRenamed("n", "__c"), column)
    sizes = rows.agg(F.count("*").alias("r")).crossJoin(columns.agg(F.count("*").alias("c"))).crossJoin(counts.agg(F.count("*").alias("n")))  # one row each
    head = sizes.select(F.lit(-1).cast("long").alias("__r"), F.lit(-1).cast("long").alias("__c"), F.concat(F.lit("%%MatrixMarket matrix coordinate integer general\n"), F.concat_ws(" ", "r", "c", "n")).alias("value"))
    body = x.select("__r", "__c", F.concat_ws(" ", "__r", "__c", value).alias("value"))
    _text(head.unionByName(body).orderBy("__r", "__c").select("value"), f"{path}/matrix", gz=True)
    for part, name in ((rows, "barcodes"), (columns, "features")):
        _text(part.orderBy("n").select(C(part.columns[0]).cast("string")), f"{path}/{name}", gz=True)


def pseudobulk(fragments: DataFrame, path: str) -> None:
    """A folder of gzip BED files for each cluster of (chr, start, end, barcode, support, cluster)."""
    x = fragments.select("cluster", F.concat_ws("\t", "chr", "start", "end", "barcode", "support").alias("value"))
    x.write.mode("overwrite").partitionBy("cluster").option("compression", "gzip").text(path)


def wig_variable(track: DataFrame, path: str, size: int = SWEEP_BIN) -> None:
    """Variable-step lines of each position covered; bins of positions begin a block of their own."""
    bins = F.sequence(bin_of(C("start"), size), bin_of(C("end") - 1, size))
    x = track.withColumn("__bin", F.explode(bins))
    x = x.withColumn("start", F.greatest("start", C("__bin") * size)).withColumn("end", F.least("end", (C("__bin") + 1) * size))
    first = F.row_number().over(Window.partitionBy("chr", "__bin").orderBy("start")) == 1
    head = F.when(first, F.concat(F.lit("variableStep chrom="), "chr", F.lit("\n"))).otherwise("")
    values = F.array_join(F.transform(F.sequence("start", C("end") - 1), lambda p: F.concat_ws(" ", p.cast("string"), C("count").cast("string"))), "\n")
    _text(x.withColumn("value", F.concat(head, values)).orderBy("chr", "start").select("value"), path)


def dense_matrix(counts: DataFrame, path: str, row: str = "barcode", column: str = "peak", value: str = "n", columns: list | None = None) -> None:
    """A gzip CSV, a line a row and a field a column. columns: all of them, or those given; a line holds each, so they should be few."""
    x = counts.groupBy(row).pivot(column, columns).agg(F.sum(value)).na.fill(0)
    x.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


#: The columns of a table of enrichment results, and what they are made of; fixed values.
RESULTS = (
    ("userSet", lambda: (C("user_set") + 1).cast("string")), ("dbSet", lambda: (C("set_id") + 1).cast("string")), ("collection", lambda: C("collection")),
    ("pValueLog", lambda: F.format_string("%.4f", "p_value_log")), ("oddsRatio", lambda: F.when(F.isnan("odds_ratio"), "NaN").when(C("odds_ratio") == float("inf"), "inf").otherwise(F.format_string("%.4f", "odds_ratio"))), ("support", lambda: C("a").cast("string")),
    ("rnkPV", lambda: C("rnk_pv").cast("string")), ("rnkOR", lambda: C("rnk_or").cast("string")), ("rnkSup", lambda: C("rnk_sup").cast("string")), ("maxRnk", lambda: C("max_rnk").cast("string")), ("meanRnk", lambda: F.format_string("%.2f", "mean_rnk")),
    ("b", lambda: C("b").cast("string")), ("c", lambda: C("c").cast("string")), ("d", lambda: C("d").cast("string")), ("description", lambda: C("description")), ("cellType", lambda: C("cell_type")), ("tissue", lambda: C("tissue")),
    ("antibody", lambda: C("antibody")), ("treatment", lambda: C("treatment")), ("dataSource", lambda: C("data_source")), ("filename", lambda: C("filename")),
    ("qValue", lambda: F.when(C("q_value").isNull(), "NA").otherwise(F.regexp_replace(F.format_string("%.6e", "q_value"), "e([+-])0*([0-9])", "e$1$2"))), ("size", lambda: C("size").cast("string")),
)


def enrichment_results(results: DataFrame, path: str) -> None:
    """Annotated, ranked results with q-values as tab-separated lines, the surest first; sets are numbered from 1."""
    x = results.orderBy(C("p_value_log").desc(), "mean_rnk").select(*[F.coalesce(make(), F.lit("")).alias(name) for name, make in RESULTS])
    x.write.mode("overwrite").option("header", True).option("sep", "\t").option("emptyValue", "").csv(path)
