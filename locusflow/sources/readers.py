"""Text formats as DataFrames. Plain and gzip files, single paths, globs and folders.

Each reader keeps file, block and line where order matters: ordering by the
three is the order of the lines in a file. Coordinates are 0-based, half-open.
A line that can't be parsed raises, unless a reader says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

C = F.col
ORDER = ["file", "block", "line"]


def lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(value, file, block, line); line grows within a block of a file."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    meta = [C("_metadata.file_path").alias("file"), C("_metadata.file_block_start").alias("block")]
    return reader.text(path).select("value", *meta, F.monotonically_increasing_id().alias("line"))


def _field(i: int) -> Column:
    return F.get("f", F.lit(i))


def _long(c: Column) -> Column:
    return c.try_cast("long")


def _must(c: Column, what: str) -> Column:
    return F.coalesce(c, F.raise_error(F.concat(F.lit(f"not a {what} line: "), F.substring("value", 1, 200))).cast("long"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end, rest, file, block, line); rest is null or columns 4 on.
    Lines of browser, track and # are skipped, and blank ones; so is a line of
    column names, where neither second nor third column is a number."""
    x = lines(spark, path).filter(~C("value").rlike(r"^(browser|track|#|\s*$)")).withColumn("f", F.split("value", "\t", -1))
    start, end = _long(_field(1)), _long(_field(2))
    x = x.filter((C("block") > 0) | start.isNotNull() | end.isNotNull() | (F.size("f") < 3))
    rest = F.when(F.size("f") > 3, F.array_join(F.slice("f", 4, F.size("f")), "\t"))
    return x.select(_field(0).alias("chr"), _must(start, "BED").alias("start"), _must(end, "BED").alias("end"), rest.alias("rest"), *ORDER)


def bed_loose(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end); a coordinate that is no number is -1."""
    x = lines(spark, path).withColumn("f", F.split("value", "\t", -1)).filter(F.size("f") >= 3)
    return x.select(_field(0).alias("chr"), *[F.coalesce(_long(_field(i)), F.lit(-1).cast("long")).alias(n) for i, n in ((1, "start"), (2, "end"))])


def chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    x = lines(spark, path).filter("trim(value) <> ''").withColumn("f", F.split(F.trim("value"), r"\s+"))
    return x.select(_field(0).alias("chr"), _must(_long(_field(1)), "sizes").alias("size"))


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end, barcode, support, file): five fields split at white space; # lines are skipped."""
    x = lines(spark, path).filter(~C("value").rlike(r"^(#|\s*$)")).withColumn("f", F.split(F.trim("value"), r"\s+"))
    return x.select(_field(0).alias("chr"), _must(_long(_field(1)), "fragment").alias("start"), _must(_long(_field(2)), "fragment").alias("end"), _field(3).alias("barcode"), _must(_long(_field(4)), "fragment").alias("support"), "file")


def barcode_map(spark: SparkSession, path: str) -> DataFrame:
    x = lines(spark, path).withColumn("f", F.split(F.trim("value"), r"\s+")).filter(F.size("f") >= 2)
    return x.select(_field(0).alias("key"), _field(1).alias("cluster"))


def file_stem(path: Column) -> Column:
    """The name of a file without folders and any extension."""
    return F.regexp_extract(path, r"([^/.]+)[^/]*$", 1)


def sam(spark: SparkSession, path: str) -> DataFrame:
    """(qname, flag, chr, pos, end, mapq, tlen, length, file, block, line). pos
    is 0-based; end is pos plus what the CIGAR covers of the reference; a mapq
    of 255 is null, and so is the position of an unplaced read."""
    x = lines(spark, path).filter(~C("value").rlike(r"^(@|\s*$)")).withColumn("f", F.split("value", "\t", -1))
    covered = F.aggregate(F.transform(F.regexp_extract_all(_field(5), F.lit(r"(\d+)[MDN=X]"), F.lit(1)), lambda n: n.cast("long")), F.lit(0).cast("long"), lambda a, n: a + n)
    pos = F.when(_long(_field(3)) > 0, _long(_field(3)) - 1)
    mapq = _must(_long(_field(4)), "SAM")
    length = F.when(_field(9) == "*", 0).otherwise(F.length(_field(9))).cast("long")
    return x.select(_field(0).alias("qname"), _must(_long(_field(1)), "SAM").alias("flag"), _field(2).alias("chr"), pos.alias("pos"), (pos + covered).alias("end"), F.when(mapq != 255, mapq).alias("mapq"), _long(_field(8)).alias("tlen"), length.alias("length"), *ORDER)


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, name, ref, alt, file, block, line): a row for each ALT that
    spells bases. Lines whose position isn't a number from 1 on are skipped."""
    x = lines(spark, path).filter(~C("value").rlike(r"^(#|\s*$)")).withColumn("f", F.split("value", "\t", 6))
    pos = _long(_field(1))
    x = x.filter((F.size("f") >= 5) & (pos >= 1)).select(_field(0).alias("chr"), (pos - 1).alias("start"), _field(2).alias("name"), F.upper(_field(3)).alias("ref"), F.explode(F.split(_field(4), ",")).alias("alt"), *ORDER)
    return x.filter(~C("alt").startswith("<") & ~C("alt").isin("*", ".", "")).withColumn("alt", F.upper("alt"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, seq, file, block, line), a row a record: records are
    the unit of splitting, so no task joins lines of another."""
    x = lines(spark, path, "\n>").filter("trim(value) not in ('', '>')")
    body = F.regexp_replace("value", "^>", "")
    head = F.regexp_extract(body, r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace(body, r"^[^\r\n]*", ""), r"\s+", "")
    description = F.trim(F.regexp_extract(head, r"^\S+\s+(.*)$", 1))
    return x.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.when(description != "", description).alias("description"), seq.alias("seq"), *ORDER)


def signal_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end, condition, value). Rows whose id isn't chr_start_end are dropped."""
    x = spark.read.csv(path, sep="\t", header=True)
    conditions = x.columns[1:]
    x = x.withColumn("f", F.split(C(f"`{x.columns[0]}`"), "_")).filter(F.size("f") == 3)
    x = x.select(_field(0).alias("chr"), _long(_field(1)).alias("start"), _long(_field(2)).alias("end"), *[C(f"`{c}`").cast("double").alias(c) for c in conditions])
    return x.filter("start is not null and end is not null").unpivot(["chr", "start", "end"], [C(f"`{c}`") for c in conditions], "condition", "value")


#: Endings of file names, without .gz, and what they hold; fixed values.
KINDS = {"bed": "bed", "narrowpeak": "narrowpeak", "broadpeak": "bed", "bam": "bam", "sam": "sam", "fa": "fasta", "fasta": "fasta", "fna": "fasta", "gtf": "gtf", "vcf": "vcf", "toml": "config"}


def kind_of(path: str) -> tuple[str, bool]:
    """(kind, gzip) of a file by its name; unknown for other endings."""
    name = path.lower()
    gz = name.endswith(".gz")
    return KINDS.get(name.removesuffix(".gz").rpartition(".")[2], "unknown"), gz


def scored_bed(spark: SparkSession, path: str, kind: str = "bed") -> DataFrame:
    """(chr, start, end, score): column 5 of a BED file, column 7 of a narrowPeak file; 1 where there is none."""
    x = bed(spark, path)
    column = F.get(F.split("rest", "\t", -1), F.lit({"bed": 1, "narrowpeak": 3}[kind]))
    return x.select("chr", "start", "end", F.coalesce(column.try_cast("double"), F.lit(1.0)).alias("score"))


def bed_list(spark: SparkSession, path: str, folder: str | None = None) -> list[str]:
    """The paths that a list of BED files names, one a line, on the driver: relative
    ones are in folder. Lines with # and blank ones are skipped."""
    rows = lines(spark, path).orderBy("block", "line").select(F.trim("value").alias("v")).filter("v <> '' and v not like '#%'").collect()
    return [r["v"] if "/" in r["v"][:1] or "://" in r["v"] or folder is None else f"{folder.rstrip('/')}/{r['v']}" for r in rows]


def region_sets(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(set_id, file, chr, start, end, rest) of BED files, or of those in a folder;
    set_id numbers the files by name from 0: a row a file is numbered."""
    x = bed(spark, paths)
    files = x.select("file").distinct().withColumn("set_id", (F.row_number().over(Window.orderBy("file")) - 1).cast("long"))
    return x.join(F.broadcast(files), "file").select("set_id", "file", "chr", "start", "end", "rest")
