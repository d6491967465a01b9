"""Databases of region sets: a table of regions and one of annotations.

regions: (set_id, chr, start, end); sets: (set_id, filename, collection,
description, cell_type, tissue, antibody, treatment, data_source).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusflow.operators import overlaps
from locusflow.sources import readers

C = F.col
#: Annotations, and the names of their columns in an index file; fixed values.
ANNOTATIONS = {"description": "description", "cell_type": "cellType", "tissue": "tissue", "antibody": "antibody", "treatment": "treatment", "data_source": "dataSource"}


def _part(path, back: int):
    """A component of a path, counted from the end, its escapes undone."""
    return F.url_decode(F.replace(F.element_at(F.split(path, "/"), -back), F.lit("+"), F.lit("%2B")))


def index_files(spark: SparkSession, path: str) -> DataFrame:
    """(collection, filename, annotations) of the lines of path/*/index.txt: a
    header and rows, with tabs, or commas if the header has no tab."""
    x = readers.lines(spark, path).filter("trim(value) <> ''")
    heads = x.groupBy("file").agg(F.min_by("value", F.struct("block", "line")).alias("head"), F.min(F.struct("block", "line")).alias("at"))
    x = x.join(heads, "file").filter(F.struct("block", "line") != C("at"))
    comma = C("head").contains(",") & ~C("head").contains("\t")
    cells = lambda c: F.transform(F.when(comma, F.split(c, ",", -1)).otherwise(F.split(c, "\t", -1)), F.trim)
    x = x.select(_part(C("file"), 2).alias("collection"), cells("head").alias("h"), cells("value").alias("v"))
    value = lambda name: F.get("v", F.array_position("h", F.lit(name)).cast("int") - 1)
    text = lambda name: F.when(F.array_contains("h", F.lit(name)) & (value(name) != ""), value(name))
    return x.select("collection", F.coalesce(text("filename"), F.lit("")).alias("filename"), *[text(c).alias(n) for n, c in ANNOTATIONS.items()]).dropDuplicates(["collection", "filename"])


@dataclass
class RegionDB:
    regions: DataFrame
    sets: DataFrame

    @classmethod
    def from_folder(cls, spark: SparkSession, path: str, collections: list[str] | None = None, limit: int | None = None) -> RegionDB:
        """path/collection/regions/* are BED files, numbered by collection and file
        name; path/collection/index.txt annotates them. limit: files of a collection."""
        rows = readers.bed(spark, f"{path}/*/regions/*").select("chr", "start", "end", _part(C("file"), 3).alias("collection"), _part(C("file"), 1).alias("filename"))
        files = rows.select("collection", "filename").distinct()
        if collections is not None:
            files = files.filter(C("collection").isin(*collections))
        if limit is not None:
            files = files.withColumn("k", F.row_number().over(Window.partitionBy("collection").orderBy("filename"))).filter(C("k") <= limit).drop("k")
        files = files.withColumn("set_id", (F.row_number().over(Window.orderBy("collection", "filename")) - 1).cast("long"))  # a row a file
        try:
            notes = index_files(spark, f"{path}/*/index.txt")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            notes = spark.createDataFrame([], "collection string, filename string, " + ", ".join(f"{n} string" for n in ANNOTATIONS))
        sets = files.join(notes, ["collection", "filename"], "left").withColumn("description", F.coalesce("description", "collection"))
        return cls(rows.join(files, ["collection", "filename"]).select("set_id", "chr", "start", "end"), sets.select("set_id", "filename", "collection", *ANNOTATIONS))

    @classmethod
    def from_sets(cls, regions: DataFrame, names: DataFrame | None = None) -> RegionDB:
        """regions with set_id; names: (set_id, filename). Rows without bases, or that begin before 0, are left out."""
        kept = regions.filter("0 <= start and start < end").select("set_id", "chr", "start", "end")
        named = regions.select("set_id").distinct().join(names, "set_id", "left") if names is not None else regions.select("set_id").distinct().withColumn("filename", F.lit(None).cast("string"))
        named = named.withColumn("filename", F.coalesce("filename", F.concat(F.lit("set_"), C("set_id").cast("string"))))
        nothing = [F.lit(None).cast("string").alias(n) for n in ("collection", *ANNOTATIONS)]
        return cls(kept, named.select("set_id", "filename", *nothing))

    def merge(self, other: RegionDB) -> RegionDB:
        """Both; the sets of other are numbered behind those of this one."""
        shift = F.broadcast(self.sets.agg((F.coalesce(F.max("set_id"), F.lit(-1)) + 1).alias("__n")))  # one row
        moved = lambda df: df.join(shift).withColumn("set_id", C("set_id") + C("__n")).drop("__n")
        return RegionDB(self.regions.unionByName(moved(other.regions)), self.sets.unionByName(moved(other.sets)))

    def list(self, collections: list[str] | None = None) -> DataFrame:
        chosen = self.sets if collections is None else self.sets.filter(C("collection").isin(*collections))
        return chosen.select("set_id", "filename")

    def get(self, filenames: list[str], collections: list[str] | None = None) -> DataFrame:
        """The regions of the sets with these names."""
        chosen = self.list(collections).filter(C("filename").isin(*filenames))
        return self.regions.join(chosen, "set_id")

    def search(self, queries: DataFrame, min_overlap: int = 1) -> DataFrame:
        """(set_id, filename, size, pairs, queries) of the sets that queries (chr, start, end, id) hit."""
        hits = overlaps.hits_per_set(queries, self.regions, min_overlap)
        return hits.join(self.sizes(), "set_id").join(self.sets.select("set_id", "filename"), "set_id").select("set_id", "filename", "size", "pairs", "queries")

    def sizes(self) -> DataFrame:
        return self.regions.groupBy("set_id").agg(F.count("*").alias("size"))

    def annotate(self, results: DataFrame) -> DataFrame:
        """results (set_id, ...) with the annotations, descriptions cut to 80 characters, and the sets' sizes."""
        notes = self.sets.withColumn("description", F.substring("description", 1, 80)).join(self.sizes(), "set_id", "left")
        return results.join(notes.withColumn("size", F.coalesce("size", F.lit(0).cast("long"))), "set_id", "left")

    def save(self, path: str) -> None:
        """Parquet tables; regions are partitioned by chromosome."""
        self.regions.write.mode("overwrite").partitionBy("chr").parquet(f"{path}/regions")
        self.sets.write.mode("overwrite").parquet(f"{path}/sets")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RegionDB:
        return cls(spark.read.parquet(f"{path}/regions").select("set_id", "chr", "start", "end"), spark.read.parquet(f"{path}/sets"))
