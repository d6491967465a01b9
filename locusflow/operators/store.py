"""A store of sequence collections as Parquet tables, with names, aliases and metadata.

Tables below a path: collections (collection, digest and level-1 digests, n),
members (collection, ord, name, length, sq), sequences in chunks (sq, chunk,
bases), aliases (kind, namespace, alias, digest) and metadata (digest, json).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusflow.functions.digests import sha512t24u
from locusflow.operators import sequences as seqs

C = F.col
ALIASES, METADATA = "kind string, namespace string, alias string, digest string", "digest string, json string"
#: Attributes that collections can be found by.
ATTRIBUTES = ("names", "lengths", "sequences", "sorted_sequences", "name_length_pairs", "sorted_name_length_pairs", "digest")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, table: str, schema: str | None = None) -> DataFrame:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if schema and not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.path}/{table}")

    def _replace(self, table: str, rows: DataFrame) -> None:
        """Writes beside the old table first: rows may be read from it."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        new, old = fs_path(f"{self.path}/{table}.new"), fs_path(f"{self.path}/{table}")
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}.new")
        fs = new.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(old, True)
        fs.rename(new, old)

    def add(self, records: DataFrame) -> None:
        """records (collection, ord, name, seq); collection is any label, the store names them by digest. Known collections and sequences are left out."""
        arrays = seqs.level2(records)
        level1 = seqs.level1(arrays).join(arrays.select("collection", F.size("names").cast("long").alias("n")), "collection")
        known = self._read("collections", "digest string, names string, lengths string, sequences string, sorted_sequences string, name_length_pairs string, sorted_name_length_pairs string, n long")
        fresh = level1.dropDuplicates(["digest"]).join(known.select("digest"), "digest", "left_anti")
        fresh = self.spark.createDataFrame(fresh.collect(), fresh.schema)  # a row a collection
        sq = F.concat(F.lit("SQ."), sha512t24u(F.upper("seq")))
        named = records.join(F.broadcast(fresh.select("collection", "digest")), "collection").withColumn("sq", sq)
        order = F.row_number().over(Window.partitionBy("digest").orderBy("ord"))
        held = self._read("chunks", "sq string, chunk int, bases string").select("sq").distinct()
        new = named.dropDuplicates(["sq"]).join(held, "sq", "left_anti")
        seqs.chunks(new.select(C("sq").alias("name"), F.upper("seq").alias("seq"))).select(C("name").alias("sq"), "chunk", "bases").write.mode("append").parquet(f"{self.path}/chunks")
        named.select("digest", (order - 1).cast("long").alias("ord"), "name", F.length("seq").cast("long").alias("length"), "sq").write.mode("append").parquet(f"{self.path}/members")
        fresh.drop("collection").select(*known.columns).write.mode("append").parquet(f"{self.path}/collections")

    def collections(self, page: int = 0, page_size: int | None = None, **attributes: str) -> DataFrame:
        """Collections in the order of their digests; attributes: name and level-1
        digest that they must have. With a page_size, one page: pages are counted from 0."""
        x = self._read("collections")
        for name, digest in attributes.items():
            if name not in ATTRIBUTES:
                raise ValueError(f"no attribute {name}")
            x = x.filter(C(name) == digest)
        x = x.orderBy("digest")
        return x if page_size is None else x.offset(page * page_size).limit(page_size)

    def members(self, digest: str) -> DataFrame:
        return self._read("members").filter(C("digest") == digest).orderBy("ord")

    def attribute(self, name: str, digest: str) -> DataFrame:
        """(ord, value) of the array with this level-1 digest, of names, lengths or sequences."""
        column = {"names": "name", "lengths": "length", "sequences": "sq"}[name]
        first = self._read("collections").filter(C(name) == digest).agg(F.min("digest").alias("digest"))  # one row
        return self._read("members").join(F.broadcast(first), "digest").select("ord", C(column).cast("string").alias("value")).orderBy("ord")

    def remove(self, digest: str) -> None:
        """The collection goes, and the sequences that no other holds."""
        self._replace("collections", self._read("collections").filter(C("digest") != digest))
        self._replace("members", self._read("members").filter(C("digest") != digest))
        self._replace("chunks", self._read("chunks").join(self._read("members").select("sq").distinct(), "sq", "left_semi"))

    def take_from(self, other: Store, digest: str) -> None:
        """Copies a collection of another store, unless it is here."""
        if not self._read("collections", "digest string").filter(C("digest") == digest).isEmpty():
            return
        members = other.members(digest)
        held = self._read("chunks", "sq string, chunk int, bases string").select("sq").distinct()
        other._read("chunks").join(members.select("sq").distinct(), "sq", "left_semi").join(held, "sq", "left_anti").write.mode("append").parquet(f"{self.path}/chunks")
        members.write.mode("append").parquet(f"{self.path}/members")
        other._read("collections").filter(C("digest") == digest).write.mode("append").parquet(f"{self.path}/collections")

    def sequences(self) -> DataFrame:
        """(sq, length) of all sequences."""
        return self._read("members").select("sq", "length").distinct()

    def substrings(self, regions: DataFrame) -> DataFrame:
        """regions (id, name, start, end), name a sequence's digest, with bases."""
        return seqs.extract(self._read("chunks").withColumnRenamed("sq", "name"), regions)

    def stream(self, sq: str) -> DataFrame:
        """(chunk, bases) of a sequence, in order."""
        return self._read("chunks").filter(C("sq") == sq).select("chunk", "bases").orderBy("chunk")

    def statistics(self) -> DataFrame:
        """(collections, sequences, bases), in one row."""
        s = self.sequences().agg(F.count("*").alias("sequences"), F.coalesce(F.sum("length"), F.lit(0)).alias("bases"))
        return self._read("collections").agg(F.count("*").alias("collections")).join(s)  # one row each

    # aliases and metadata

    def aliases(self) -> DataFrame:
        return self._read("aliases", ALIASES)

    def add_aliases(self, rows: DataFrame) -> None:
        """rows (kind, namespace, alias, digest), kind sequence or collection; one that is there is replaced."""
        keys = ["kind", "namespace", "alias"]
        self._replace("aliases", self.aliases().join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*keys, "digest")))

    def load_aliases(self, path: str, kind: str, namespace: str) -> None:
        """Tab-separated lines alias, digest; lines with # are skipped."""
        f = F.split("value", "\t")
        x = self.spark.read.text(path).filter(~C("value").rlike(r"^(#|\s*$)"))
        self.add_aliases(x.select(F.lit(kind).alias("kind"), F.lit(namespace).alias("namespace"), F.trim(f[0]).alias("alias"), F.trim(f[1]).alias("digest")))

    def remove_aliases(self, kind: str, namespace: str, alias: str | None = None) -> None:
        """One alias, or a whole namespace."""
        gone = (C("kind") == kind) & (C("namespace") == namespace) & (F.lit(True) if alias is None else C("alias") == alias)
        self._replace("aliases", self.aliases().filter(~gone))

    def resolve(self, names: DataFrame, kind: str) -> DataFrame:
        """names (namespace, alias, ...) with digest, null where there is none."""
        return names.join(self.aliases().filter(C("kind") == kind).drop("kind"), ["namespace", "alias"], "left")

    def named(self, digests: DataFrame, kind: str) -> DataFrame:
        """digests (digest, ...) with each namespace and alias that they have."""
        return digests.join(self.aliases().filter(C("kind") == kind).drop("kind"), "digest")

    def metadata(self) -> DataFrame:
        return self._read("metadata", METADATA)

    def set_metadata(self, rows: DataFrame) -> None:
        """rows (digest, json); that of a digest which has some is replaced. Raises where json isn't an object."""
        checked = F.when(F.try_parse_json("json").isNotNull() & C("json").rlike(r"^\s*\{"), C("json")).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("json", 1, 100))))
        self._replace("metadata", self.metadata().join(rows.select("digest"), "digest", "left_anti").unionByName(rows.select("digest", checked.alias("json"))))

    def remove_metadata(self, digest: str) -> None:
        self._replace("metadata", self.metadata().filter(C("digest") != digest))


def index_lines(members: DataFrame) -> DataFrame:
    """One text column: an index of (name, length, alphabet, sq, md5, ...) rows, behind a line of column names."""
    columns = [c for c in ("name", "length", "alphabet", "sq", "md5", "description") if c in members.columns]
    head = members.sparkSession.createDataFrame([(-1, "#" + "\t".join(columns))], "ord long, value string")
    body = members.select("ord", F.concat_ws("\t", *[F.coalesce(C(c).cast("string"), F.lit("")) for c in columns]).alias("value"))
    return head.unionByName(body).orderBy("ord").select("value")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The rows of index_lines() files, all columns strings but length."""
    x = spark.read.text(path)
    head = x.filter("value like '#name%'").first()["value"][1:].split("\t")
    f = F.split("value", "\t", -1)
    out = x.filter(~C("value").startswith("#")).select(*[f[i].alias(c) for i, c in enumerate(head)])
    return out.withColumn("length", C("length").cast("long"))
