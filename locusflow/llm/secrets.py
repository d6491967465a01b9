"""Secret scan with an incremental blob ledger, in DataFrame operations only.

Every version of a document is addressed by the SHA-256 of its content. The
ledger holds which (blob, rule version) pairs were scanned and what was found;
each rule has a version of its own. A scan takes only the pairs that it lacks, one
representative of each blob and of each blob only the rules that are new to it,
adds them to the ledger, and joins the findings back to all paths that hold the
blob. A rule that changes gets a new version, and no other rule is scanned again.

Positions come without a Python function: the text between matches and the
matches themselves alternate, so a running sum of their lengths gives offsets.

Defined cases: a null text is the empty blob; a text without secrets has zero
counts, empty spans and the SHA-256 of the empty string; repeated rows each get
a row and share a scan; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusflow.llm.common import materialize, scratch, with_row_key


@dataclass(frozen=True)
class Rule:
    """group: the regex group whose length must reach least; version: changes with any of them."""

    kind: str
    pattern: str
    group: int
    least: int
    version: str = "1"


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Short runs would fail anyway; only whole runs match.
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)
SCANNED = "blob string"
FINDINGS = "blob string, start bigint, end bigint"


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind, start, end) of all secrets. blobs: (blob, text, new: whether to apply each of the rules)."""
    wanted = [F.get("new", F.lit(i)) for i in range(len(rules))]
    found = blobs.select("blob", "text", *[F.when(wanted[i], F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).alias(f"m{i}") for i, r in enumerate(rules)])
    found = found.filter(" or ".join(f"coalesce(size(m{i}), 0) > 0" for i in range(len(rules))))
    kinds = []
    for i, r in enumerate(rules):
        any_ = F.size(f"m{i}") > 0
        between = F.when(any_, F.split("text", r.pattern, -1))
        whole = F.transform(f"m{i}", lambda m: F.length(m).cast("long"))
        part = whole if not r.group else F.when(any_, F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)), lambda m: F.length(m).cast("long")))
        gaps = F.transform(between, lambda m: F.length(m).cast("long"))
        kinds.append(F.struct(F.lit(i).alias("kind"), F.arrays_zip(gaps.alias("gap"), whole.alias("len"), part.alias("part")).alias("z")))
    rows = found.select("blob", F.explode(F.array(*kinds)).alias("k")).filter("size(k.z) > 0")
    rows = rows.select("blob", "k.kind", F.posexplode("k.z").alias("pos", "x")).filter("x.len is not null")
    end = F.sum(F.col("x.gap") + F.col("x.len")).over(Window.partitionBy("blob", "kind").orderBy("pos"))
    least = F.array(*[F.lit(r.least) for r in rules])
    rows = rows.select("blob", "kind", end.alias("end"), F.col("x.len").alias("len"), "x.part").filter(F.col("part") >= F.element_at(least, F.col("kind") + 1))
    return rows.select("blob", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


class Ledger:
    """Two Parquet tables below a path, scanned blobs and findings, each in a folder for every version of a rule."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, table: str, rule: Rule, schema: str) -> DataFrame:
        at = f"{self.path}/{table}/{rule.kind}-{rule.version}"
        target = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        if not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(at)

    def scanned(self, rule: Rule) -> DataFrame:
        return self._read("scanned", rule, SCANNED)

    def findings(self, rule: Rule) -> DataFrame:
        """Copies of a finding, left by a scan that was cut short and repeated, count once."""
        return self._read("findings", rule, FINDINGS).distinct()

    def add(self, rule: Rule, scanned: DataFrame, findings: DataFrame) -> None:
        """Findings first: a blob whose findings weren't written never counts as scanned."""
        for table, rows in (("findings", findings), ("scanned", scanned)):
            rows.write.mode("append").parquet(f"{self.path}/{table}/{rule.kind}-{rule.version}")

    def update(self, versions: DataFrame, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scans what is new in versions and returns (path, blob) of all of them."""
        content = F.coalesce(F.col(text_col), F.lit(""))
        keyed, key = with_row_key(versions)
        keyed = keyed.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"), F.sha2(content.cast("binary"), 256).alias("blob"), *key)
        paths = materialize(keyed.select("path", "blob", *key), "paths")
        blobs = paths.groupBy("blob").agg(F.min(F.struct(*key)).alias("at"))
        for i, r in enumerate(rules):
            blobs = blobs.join(self.scanned(r).distinct().withColumn(f"seen{i}", F.lit(True)), "blob", "left")
        new = F.array(*[F.col(f"seen{i}").isNull() for i in range(len(rules))])
        unseen = blobs.select("blob", *[F.col(f"at.{k}").alias(k) for k in key], new.alias("new")).filter("exists(new, x -> x)")
        unseen = materialize(unseen, "unseen")
        texts = keyed.select("blob", *key, "text").join(unseen, ["blob", *key])
        # a text that hangs on the ledger's side can't be scanned before the join
        texts = texts.select("blob", "new", F.when(F.size("new") > 0, F.col("text")).alias("text"))
        found = materialize(scan(texts, rules), "found")
        for i, r in enumerate(rules):
            self.add(r, unseen.filter(F.get("new", F.lit(i))).select("blob"), found.filter(F.col("kind") == i).select("blob", "start", "end"))
        return paths.select("path", "blob")


def scan_secrets(docs: DataFrame, ledger_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row per document: doc_id, counts by kind, digest and list of the spans.
    Without a ledger_path the ledger is new, and ends with the driver."""
    spark = docs.sparkSession
    ledger = Ledger(spark, ledger_path or scratch(spark, "ledger"))
    paths = ledger.update(docs, id_col, text_col, rules)
    found = None
    for i, r in enumerate(rules):
        own = ledger.findings(r).select("blob", F.lit(i).alias("kind"), "start", "end")
        found = own if found is None else found.unionByName(own)
    names = F.array(*[F.lit(r.kind) for r in rules])
    spans = F.transform(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    count = [F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{r.kind}") for i, r in enumerate(rules)]
    per = materialize(found.groupBy("blob").agg(*count, F.array_join(spans, ",").alias("spans")), "findings")
    out = paths.join(per, "blob", "left")
    spans = F.coalesce("spans", F.lit(""))
    return out.select(F.col("path").alias("doc_id"), *[F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in rules], F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))
