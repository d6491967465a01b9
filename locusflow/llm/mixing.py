"""Mixing sources to target weights by pivotal dependent rounding.

Every document should be copied target / source size times; the integral part is
sure, the fraction is a probability, at first the same for all of a source. A
step pairs a document with the pool of all smaller ones of its group, which
share one probability: words of probability mass move between the two, up or
down at random, as far as one of them becomes integral. Both ends and their odds
are such that the words expected of the group stay as they are, and so does each
document's expected number of copies. Largest documents come first, so what is
left undecided at the end is a small one.

Large documents of a source that is dealt to several buckets are settled against
the pool of its whole rest, one task a source; they are at most MOST_LARGE.
The rest is dealt to buckets by a hash; each leaves at most one document
undecided. Those go up a tree of buckets, FAN_IN to a node, where documents of
unequal probabilities are paired with all smaller ones or with one another, and
the last one of a source is rounded by its fraction.

Defined cases: a null text has size 0, is never copied; null is a source of its
own, the last; ties are broken by hashes of the row, and rows equal in id, size
and source are numbered, so that copies spread over buckets; sources of size 0
have target 0; an empty table stays empty; the operator's own columns give way to
columns of the table with their names. The same table gives the same result,
however it is partitioned.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusflow.llm.common import fresh, materialize, prepare, running, with_row_key

#: Documents a bucket is meant to hold (more where few or nearly all are taken, to MOST_ROWS), and buckets that a node of the tree joins.
BUCKET_ROWS, MOST_ROWS, FAN_IN = 2000, 10_000, 64
#: Large documents have over 1 / LARGE of the words that a bucket is expected to take or leave, and over 1 / MOST_LARGE of their source.
LARGE, MOST_LARGE = 4, 20_000
MAX_COPIES = 3
_EPS = 1e-9


def word_count(text) -> F.Column:
    """Runs of characters that aren't ASCII white space, JVM-side and without an array of words."""
    runs = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return (F.length(runs) - F.length(F.translate(runs, "x", ""))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size, target. sizes: a row per (source, source_size). A
    source is capped if its share at the level of those capped before it is above
    3 times its size. Ranks and sums run over ranges of the sources."""
    s = running(sizes, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = s.withColumn("w", cycle).withColumn("cap", F.col("source_size") * float(MAX_COPIES)).withColumn("at", F.col("cap") / F.col("w"))
    s = running(s, [F.col("at"), F.col("source").asc_nulls_last()], {"cap_before": F.col("cap"), "w_before": F.col("w")})
    whole = s.agg(F.sum("source_size").cast("double").alias("all"), F.sum("w").alias("all_w"))  # one row
    s = materialize(s.join(F.broadcast(whole)).withColumn("level", (F.col("all") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before"))), "levels")
    level = s.agg(F.min(F.when(F.col("at") >= F.col("level"), F.struct("at", "level")))["level"].alias("found"))  # one row
    s = s.join(F.broadcast(level))
    return s.select("source", "source_size", F.when(F.col("found").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("found") * F.col("w"))).alias("target"))


def pooled(sizes: list[int], share: float, rest: int, draw: Callable[[], float]) -> tuple[list[float], float]:
    """sizes: the largest documents of a group, in order; rest: the words of its
    others; share: the probability of all. Pairs each document with the pool of
    those after it. Returns the new probabilities of the documents and of the
    others; of both together at most one is a fraction if rest is 0."""
    rest += sum(sizes)
    mass, out = share * rest, []
    for x in sizes:
        pool, now = rest - x, mass / rest
        high = 1.0 if mass >= x else mass / x
        low = 0.0 if mass <= pool else (mass - pool) / x
        new = high if draw() * (high - low) < now - low else low
        out.append(new)
        rest, mass = pool, min(max(0.0, mass - new * x), float(pool))
    return out, mass / rest if rest else 0.0


def paired(sizes: np.ndarray, p: np.ndarray, draw: Callable[[], float]) -> np.ndarray:
    """The same of unequal probabilities: each document, largest first, is paired
    with all smaller ones where they can make it integral either way, in equal
    proportion up and down; the others are paired two by two."""
    s, q = sizes.astype(np.float64), p.copy()

    def snap(at) -> None:
        q[at] = np.where(q[at] < _EPS, 0.0, np.where(q[at] > 1 - _EPS, 1.0, q[at]))

    for i in range(len(q)):
        rest = np.arange(i + 1, len(q))
        rest = rest[(q[rest] > 0) & (q[rest] < 1)]
        if not 0 < q[i] < 1 or not len(rest):
            continue
        odds = q[i] / (1 - q[i])
        give = np.minimum(q[rest], (1 - q[rest]) / odds)
        can, need = float(s[rest] @ give), (1 - q[i]) * s[i]
        if can < need:
            continue
        taken = draw() < q[i]
        q[rest] += give * (need / can) * (-1.0 if taken else odds)
        q[i] = float(taken)
        snap(rest)
    held = -1
    for j in np.flatnonzero((q > 0) & (q < 1)).tolist():
        if held < 0:
            held = j
            continue
        i = held
        a, b = min(q[i] * s[i], (1 - q[j]) * s[j]), min((1 - q[i]) * s[i], q[j] * s[j])
        (x, y), moved = ((i, j), a) if draw() * (a + b) < b else ((j, i), b)
        q[x], q[y] = q[x] - moved / s[x], q[y] + moved / s[y]
        snap([i, j])
        still = [k for k in (i, j) if 0 < q[k] < 1]
        held = still[0] if still else -1
    return q


def settle(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator, last: bool) -> np.ndarray:
    """Probabilities of one group, largest documents first, all but at most one integral; all if last."""
    q, open_ = p.astype(np.float64), np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    q[p <= _EPS], q[p >= 1 - _EPS] = 0.0, 1.0
    if len(open_):
        own = q[open_]
        if own.max() - own.min() < 1e-12:
            q[open_] = pooled(sizes[open_].tolist(), float(own[0]), 0, rng.random)[0]
        else:
            q[open_] = paired(sizes[open_], own, rng.random)
    q[q < _EPS], q[q > 1 - _EPS] = 0.0, 1.0
    if last:
        for i in np.flatnonzero((q > 0) & (q < 1)):
            q[i] = float(rng.random() < q[i])
    return q


def _rng(seed: int, level: int, source: str | None, bucket: int) -> np.random.Generator:
    name = b"" if source is None else b"s" + str(source).encode("utf-8", "surrogatepass")
    return np.random.default_rng([seed, level, bucket, xxhash.xxh64_intdigest(name)])


def _level(columns: list[str], seed: int, level: int):
    """Settles each (source, bucket) of a cell; buckets of sources with one bucket left (top) are the last."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "tie", "copy"], ascending=[False, True, True], kind="stable")
        out = []
        for (source, bucket), part in rows.groupby(["source", "bucket"], sort=False, dropna=False):
            source = None if pd.isna(source) else source
            p = settle(part["size"].to_numpy(np.int64), part["p"].to_numpy(np.float64), _rng(seed, level, source, int(bucket)), bool(part["top"].iloc[0]))
            out.append(part.assign(p=p, extra=(p == 1).astype(np.int64), done=(p == 0) | (p == 1)))
        return pd.concat(out)[columns]

    return run


def _settle_large(seed: int):
    """The large documents of a source against its whole rest; a row without a size holds what becomes of the rest."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "tie", "copy"], ascending=[False, True, True], kind="stable")
        source = rows["source"].iloc[0]
        source = None if pd.isna(source) else source
        rng, sizes = _rng(seed, -1 & 0xFFFF, source, 0), rows["size"].tolist()
        q, share = pooled(sizes, float(rows["p"].iloc[0]), int(rows["words"].iloc[0]) - sum(sizes), rng.random)
        q = [0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x for x in [*q, share]]
        out = pd.concat([rows, rows.iloc[:1].assign(size=-1)])
        return out.assign(p=q, extra=[int(x == 1) for x in q], done=[x in (0.0, 1.0) for x in q])[list(rows.columns)]

    return run


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with copy: a number for each of the rows equal in doc_id, source and
    size. They are counted where they lie and numbered behind the tasks before,
    so that no task gets all copies of a row."""
    keys = ["doc_id", "source", "size"]
    if rows.groupBy(*keys).count().filter("count > 1").isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    rows = materialize(rows.withColumn("task", F.spark_partition_id()), "tasks")
    inside = F.row_number().over(Window.partitionBy("task", *keys).orderBy("order"))
    rows = rows.withColumn("inside", inside)
    counts = rows.groupBy(*keys, "task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("task").alias("_task"), before.alias("before")).filter("before > 0")
    same = F.col("task") == F.col("_task")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    rows = rows.join(counts, same, "left").withColumn("copy", F.col("inside") + F.coalesce("before", F.lit(0)) - 1)
    return materialize(rows.drop("task", "inside", "before", "_task", *[f"_{k}" for k in keys]), "numbered")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), seed: int = 7, keep: tuple[str, ...] = (), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, copies, and the columns in keep: a row per document."""
    prepare(docs.sparkSession)
    # ids go through pandas as text: nullable integers would become doubles there
    id_type = docs.schema[id_col].dataType
    base = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.monotonically_increasing_id().alias("order"), *keep)
    base = _numbered(materialize(base, "sizes"))
    per = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("docs"))
    per = materialize(per, "sources")
    found = targets(per.select("source", "source_size"), weights)
    found = found.join(per.select(F.col("source").alias("__s"), "docs"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(MAX_COPIES)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    ratio = F.when(F.abs(ratio - F.round(ratio)) < _EPS, F.round(ratio)).otherwise(ratio)
    found = found.withColumn("ratio", ratio).withColumn("whole", F.floor("ratio").cast("long")).withColumn("share", F.col("ratio") - F.floor("ratio"))
    odds = F.greatest(F.lit(_EPS), F.least("share", 1 - F.col("share")))
    rows_each = F.least(F.lit(float(MOST_ROWS)), F.greatest(F.lit(float(bucket_rows)), bucket_rows / (2 * odds)))
    found = found.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("docs") / rows_each)).cast("long"))
    found = found.withColumn("large", F.when(F.col("buckets") > 1, F.greatest(odds * F.col("source_size") / (F.col("buckets") * LARGE), F.col("source_size") / MOST_LARGE)))
    found = materialize(found.select(F.col("source").alias("__s"), "source_size", "target", "whole", "share", "buckets", "large"), "targets")

    rows = base.join(found, F.col("source").eqNullSafe(F.col("__s"))).drop("__s", "order")
    rows = rows.withColumn("tie", F.xxhash64("doc_id", "size", F.lit(seed)))
    rows = rows.withColumn("p", F.when(F.col("size") > 0, F.col("share")).otherwise(0.0)).withColumn("extra", F.lit(0).cast("long")).withColumn("done", F.col("p") == 0)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "copy"), "buckets"))
    out = ["doc_id", "source", "size", "copy", "tie", "source_size", "target", "whole", "buckets", "bucket", "p", "extra", "done", *keep]
    is_large = F.coalesce(F.col("size") > F.col("large"), F.lit(False))
    open_, settled = rows.filter("not done"), [rows.filter("done").select(*out)]

    # large documents first, against the whole rest of their source; what becomes of the rest is a row a source
    big = open_.filter(is_large).select(*out, F.col("source_size").alias("words"))
    big = materialize(big.groupBy("source").applyInPandas(_settle_large(seed), big.schema).withColumn("bucket", F.lit(0).cast("long")), "large")
    settled.append(big.filter("done and size >= 0").select(*out))
    shares = big.filter("size < 0").select(F.col("source").alias("__s"), F.col("p").alias("__p"))
    small = open_.filter(~is_large).join(shares, F.col("source").eqNullSafe(F.col("__s")), "left").withColumn("p", F.coalesce("__p", "p")).select(*out)
    level, cell_rows, left = 0, bucket_rows, None
    total = open_.count()
    while total:
        current = small if left is None else left
        current = current.withColumn("top", F.lit(level > 0) & (F.col("buckets") <= 1)).withColumn("cell", F.pmod(F.xxhash64("source", "bucket"), F.lit(max(1, -(-total // cell_rows)))))
        step = materialize(current.groupBy("cell").applyInPandas(_level([*out, "top"], seed, level), current.drop("cell").schema), "mixed")
        settled.append(step.filter("done").select(*out))
        up = step.filter("not done").select(*out)
        if level == 0:
            up = up.unionByName(big.filter("not done and size >= 0").select(*out))
        left = up.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long")).withColumn("buckets", F.ceil(F.col("buckets") / FAN_IN).cast("long"))
        total, level = left.count(), level + 1
    every = settled[0]
    for more in settled[1:]:
        every = every.unionByName(more)
    return every.select(F.col("doc_id").cast(id_type).alias("doc_id"), "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies"), *keep)


def op7_result(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents, each as many times as the mix takes it; all columns stay.
    Texts are joined to the decisions by sorted runs, at every size."""
    names = docs.columns
    keyed, key = with_row_key(docs)
    n = fresh(names, "__n")
    taken = materialize(mix(keyed, id_col, text_col, source_col, keep=tuple(key)).filter("copies > 0").select(*key, F.col("copies").alias(n)), "taken")
    out = keyed.join(taken.hint("merge"), key)
    return out.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*names)
