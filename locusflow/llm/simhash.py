"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within 2 bits share a value within 1 bit of both. So every
distinct fingerprint is emitted under itself and its 64 one-bit variants, the
variants are shuffled, and fingerprints that meet under one are linked after a
check of their distance. Those that meet under one variant are all within 2
bits of each other, so a chain through a group (at most 65 members) keeps the
group connected without all its pairs. Components come from contraction: each
node takes its least neighbour, paths are halved until they end in a root, and
the graph of roots is contracted anew until no edge is left.

Defined cases: a null text has no words, and texts without words have
fingerprint 0, linked like any other; fewer words than a shingle give one
shingle of all words; ties and repeated rows share a component; rows with a null
id keep a row and take no part in the least id; an empty table stays empty.

The pipeline's stage (keep_one) is about similarity instead: five-word shingles
and a Jaccard index of 0.8 or more. Its candidates come from the same balls, over
fingerprints of the distinct five-word shingles (near_duplicates). Texts of 0.8
differ in up to a dozen bits, and balls of that radius have millions of variants.
So components that the balls leave apart are joined where their texts share a
MinHash band (two sets of 0.8 share none once in 10^11 times), and in each joined
component the true similarities decide. A component of up to GATHER_BYTES is
settled in one task. Larger ones are searched in rounds over many tasks: sets
reached so far, CENTRES at a time, against those not reached, or all of them
against what is left once that is small; no task holds more than a chunk of either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusflow.llm.common import materialize, prepare, with_row_key

#: Shingles whose bits are counted at once, to bound memory on very long texts.
BLOCK = 1 << 16
#: The stage's shingle, its least Jaccard index as a fraction, and the bands of its signatures with the minima in each.
STAGE_SHINGLE, LEAST, BANDS, MINIMA = 5, (4, 5), 64, 5
#: Bytes of shingle hashes that a task settles at once, and sets that a round holds against all others.
GATHER_BYTES, CENTRES = 64 << 20, 256
_RNG = np.random.default_rng(42)
_FACTORS = _RNG.integers(0, 1 << 32, BANDS * MINIMA, dtype=np.uint32) | np.uint32(1)
_TERMS = _RNG.integers(0, 1 << 32, BANDS * MINIMA, dtype=np.uint32)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64 bits: bit i is set if over half the shingle hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(shingle, len(words)) - 1 :]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        a, b = starts[at : min(n, at + BLOCK)].tolist(), last[at : at + BLOCK].tolist()
        h = np.fromiter((digest(joined[x:y], seed) for x, y in zip(a, b)), np.uint64, len(a))
        counts += bit_counts(h)
    return majority(counts, n)


def fingerprint_udf(shingle: int, seed: int):
    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64))

    return run


def ball_edges(fps: DataFrame) -> DataFrame:
    """(a, b) of distinct fingerprints (column fp) within 2 bits; connected as the full graph is."""
    variants = fps.select("fp", F.explode(F.array(F.lit(0).cast("long"), *[F.lit(v - (1 << 64) if v >> 63 else v).cast("long") for v in (1 << i for i in range(64))])).alias("m"))
    variants = variants.select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("v"))
    before = F.lag("fp").over(Window.partitionBy("v").orderBy("fp"))
    pairs = variants.withColumn("b", before).filter("b is not null and bit_count(fp ^ b) <= 2")
    return pairs.select(F.col("b").alias("a"), F.col("fp").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the undirected edges (a, b), a != b."""
    edges, labels = materialize(edges, "edges"), None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "parents")
        while True:
            up = parents.select(F.col("node").alias("label"), F.col("label").alias("top"))
            jumped = materialize(parents.join(up, "label").select("node", "label", "top"), "jumps")
            moved = jumped.filter("label != top").isEmpty()
            parents = jumped.select("node", F.col("top").alias("label"))
            if moved:
                break
        root = lambda c, to: parents.select(F.col("node").alias(c), F.col("label").alias(to))
        labels = parents if labels is None else materialize(labels.join(root("label", "top"), "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")
        left = edges.join(root("a", "ra"), "a").join(root("b", "rb"), "b").filter("ra != rb")
        edges = materialize(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, keep: tuple[str, ...] = (), fp_col: str | None = None) -> DataFrame:
    """doc_id, fp (signed 64 bits; read from fp_col where docs has them), component_id:
    the least doc_id reachable; and the columns in keep."""
    prepare(docs.sparkSession)
    fp = F.col(fp_col) if fp_col else fingerprint_udf(shingle, seed)(F.col(text_col))
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), fp.alias("fp"), *keep), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    labels = components(ball_edges(fps.select("fp"))).select(F.col("node").alias("fp"), F.col("label").alias("root"))
    linked = materialize(fps.join(labels, "fp", "inner"), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "root").select("fp", "component_id")
    table = materialize(fps.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "classes")
    return rows.join(table, "fp", "left").select("doc_id", "fp", "component_id", *keep)


def op6_result(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: str | None, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text in lower case; none without words."""
    words = [w.encode("utf-8", "surrogatepass") for w in (text or "").lower().split()]
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: max(1, len(words) - shingle + 1)].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[x:y]) for x, y in zip(starts, ends[min(shingle, len(words)) - 1 :].tolist())), np.uint64, len(starts)))


def set_fingerprint(hashes: np.ndarray) -> int:
    """The fingerprint of a set of shingle hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        counts += bit_counts(hashes[at : at + BLOCK])
    return majority(counts, len(hashes))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A signed 64-bit key a band: equal where all minima of the band are."""
    low = np.full(BANDS * MINIMA, (1 << 32) - 1, np.uint32)
    half = hashes.astype(np.uint32)
    for at in range(0, len(half), 256):
        np.minimum(low, (half[at : at + 256, None] * _FACTORS + _TERMS).min(axis=0), out=low)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(low.reshape(BANDS, MINIMA))], np.uint64).view(np.int64)


def similar_roots(sets: list[np.ndarray]) -> np.ndarray:
    """By set, the number of the first of its component; sets are linked by a Jaccard
    index of LEAST or more. Each set reached is held against all sets not reached yet."""
    p, q = LEAST
    sizes = np.array([len(x) for x in sets])
    ids = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
    roots, mark = np.full(len(sets), -1), np.zeros(sum(map(len, sets)) + 1, bool)
    who = np.argsort(sizes, kind="stable")
    who = who[sizes[who] > 0]

    def packed(who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.concatenate([ids[i] for i in who]) if len(who) else np.empty(0, np.int64)
        return flat, np.concatenate(([0], np.cumsum(sizes[who]))), sizes[who]

    flat, starts, size = packed(who)
    for first in range(len(sets)):
        if roots[first] >= 0:
            continue
        roots[first], queue = first, [first]
        while queue:
            x = queue.pop()
            n = int(sizes[x])
            lo, hi = np.searchsorted(size, -(-p * n // q)), np.searchsorted(size, q * n // p, side="right")
            if not n or lo >= hi:
                continue
            mark[ids[x]] = True
            shared = np.add.reduceat(mark[flat[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo], dtype=np.int64)
            mark[ids[x]] = False
            near = who[lo:hi][(q + p) * shared >= p * (size[lo:hi] + n)]
            near = near[roots[near] < 0]
            roots[near] = first
            queue += near.tolist()
            open_ = roots[who] < 0
            if 2 * np.count_nonzero(open_) < len(who):
                who = who[open_]
                flat, starts, size = packed(who)
    return roots


def linked(centres: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """For each of others whether it has a Jaccard index of LEAST or more with any centre."""
    p, q = LEAST
    found = np.zeros(len(others), bool)
    size = np.array([len(x) for x in others])
    words, ids = np.unique(np.concatenate(others), return_inverse=True)
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    parts = np.split(ids, np.cumsum(size)[:-1])
    flat = np.concatenate([parts[i] for i in order]) if len(order) else np.empty(0, np.int64)
    starts, size = np.concatenate(([0], np.cumsum(size[order]))), size[order]
    mark = np.zeros(len(words), bool)
    for c in centres:
        n = len(c)
        lo, hi = np.searchsorted(size, -(-p * n // q)), np.searchsorted(size, q * n // p, side="right")
        if not n or lo >= hi or found[order[lo:hi]].all():
            continue
        at = np.searchsorted(words, c)
        own = at[(at < len(words)) & (words[np.minimum(at, len(words) - 1)] == c)]
        mark[own] = True
        shared = np.add.reduceat(mark[flat[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo], dtype=np.int64)
        mark[own] = False
        found[order[lo:hi][(q + p) * shared >= p * (size[lo:hi] + n)]] = True
    return found


def _sets(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column]


def _gathered(sets: DataFrame) -> DataFrame:
    """(same, root) of sets (label, same, hashes), a task a label."""
    def settle(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("same")
        same = group["same"].to_numpy()
        return pd.DataFrame({"same": same, "root": same[similar_roots(_sets(group["hashes"]))]})

    return sets.groupBy("label").applyInPandas(settle, "same bigint, root bigint")


def _searched(sets: DataFrame, gather: int = GATHER_BYTES, centres: int = CENTRES) -> DataFrame:
    """The same for labels of any size. In each there is one root at a time: its
    reached sets are all held against the sets not reached before the next root
    is taken, so no link is lost."""
    state = materialize(sets.select("label", "same", F.length("hashes").cast("long").alias("bytes"), F.lit(None).cast("long").alias("root"), F.lit(False).alias("used")), "state")
    settled = []
    while True:
        open_ = state.filter("root is null")
        per = open_.groupBy("label").agg(F.sum("bytes").alias("left"), F.min("same").alias("first"))
        waiting = state.filter("root is not null and not used").groupBy("label").agg(F.sum("bytes").alias("waiting"))
        per = materialize(per.join(waiting, "label", "left"), "labels")
        if per.isEmpty():
            break
        # what is left of a label without any set waiting is settled in one task, if it is small
        small = per.filter((F.col("left") <= gather) & F.col("waiting").isNull()).select("label")
        rest = open_.join(small, "label", "left_semi").select("same")
        before = state.filter("root is not null").join(small, "label", "left_semi").select("same", "root")
        settled.append(materialize(_gathered(sets.join(rest, "same")).unionByName(before), "gathered"))
        # centres: all that wait if little is left; else some; else a new root
        known = state.join(per, "label").join(small, "label", "left_anti")
        by_same = Window.partitionBy("label").orderBy("same")
        few = known.filter((F.col("left") > gather) & F.col("root").isNotNull() & ~F.col("used")).withColumn("k", F.row_number().over(by_same)).filter(F.col("k") <= centres)
        few = few.withColumn("sum", F.sum("bytes").over(by_same)).filter((F.col("k") == 1) | (F.col("sum") <= gather)).drop("k", "sum")
        all_ = known.filter((F.col("left") <= gather) & F.col("root").isNotNull() & ~F.col("used"))
        new = known.filter(F.col("waiting").isNull() & (F.col("same") == F.col("first"))).withColumn("root", F.col("same"))
        chosen = materialize(few.unionByName(all_).unionByName(new).select("label", "same", "root", "left", "waiting"), "centres")
        targets = known.filter("root is null").join(chosen.select("same"), "same", "left_anti").select("label", "same", "left", "waiting")

        def sides(rows: DataFrame, chunked, total) -> DataFrame:
            """The chunked side of a label is dealt to parts, the other is copied to each of them."""
            parts = F.greatest(F.lit(1), F.ceil(F.coalesce(total, F.lit(0)) / gather)).cast("long")
            part = F.when(chunked, F.array(F.pmod(F.xxhash64("same"), parts))).otherwise(F.sequence(F.lit(0).cast("long"), parts - 1))
            return rows.withColumn("part", F.explode(part)).join(sets.select("same", "hashes"), "same")

        many = F.col("left") > gather
        total = F.when(many, F.col("left")).otherwise(F.col("waiting"))
        left, right = sides(chosen, ~many, total), sides(targets, many, total)

        def reach(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(others):
                return pd.DataFrame({"same": [], "to": []})
            hit = others["same"].to_numpy()[linked(_sets(own["hashes"]), _sets(others["hashes"]))]
            return pd.DataFrame({"same": hit, "to": own["root"].iloc[0]})

        keys = ["label", "part"]
        reached = left.select(*keys, "root", "hashes").groupBy(*keys).cogroup(right.select(*keys, "same", "hashes").toDF(*keys, "same", "hashes").groupBy(*keys)).applyInPandas(reach, "same bigint, to bigint")
        reached = materialize(reached.distinct().unionByName(chosen.filter("same = root and waiting is null").select("same", F.col("root").alias("to"))), "reached")
        state = state.join(small, "label", "left_anti").join(reached, "same", "left").join(chosen.select("same", F.lit(True).alias("now")), "same", "left")
        state = materialize(state.select("label", "same", "bytes", F.coalesce("root", "to").alias("root"), (F.col("used") | F.col("now").isNotNull()).alias("used")), "state")
    settled.append(state.select("same", "root"))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def band_edges(texts: DataFrame) -> DataFrame:
    """(a, b) of the ball components (column unit) of texts that share a band; connected as all that share it are."""
    bands = texts.select("unit", F.explode("bands").alias("v"))
    shared = bands.groupBy("v").agg(F.min("unit").alias("a"), F.max("unit").alias("z")).filter("a != z").drop("z")
    return bands.join(shared, "v").filter("a != unit").select("a", F.col("unit").alias("b")).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: tuple[str, ...] = ("__file", "__row"), gather: int = GATHER_BYTES) -> DataFrame:
    """doc_id, key (columns of docs that tell its rows apart) and component, equal for texts linked by similarity."""
    prepare(docs.sparkSession)

    @F.pandas_udf("struct<same:bigint,fp:bigint,bands:array<bigint>>")
    def signed(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            sets = [shingle_set(t) for t in texts]
            same = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            fps = np.array([set_fingerprint(x) for x in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"same": same, "fp": fps, "bands": [band_keys(x) for x in sets]})

    @F.pandas_udf("binary")
    def hashed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([shingle_set(t).tobytes() for t in texts])

    # texts are joined by sorted runs at every size: a hash table of keys may outgrow a task
    found = docs.select(F.col(id_col).alias("doc_id"), *key, signed(F.col(text_col)).alias("x"))
    rows = materialize(found.select("doc_id", *key, "x.same", "x.fp", "x.bands"), "signatures")
    classes = materialize(rows.groupBy("same").agg(F.min(F.struct(*key, "fp", "bands")).alias("x")).select("same", *[f"x.{k}" for k in key], "x.fp", "x.bands"), "distinct")
    # a unit is a component of the balls, named by its least text; bands join units
    units = materialize(near_duplicates(classes, "same", fp_col="fp").select(F.col("doc_id").alias("same"), F.col("component_id").alias("unit")), "units")
    texts = materialize(classes.select("same", "bands").join(units.hint("merge"), "same").select("unit", "bands"), "unit-bands")
    balls = units.filter("unit != same").select(F.col("unit").alias("a"), F.col("same").alias("b"))
    edges = balls.unionByName(band_edges(texts))
    labels = components(edges).select(F.col("node").alias("same"), "label")
    chosen = materialize(classes.select("same", *key).join(labels, "same"), "candidates")
    sets = docs.select(*key, text_col).join(chosen.hint("merge"), list(key)).select("label", "same", hashed(F.col(text_col)).alias("hashes"))
    sets = materialize(sets, "sets")
    large = materialize(sets.groupBy("label").agg(F.sum(F.length("hashes").cast("long")).alias("bytes")).filter(F.col("bytes") > gather).select("label"), "large")
    roots = materialize(_gathered(sets.join(large, "label", "left_anti")), "roots")
    if not large.isEmpty():
        roots = materialize(roots.unionByName(_searched(sets.join(large, "label", "left_semi"), gather)), "all-roots")
    return rows.join(roots, "same", "left").select("doc_id", *key, F.coalesce("root", "same").alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without all but one of each group of near copies: the row
    with the least id stays, the first by row key among rows that share it."""
    names = docs.columns
    keyed, key = with_row_key(docs)
    found = materialize(near_copies(keyed, id_col, text_col, tuple(key)), "found")
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *key)).alias("x")).select(*[F.col(f"x.{k}").alias(k) for k in key])
    return keyed.join(materialize(best, "kept").hint("merge"), key, "left_semi").select(*names)
