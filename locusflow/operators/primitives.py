"""The physical building blocks of interval algebra.

Intervals are rows (chr, start, end), half-open. No block sorts a whole
chromosome in one task: each works inside bins of a chromosome and carries a
summary, a row a bin, from bin to bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions a bin spans, by default: the tile of the interval joins, and of the sweeps.
TILE, SWEEP_BIN = 1 << 10, 1 << 16
#: Tiles that a row of an interval join may touch before it counts as wide.
WIDE = 1 << 8
#: Bytes of input for each partition that rows are dealt to.
DEAL_BYTES = 4 << 20


def bin_of(pos: Column, size: int) -> Column:
    return F.floor(pos / size).cast("long")


def parts(df: DataFrame) -> int:
    """As many partitions as the input files of df have DEAL_BYTES, so that a task's rows don't grow with the input."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    # a branch of a plan may be there many times
    sizes = {x.canonicalized().hashCode(): int(str(x.stats().sizeInBytes())) for x in (leaves.apply(i) for i in range(leaves.size()))}
    return -(-sum(b for b in sizes.values() if b < 1 << 60) // DEAL_BYTES)


def deal(df: DataFrame, *by: str) -> DataFrame:
    """df partitioned by columns, in parts() partitions. For one or rows of
    unknown size the number is left to the session."""
    n = parts(df)
    return df.repartition(n, *by) if n > 1 else df.repartition(*by)


def by_range(df: DataFrame, *by: str) -> DataFrame:
    """df in partitions that are ranges of columns, each sorted by them."""
    n = parts(df)
    return (df.repartitionByRange(n, *by) if n > 1 else df.repartitionByRange(*by)).sortWithinPartitions(*by)


def in_bins(df: DataFrame, keys: list[str], pos: str, size: int = SWEEP_BIN) -> DataFrame:
    """df with __bin, dealt to bins; rows without a key or position are left out, as joins on them would."""
    there = " and ".join(f"`{k}` is not null" for k in [*keys, "__bin"])
    return deal(df.withColumn("__bin", bin_of(F.col(pos), size)).filter(there), *keys, "__bin")


def carried(df: DataFrame, keys: list[str], pos: str, size: int, summary: dict[str, Column], carry: dict[str, tuple[str, str]], dealt: bool = False) -> DataFrame:
    """df with __bin and, for each (name: (summary, how)) of carry, what the bins
    before (sum, max; last: the bin before) or after (next: least value of the bins
    after; rest: their sum) summarise. dealt: df has __bin and is partitioned by it already.
    Spark makes a deal once for both branches only if they have equal filters and
    columns, so the summary reads all columns; the caller drops what it doesn't use."""
    binned = df if dealt else in_bins(df, keys, pos, size)
    every = [F.col(c) for c, kind in binned.dtypes if "map<" not in kind]
    bins = binned.groupBy(*keys, "__bin").agg(*[c.alias(f"__s_{n}") for n, c in summary.items()], F.max(F.xxhash64(*every)).alias("__every")).filter("__every is not null")
    # frames only look back: one that looks ahead is summed anew for each row
    up, down = Window.partitionBy(*keys).orderBy("__bin"), Window.partitionBy(*keys).orderBy(F.col("__bin").desc())
    before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (up, down))
    made = {"sum": lambda c: F.sum(c).over(before), "max": lambda c: F.max(c).over(before), "last": lambda c: F.lag(c).over(up), "next": lambda c: F.min(c).over(after), "rest": lambda c: F.sum(c).over(after)}
    bins = deal(bins.select(*keys, "__bin", *[made[how](f"__s_{s}").alias(f"__m_{n}") for n, (s, how) in carry.items()]), *keys, "__bin")
    # dealt as the rows are, so that those stay where they are; named after that,
    # as Spark deals both sides of a join anew if both are plain deals
    return binned.join(bins.select(*keys, "__bin", *[F.col(f"__m_{n}").alias(n) for n in carry]), [*keys, "__bin"])


def reached(df: DataFrame, keys: list[str], size: int = SWEEP_BIN) -> DataFrame:
    """df with __bin and __reach: the largest end of the rows before, by start and end."""
    x = carried(df, keys, "start", size, {"end": F.max("end")}, {"__reach": ("end", "max")})
    before = Window.partitionBy(*keys, "__bin").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumn("__reach", F.greatest(F.max("end").over(before), F.col("__reach")))


def with_islands(df: DataFrame, keys: list[str], gap: int = 0, size: int = SWEEP_BIN) -> DataFrame:
    """df with __first: the start of the island that a row is in. Rows join an
    island if they start at most gap after its end, so adjacent rows do."""
    x = reached(df, keys, size)
    w = Window.partitionBy(*keys, "__bin").orderBy("start", "end")
    x = x.withColumn("__new", F.when(F.col("__reach").isNull() | (F.col("start") > F.col("__reach") + gap), F.col("start")))
    x = carried(x.drop("__reach"), keys, "start", size, {"new": F.max("__new")}, {"__before": ("new", "max")}, dealt=True)
    # the frame holds all peers: of equal rows, any one may be the one that began the island
    first = F.greatest(F.max("__new").over(w), F.col("__before"))
    return x.withColumn("__first", first).drop("__bin", "__before", "__new")


def islands(df: DataFrame, keys: list[str], gap: int = 0, size: int = SWEEP_BIN) -> DataFrame:
    """(keys, start, end) of the islands."""
    rows = with_islands(df.select(*keys, "start", "end"), keys, gap, size)
    return rows.groupBy(*keys, F.col("__first").alias("start")).agg(F.max("end").alias("end")).select(*keys, "start", "end")


def iv_join(left: DataFrame, right: DataFrame, keys: list[str] = ("chr",), tile: int = TILE, min_overlap: int = 1, wide: str = "") -> DataFrame:
    """Pairs of rows that overlap. Columns of left get the prefix q_, of right
    s_, the keys keep their names. Both sides are dealt to the tiles that they
    touch; a pair is kept in the first tile that both are in, so none repeats.
    Hot tiles are split by adaptive execution, as this is a plain equi-join.
    wide: left or both, where a side may have rows over WIDE tiles; pairs with one
    are made in tiles WIDE times as large, so that none is copied to thousands.
    With left, a wide row of the right side has no partners but wide ones. With
    both, it is asked first which sides have wide rows, and only copies that can
    meet such a row are made."""
    keys = list(keys)
    large = tile * WIDE
    there = {"q_": True, "s_": wide == "both"}
    if wide == "both":
        there = {p: df.filter(F.greatest(F.col("end") - 1, F.col("start")) - F.col("start") >= large).limit(1).count() > 0 for p, df in (("q_", left), ("s_", right))}
        wide = wide if any(there.values()) else ""

    def tiled(df: DataFrame, p: str) -> DataFrame:
        """Kinds of tiles: 0 for two narrow rows, 1 for a wide row of the left side, 2 for a narrow one of it and a wide one of the right."""
        out = df.select(*keys, *[F.col(c).alias(p + c) for c in df.columns if c not in keys])
        first, last = F.col(p + "start"), F.greatest(F.col(p + "start"), F.col(p + "end") - 1)

        def cover(kind: int, size: int) -> Column:
            return F.transform(F.sequence(bin_of(first, size), bin_of(last, size)), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("tile")))

        if not wide:
            return out.withColumn("__tile", F.explode(F.sequence(bin_of(first, tile), bin_of(last, tile))))
        second, third = ([cover(k, large)] if there[side] else [] for k, side in ((1, "q_"), (2, "s_")))
        broad = F.concat(*second, *third) if p == "s_" else cover(1, large)
        narrow = F.concat(cover(0, tile), *second) if p == "s_" else F.concat(cover(0, tile), *third)
        return out.withColumn("__tile", F.explode(F.when(last - first >= large, broad).otherwise(narrow)))

    hit = (F.col("s_start") < F.col("q_end")) & (F.col("s_end") > F.col("q_start"))
    later = F.greatest("q_start", "s_start")
    if wide:
        hit &= F.col("__tile.tile") == F.floor(later / F.when(F.col("__tile.kind") == 0, tile).otherwise(large))
    else:
        hit &= F.col("__tile") == bin_of(later, tile)
    if min_overlap > 1:
        hit &= F.least("q_end", "s_end") - F.greatest("q_start", "s_start") >= min_overlap
    return tiled(left, "q_").join(tiled(right, "s_"), [*keys, "__tile"]).filter(hit).drop("__tile")


def _changes(events: DataFrame, keys: list[str], depths: list[str], size: int, turns: bool) -> DataFrame:
    """(keys, __bin, pos, depth changes), a row a position, dealt to bins once and summed there."""
    e = in_bins(events.select(*keys, "pos", *depths), keys, "pos", size).groupBy(*keys, "__bin", "pos").agg(*[F.sum(d).alias(d) for d in depths])
    return e.filter(" or ".join(f"{d} <> 0" for d in depths)) if turns else e


def segments(events: DataFrame, keys: list[str], depths: list[str], size: int = SWEEP_BIN, turns: bool = False) -> DataFrame:
    """events: (keys, pos, depth changes). The pieces between neighbouring
    positions, as (keys, start, end, depth columns as running sums). turns: only
    positions where a depth changes divide them."""
    e = _changes(events, keys, depths, size, turns)
    x = carried(e, keys, "pos", size, {"pos": F.min("pos")} | {d: F.sum(d) for d in depths}, {"__next": ("pos", "next")} | {f"__c_{d}": (d, "sum") for d in depths}, dealt=True)
    w = Window.partitionBy(*keys, "__bin").orderBy("pos")
    depth = [(F.sum(d).over(w) + F.coalesce(f"__c_{d}", F.lit(0))).alias(d) for d in depths]
    x = x.select(*keys, F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(w), F.col("__next")).alias("end"), *depth)
    return x.filter("end is not null")


def turns(events: DataFrame, keys: list[str], depths: list[str], state, size: int = SWEEP_BIN) -> DataFrame:
    """(keys, __bin, pos, __was, __now), dealt to bins: the positions where state(columns of the running depths) changes."""
    x = carried(_changes(events, keys, depths, size, True), keys, "pos", size, {d: F.sum(d) for d in depths}, {f"__c_{d}": (d, "sum") for d in depths}, dealt=True)
    w = Window.partitionBy(*keys, "__bin").orderBy("pos")
    x = x.select(*keys, "__bin", "pos", *depths, *[(F.sum(d).over(w) + F.coalesce(f"__c_{d}", F.lit(0))).alias(f"__n_{d}") for d in depths])
    now, was = state({d: F.col(f"__n_{d}") for d in depths}), state({d: F.col(f"__n_{d}") - F.col(d) for d in depths})
    return x.select(*keys, "__bin", "pos", was.alias("__was"), now.alias("__now")).filter("__was <> __now")


def runs_where(events: DataFrame, keys: list[str], depths: list[str], condition, size: int = SWEEP_BIN) -> DataFrame:
    """(keys, start, end): the longest pieces in which condition(columns of the
    running depths) holds. Events need not be of disjoint rows."""
    x = carried(turns(events, keys, depths, condition, size).drop("__was"), keys, "pos", size, {"pos": F.min("pos")}, {"__next": ("pos", "next")}, dealt=True)
    w = Window.partitionBy(*keys, "__bin").orderBy("pos")
    return x.withColumn("end", F.coalesce(F.lead("pos").over(w), F.col("__next"))).filter("__now").select(*keys, F.col("pos").alias("start"), "end")


def ranked(df: DataFrame, keys: list[str], pos: str, order: list, name: str, size: int = SWEEP_BIN) -> DataFrame:
    """df with the number of each row among those of its keys, from 1. order begins with pos, a number."""
    x = carried(df, keys, pos, size, {"n": F.count("*")}, {"__before": ("n", "sum")})
    inside = F.row_number().over(Window.partitionBy(*keys, "__bin").orderBy(*order))
    return x.withColumn(name, (F.coalesce("__before", F.lit(0)) + inside).cast("long")).select(*df.columns, name)


def edges(df: DataFrame, keys: list[str], depths: dict[str, int]) -> DataFrame:
    """Start and end events of df for segments(); depths: the change at a start."""
    at = [F.struct(F.col(end).alias("pos"), *[F.lit(sign * n).cast("long").alias(d) for d, n in depths.items()]) for end, sign in (("start", 1), ("end", -1))]
    return df.select(*keys, F.explode(F.array(*at)).alias("__e")).select(*keys, "__e.*")


def asof(queries: DataFrame, points: DataFrame, keys: list[str], at: str, size: int = SWEEP_BIN) -> DataFrame:
    """queries with __before and __after: the nearest points (column pos) at or before, and at or after, column at."""
    both = queries.withColumn("__pos", F.col(at)).withColumn("__q", F.lit(True)).unionByName(points.select(*keys, F.col("pos").alias("__pos"), F.col("pos").alias("__point")), allowMissingColumns=True)
    x = carried(both, keys, "__pos", size, {"hi": F.max("__point"), "lo": F.min("__point")}, {"__l": ("hi", "max"), "__r": ("lo", "next")})
    w = Window.partitionBy(*keys, "__bin").orderBy("__pos")
    back = Window.partitionBy(*keys, "__bin").orderBy(F.col("__pos").desc())
    before = F.greatest(F.max("__point").over(w.rangeBetween(Window.unboundedPreceding, 0)), F.col("__l"))
    after = F.least(F.min("__point").over(back.rangeBetween(Window.unboundedPreceding, 0)), F.col("__r"))
    x = x.withColumn("__before", before).withColumn("__after", after).filter("__q")
    return x.select(*queries.columns, "__before", "__after")
