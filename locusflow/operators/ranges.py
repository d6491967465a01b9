"""Row-wise interval transforms, sweeps and set operations on (chr, start, end)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusflow.operators.primitives import SWEEP_BIN, carried, edges, islands, ranked, runs_where, segments, turns, with_islands
from locusflow.plans.scratch import materialize

C = F.col


def width() -> Column:
    return C("end") - C("start")


def _set(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Coordinates are replaced; all other columns but the rest of a BED line stay."""
    return df.select(*[start.alias("start") if c == "start" else end.alias("end") if c == "end" else C(c) for c in df.columns if c != "rest"])


def midpoint(mode: str = "bed") -> Column:
    """Rounded down; closed coordinates ("granges") round half to even."""
    mid = C("start") + F.floor(width() / 2)
    return (mid if mode == "bed" else mid - F.when(F.pmod(width(), F.lit(4)) == 2, 1).otherwise(0)).cast("long")


def gap_distance(a: str, b: str) -> Column:
    """0 if rows with prefixes a and b overlap or touch, else the gap between them."""
    return F.greatest(F.lit(0).cast("long"), C(f"{a}start") - C(f"{b}end"), C(f"{b}start") - C(f"{a}end"))


def overlap_width(a: str, b: str) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(f"{a}end", f"{b}end") - F.greatest(f"{a}start", f"{b}start"))


def _floor0(c: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), c)


def shift(df: DataFrame, offset: int) -> DataFrame:
    start = _floor0(C("start") + offset)
    return _set(df, start, F.greatest(start, C("end") + offset))


def flank(df: DataFrame, width: int, use_start: bool = True, both: bool = False) -> DataFrame:
    at = C("start") if use_start else C("end")
    if both:
        return _set(df, _floor0(at - width), at + width)
    return _set(df, _floor0(at - width), at) if use_start else _set(df, at, at + width)


def resize(df: DataFrame, width: int, fix: str = "start") -> DataFrame:
    if fix == "start":
        return _set(df, C("start"), C("start") + width)
    if fix == "end":
        return _set(df, _floor0(C("end") - width), C("end"))
    start = _floor0(midpoint() - width // 2)
    return _set(df, start, start + width)


def narrow(df: DataFrame, start: int | None = None, end: int | None = None, width: int | None = None) -> DataFrame:
    """start and end are positions in the region, from 1, both included. Two of
    the three fix the range; with one, none or all of them the region stays. What
    is outside of the region is cut, and a range given backwards is turned."""
    if (start is None) + (end is None) + (width is None) != 1:
        return _set(df, C("start"), C("end"))
    if start is None:
        first, last = max(end - width, 0), end
    else:
        first = max(start - 1, 0)
        last = end if end is not None else first + width
    a, b = (F.least(C("start") + n, C("end")) for n in (first, last))
    return _set(df, F.least(a, b), F.greatest(a, b))


def promoters(df: DataFrame, up: int, down: int, stranded: bool = False) -> DataFrame:
    start, end = C("start") - up, C("start") + down
    if stranded:
        minus = C("strand") == "-"
        start, end = F.when(minus, C("end") - down).otherwise(start), F.when(minus, C("end") + up).otherwise(end)
    return _set(df, _floor0(start), end)


def trim(df: DataFrame, sizes: DataFrame, stranded: bool = False) -> DataFrame:
    """Clamps to sizes (chr, size). Unstranded: unknown chromosomes go and empty
    rows stay; stranded: unknown chromosomes stay and empty rows go."""
    x = df.join(sizes.select("chr", C("size").alias("__size")), "chr", "left" if stranded else "inner")
    limit = F.coalesce("__size", F.greatest("start", "end")) if stranded else C("__size")
    x = _set(x.withColumn("start", F.least(C("start"), limit) if stranded else C("start")).withColumn("end", F.least(C("end"), limit)), C("start"), C("end")).drop("__size")
    return x.filter("start < end" if stranded else "start <= end")


def reduce(df: DataFrame, keys: list[str] = ("chr",)) -> DataFrame:
    return islands(df, list(keys))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return reduce(a.select("chr", "start", "end").unionByName(b.select("chr", "start", "end")))


def cluster(df: DataFrame, max_gap: int = 0) -> DataFrame:
    """df with cluster_id from 0, by chromosome and start. The number of clusters
    before a chromosome comes from a summary, a row a chromosome."""
    rows = with_islands(df, ["chr"], max_gap)
    starts = rows.select("chr", "__first").distinct()
    per = starts.groupBy("chr").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("chr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ids = ranked(starts, ["chr"], "__first", ["__first"], "__k").join(per.select("chr", before.alias("__b")), "chr")
    return rows.join(ids, ["chr", "__first"]).withColumn("cluster_id", C("__b") + C("__k") - 1).select(*df.columns, "cluster_id")


def gaps(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """What the reduced rows leave of every chromosome in sizes."""
    inside = df.select("chr", "start", "end").join(sizes, "chr").select("chr", F.least("start", "size").alias("start"), F.least("end", "size").alias("end"))
    whole = sizes.select("chr", F.lit(0).cast("long").alias("start"), C("size").alias("end"))
    e = edges(inside, ["chr"], {"a": 1, "b": 0}).unionByName(edges(whole, ["chr"], {"a": 0, "b": 1}))
    return runs_where(e, ["chr"], ["a", "b"], lambda n: (n["a"] == 0) & (n["b"] > 0))


def disjoin(df: DataFrame, keys: list[str] = ("chr",)) -> DataFrame:
    """Pieces between all boundaries that some row covers."""
    keys = list(keys)
    return segments(edges(df, keys, {"n": 1}), keys, ["n"]).filter("n > 0").select(*keys, "start", "end")


def both_edges(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return edges(a, keys, {"a": 1, "b": 0}).unionByName(edges(b, keys, {"a": 0, "b": 1}))


def setdiff(a: DataFrame, b: DataFrame, keys: list[str] = ("chr",)) -> DataFrame:
    """What some row of a and none of b covers, in one sweep over the raw rows. keys: chr, or chr and strand."""
    return runs_where(both_edges(a, b, list(keys)), list(keys), ["a", "b"], lambda n: (n["a"] > 0) & (n["b"] == 0))


def intersect(a: DataFrame, b: DataFrame, keys: list[str] = ("chr",)) -> DataFrame:
    return runs_where(both_edges(a, b, list(keys)), list(keys), ["a", "b"], lambda n: (n["a"] > 0) & (n["b"] > 0))


def intersect_all(sets: DataFrame, n: int) -> DataFrame:
    """Where all n sets (set_id) cover, islands of such pieces."""
    e = edges(islands(sets, ["chr", "set_id"]).select("chr", "start", "end"), ["chr"], {"n": 1})
    return runs_where(e, ["chr"], ["n"], lambda d: d["n"] == n)


def union_except(sets: DataFrame, ids: DataFrame, size: int = SWEEP_BIN) -> DataFrame:
    """For each set_id (a number) of ids, the union of all other sets: each island
    of all sets without the pieces that only this set covers. One sweep finds
    islands and such pieces, which are written. An island is given to the ids that
    own no piece of it as it is, and to an owner as what lies between its pieces;
    so no row is copied but those of the result. The ids, one row of them, are the
    only side that is copied."""
    e = edges(islands(sets, ["chr", "set_id"], 0, size), ["chr", "set_id"], {"n": 1}).select("chr", "pos", "n", (C("n") * C("set_id")).alias("owner"))
    state = lambda d: F.struct(F.least(d["n"], F.lit(2)).alias("sets"), F.when(d["n"] == 1, d["owner"]).otherwise(0).alias("owner"))
    begins, ends = F.when(C("__was.sets") == 0, C("pos")), F.when(C("__now.sets") == 0, C("pos"))
    x = carried(turns(e, ["chr"], ["n", "owner"], state, size), ["chr"], "pos", size, {"first": F.max(begins), "last": F.min(ends), "pos": F.min("pos")}, {"__f": ("first", "max"), "__l": ("last", "next"), "__n": ("pos", "next")}, dealt=True)
    w, back = Window.partitionBy("chr", "__bin").orderBy("pos"), Window.partitionBy("chr", "__bin").orderBy(C("pos").desc())
    x = x.withColumn("first", F.greatest(F.max(begins).over(w), C("__f"))).withColumn("end", F.coalesce(F.lead("pos").over(w), C("__n"))).withColumn("last", F.least(F.min(ends).over(back), C("__l")))
    own = F.when(C("__now.sets") == 1, C("__now.owner")).cast(sets.schema["set_id"].dataType)
    x = materialize(x.filter("__was.sets = 0 or __now.sets = 1").select("chr", "first", "last", own.alias("set_id"), C("pos").alias("start"), "end"), "turns")

    every = F.broadcast(ids.agg(F.collect_set("set_id").alias("__ids")))  # one row
    whole = x.groupBy("chr", "first", "last").agg(F.collect_set("set_id").alias("own")).join(every)
    whole = whole.select("chr", C("first").alias("start"), C("last").alias("end"), F.explode(F.array_except("__ids", "own")).alias("set_id"))

    y = x.filter("set_id is not null").join(every).filter(F.array_contains("__ids", C("set_id"))).drop("__ids")
    y = carried(y, ["chr", "set_id"], "start", size, {"end": F.max("end"), "start": F.min("start")}, {"__l": ("end", "max"), "__r": ("start", "next")})
    w = Window.partitionBy("chr", "set_id", "__bin").orderBy("start")
    y = y.withColumn("__l", F.coalesce(F.lag("end").over(w), C("__l"))).withColumn("__r", F.coalesce(F.lead("start").over(w), C("__r")))
    piece = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    left = F.when(C("__l").isNull() | (C("__l") < C("first")), piece(C("first"), C("start")))
    y = y.select("chr", "set_id", F.explode(F.array(left, piece(C("end"), F.least("__r", "last")))).alias("p")).filter("p.start < p.end")
    return whole.unionByName(y.select("chr", "p.start", "p.end", "set_id")).select("set_id", "chr", "start", "end")


def tiles(sizes: DataFrame, width: int) -> DataFrame:
    """Closed bins from 1 over each chromosome; the last ends with it."""
    x = sizes.withColumn("start", F.explode(F.sequence(F.lit(1).cast("long"), C("size"), F.lit(width).cast("long"))))
    return x.select("chr", "start", F.least(C("start") + width - 1, C("size")).alias("end"))


def pintersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows paired by ord; without an overlap the pair has width 0 at the later start."""
    y = b.select("ord", C("chr").alias("c2"), C("start").alias("s2"), C("end").alias("e2"))
    x = a.join(y, "ord")
    start = F.when(C("chr") == C("c2"), F.greatest("start", "s2")).otherwise(C("start"))
    end = F.when(C("chr") == C("c2"), F.greatest(F.greatest("start", "s2"), F.least("end", "e2"))).otherwise(C("start"))
    return x.select("ord", "chr", start.alias("start"), end.alias("end"))


def on_chromosomes(df: DataFrame, names: list[str]) -> DataFrame:
    return df.filter(C("chr").isin(*names))


def chromosomes(df: DataFrame) -> DataFrame:
    return df.select("chr").distinct()


def numbered(df: DataFrame) -> DataFrame:
    """df with ord, from 0, by chromosome, start and end: where a sorted file has each row."""
    per = df.groupBy("chr").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("chr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = ranked(df, ["chr"], "start", ["start", "end"], "__k").join(per.select("chr", before.alias("__b")), "chr")
    return x.withColumn("ord", C("__b") + C("__k") - 1).select(*df.columns, "ord")


def rows_between(df: DataFrame, first: int, last: int) -> DataFrame:
    """The rows of numbered() whose ord is from first to before last; negative ones count from the end."""
    n = F.broadcast(df.agg(F.count("*").alias("__n")))  # one row
    at = lambda k: F.lit(k) if k >= 0 else C("__n") + k
    return df.join(n).filter((C("ord") >= at(first)) & (C("ord") < at(last))).select(*df.columns)


def karyotype_key(column: str) -> list[Column]:
    """Numbers, X, Y, M or MT, then the others by name."""
    name = F.regexp_replace(C(column), "^chr", "")
    number = F.expr(f"try_cast(regexp_replace({column}, '^chr', '') as int)")
    rank = F.when(number.isNotNull(), 0).when(name == "X", 1).when(name == "Y", 2).when(name.isin("M", "MT"), 3).otherwise(4)
    return [rank, F.coalesce(number, F.lit(0)), name]


def version_key(name: Column) -> Column:
    """Sorts numbers inside names by value: each run of digits is padded."""
    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 12, "0")).otherwise(p)), "")
