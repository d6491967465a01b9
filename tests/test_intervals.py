"""Interval operators against plain Python, with bins so small that every carry is used."""

import hashlib
import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.functions import digests, hypergeometric
from locusflow.operators import coverage, overlaps, primitives, ranges, scoring, statistics


def regions(spark, seed, n=120, span=400):
    rng = np.random.default_rng(seed)
    rows = [(f"chr{c}", int(s), int(s + w), i) for i, (c, s, w) in enumerate(zip(rng.integers(1, 4, n), rng.integers(0, span, n), rng.integers(0 if seed % 2 else 1, 30, n)))]
    return rows, spark.createDataFrame(rows, "chr string, start long, end long, id long")


def merged(rows, gap=0):
    out = []
    for c, s, e, *_ in sorted(rows):
        if out and out[-1][0] == c and s <= out[-1][2] + gap:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([c, s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("gap", [0, 4])
def test_islands(spark, seed, gap):
    rows, df = regions(spark, seed)
    for size in (7, 64, 1 << 16):
        got = sorted(tuple(r) for r in primitives.islands(df, ["chr"], gap, size).collect())
        assert got == sorted(merged(rows, gap))


def test_sweeps_in_small_bins(spark):
    (a, da), (b, db) = regions(spark, 2), regions(spark, 4)
    cover = lambda rows: {(c, p) for c, s, e, _ in rows for p in range(s, e)}
    e = primitives.edges(primitives.islands(da, ["chr"]), ["chr"], {"a": 1, "b": 0}).unionByName(primitives.edges(primitives.islands(db, ["chr"]), ["chr"], {"a": 0, "b": 1}))
    got = primitives.segments(e, ["chr"], ["a", "b"], size=9)
    for condition, want in (("a > 0 and b = 0", cover(a) - cover(b)), ("a > 0 and b > 0", cover(a) & cover(b))):
        assert {(r.chr, p) for r in got.filter(condition).collect() for p in range(r.start, r.end)} == want
    assert {(r.chr, p) for r in ranges.setdiff(da, db).collect() for p in range(r.start, r.end)} == cover(a) - cover(b)


@pytest.mark.parametrize("tile", [5, 64, 4096])
def test_interval_join_has_each_pair_once(spark, tile):
    (a, da), (b, db) = regions(spark, 2), regions(spark, 3)
    got = sorted((r.q_id, r.s_id) for r in primitives.iv_join(da, db, tile=tile).collect())
    assert got == sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and y[1] < x[2] and y[2] > x[1])


def test_closest_and_feature_distances(spark):
    (a, da), (b, db) = regions(spark, 2, 80, 900), regions(spark, 4, 15, 900)
    want = {x[3]: min(max(0, x[1] - y[2], y[1] - x[2]) for y in b if y[0] == x[0]) for x in a}
    assert {r.id: r.distance for r in overlaps.closest(da, db).collect()} == want
    mid = lambda r: r[1] + (r[2] - r[1]) // 2
    signed = {x[3]: min((mid(y) - mid(x) for y in b if y[0] == x[0]), key=lambda d: (abs(d), d)) for x in a}
    assert {r.id: r.distance for r in overlaps.feature_distances(da, db).collect()} == signed
    far = spark.createDataFrame([("chrZ", 1, 2, 9)], da.schema)
    assert overlaps.closest(far, db).count() == 0 and overlaps.tss_distances(far, db, sentinel=True).first().distance == 4294967295


def test_invariants(spark):
    (_, a), (_, b) = regions(spark, 2), regions(spark, 4)
    bp = lambda df: statistics.bp(df, "n").first().n
    r = ranges.reduce(a)
    assert sorted(map(tuple, ranges.reduce(r).collect())) == sorted(map(tuple, r.collect()))
    assert bp(r) == bp(ranges.intersect(a, b)) + bp(ranges.setdiff(a, b)) == bp(ranges.disjoin(a))
    sizes = spark.createDataFrame([("chr1", 500), ("chr2", 450), ("chr3", 440), ("chr9", 10)], "chr string, size long")
    assert bp(ranges.gaps(a, sizes)) + bp(ranges.reduce(ranges.trim(a, sizes))) == 1400
    assert statistics.similarity(a, b).first().jaccard == pytest.approx(statistics.similarity(b, a).first().jaccard)
    empty = a.limit(0)
    assert ranges.reduce(empty).count() == 0 and statistics.similarity(empty, b).first().jaccard == 0 and ranges.disjoin(empty).count() == 0


def test_coverage_runs_and_steps(spark):
    rows, df = regions(spark, 2)
    depth = {}
    for c, s, e, _ in rows:
        for p in range(s + 1, e):
            depth[c, p] = depth.get((c, p), 0) + 1
    got = coverage.fixed_step(coverage.runs(coverage.core_events(df))).collect()
    assert {(r.chr, r.pos): r["count"] for r in got} == depth


def test_tokens(spark):
    u = scoring.universe(spark.createDataFrame([("chr1", 0, 10), ("chr1", 20, 30), ("chr2", 5, 9), ("chr1", 20, 30)], "chr string, start long, end long"))
    assert {r.name: r.token for r in u.collect()} == {"chr1:0-10": 0, "chr1:20-30": 1, "chr2:5-9": 2}
    assert [r.name for r in scoring.special_tokens(u).orderBy("token").collect()][0] == "<unk>"
    q = lambda *rows: spark.createDataFrame(list(rows), "chr string, start long, end long, id long")
    assert sorted(r.token for r in scoring.tokenize(q(("chr1", 5, 25, 1), ("chr3", 0, 1, 2)), u).collect()) == [0, 1]
    assert [r.token for r in scoring.tokenize(q(("chr3", 5, 25, 1)), u).collect()] == [3]


def test_digests(spark):
    x = spark.createDataFrame([("ACGT",), ("",), ("acgtnn",)], "s string")
    for r in x.select("s", digests.sha512t24u(F.col("s")).alias("d")).collect():
        assert r.d == base64.urlsafe_b64encode(hashlib.sha512(r.s.encode()).digest()[:24]).decode()
    pairs = digests.dinucleotides(spark.createDataFrame([(1, "AAAC")], "id long, s string"), "id", "s")
    assert {(r.pair, r.n) for r in pairs.collect()} == {("AA", 2), ("AC", 1)}
    names = ["chr10", "chr2", "chrX", "chrM", "chrUn", "chr1", "chrY"]
    df = spark.createDataFrame([(n,) for n in names], "chr string")
    assert [r.chr for r in df.orderBy(*ranges.karyotype_key("chr")).collect()] == ["chr1", "chr2", "chr10", "chrX", "chrY", "chrM", "chrUn"]
    assert [r.chr for r in df.orderBy(ranges.version_key(F.col("chr"))).collect()][:3] == ["chr1", "chr2", "chr10"]


def test_tables_of_counts():
    assert hypergeometric.fisher_greater(3, 1, 1, 3) == pytest.approx(17 / 70)
    assert hypergeometric.odds_ratio(3, 1, 1, 3) == pytest.approx(6.408309, rel=1e-5)
    assert hypergeometric.odds_ratio(5, 0, 0, 5) == float("inf") and hypergeometric.odds_ratio(0, 5, 5, 5) == 0


def test_resize_and_narrow(spark):
    df = spark.createDataFrame([("c", 5, 16)], "chr string, start long, end long")
    at = lambda x: tuple(x.select("start", "end").first())
    assert [at(ranges.resize(df, 4, fix)) for fix in ("start", "end", "center")] == [(5, 9), (12, 16), (8, 12)]
    assert at(ranges.resize(df, 40, "center")) == (0, 40)
    cases = {(3, None, 4): (7, 11), (3, 6, None): (7, 11), (None, 6, 4): (7, 11), (None, 3, 9): (5, 8), (9, 40, None): (13, 16), (0, None, 4): (5, 9), (8, 3, None): (8, 12)}
    assert {k: at(ranges.narrow(df, *k)) for k in cases} == cases
    assert {at(ranges.narrow(df, *k)) for k in ((3, None, None), (None, 3, None), (None, None, 3), (1, 2, 2), (None, None, None))} == {(5, 16)}
