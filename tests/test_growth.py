"""Deals of rows: made once, in partitions that grow in number with the input, not in size."""

import base64
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from locusflow.operators import coverage, enrichment, overlaps, primitives, ranges, sequences, statistics, variants, vocabulary
from locusflow.plans import catalog
from test_intervals import merged, regions


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture
def filed(spark, tmp_path):
    rows, df = regions(spark, 2, 4000, 4000)
    df.coalesce(1).write.parquet(str(tmp_path / "rows"))
    return rows, spark.read.parquet(str(tmp_path / "rows")), sum(f.stat().st_size for f in (tmp_path / "rows").glob("*.parquet"))


def test_partitions_grow_with_the_files(filed, monkeypatch):
    rows, df, size = filed
    monkeypatch.setattr(primitives, "DEAL_BYTES", 1000)
    assert abs(primitives.deal(df, "chr", "start").rdd.getNumPartitions() - size / 1000) <= 2
    assert primitives.deal(df.unionByName(df), "chr").rdd.getNumPartitions() == primitives.deal(df, "chr").rdd.getNumPartitions()
    assert sorted(tuple(r) for r in primitives.islands(df, ["chr"], 0, 64).collect()) == sorted(merged(rows))
    got = sorted(tuple(r) for r in coverage.runs(coverage.core_events(df)).collect())
    depth = {}
    for c, s, e, _ in rows:
        for p in range(s + 1, e):
            depth[c, p] = depth.get((c, p), 0) + 1
    assert {(c, p): n for c, s, e, n in got for p in range(s, e)} == depth
    assert all(a[:1] + a[2:3] + a[3:] != b[:2] + b[3:] for a, b in zip(got, got[1:]))


def test_a_sweep_reads_and_deals_its_rows_once(filed):
    _, df, _ = filed
    for x in (coverage.runs(coverage.core_events(df)), primitives.islands(df, ["chr"]), statistics.neighbours(df)):
        assert final_plan(x).count("FileScan") == 1
    assert final_plan(ranges.setdiff(df, df.filter("id % 2 = 0"))).count("FileScan") == 2


def test_positions_are_summed_once(filed):
    rows = final_plan(coverage.runs(coverage.core_events(filed[1]))).split("BroadcastQueryStage")[0]
    assert rows.count("functions=[sum(d#") == 1 and rows.count("Exchange hash") == 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_union_except_copies_no_rows_but_its_results(spark, seed):
    rows, df = regions(spark, seed, 90, 300)
    sets = df.withColumn("set_id", df.id % 5)
    ids = spark.createDataFrame([(0,), (1,), (3,), (3,), (9,)], "set_id long")
    want = sorted((k, *x) for k in (0, 1, 3, 9) for x in merged([r for r in rows if r[3] % 5 != k and r[1] < r[2]]))
    for size in (7, 1 << 16):
        out = ranges.union_except(sets, ids, size)
        assert sorted(tuple(r) for r in out.collect()) == want
    plan = final_plan(out)
    assert plan.index("Generate explode") < plan.index("Exchange")


def test_a_vocabulary_by_score_is_numbered_in_many_ranges(spark, tmp_path, monkeypatch):
    rows = [("chr1", i * 10, i * 10 + 5, i, None if i % 50 == 7 else float(i % 3)) for i in range(3000)]
    spark.createDataFrame(rows, "chr string, start long, end long, ord long, score double").coalesce(1).write.parquet(str(tmp_path / "v"))
    monkeypatch.setattr(primitives, "DEAL_BYTES", 1000)
    seen = []
    monkeypatch.setattr(vocabulary, "ranked", lambda df, *a: seen.append(df) or primitives.ranked(df, *a))
    out = vocabulary.vocabulary(spark.read.parquet(str(tmp_path / "v")), by_score=True).filter("chr is not null")
    want = sorted(rows, key=lambda r: (math.inf if r[4] is None else -r[4], r[3]))
    assert [(r.start, r.score) for r in out.orderBy("token").collect()] == [(r[1], r[4]) for r in want]
    assert seen[0].select("__range").distinct().count() > 4


def test_partitions_without_wide_rows_are_joined_without_copies(spark):
    _, q = regions(spark, 2)
    p = regions(spark, 4)[1].withColumn("priority", F.col("id") % 3)
    plan = final_plan(statistics.partition_counts(q, p, ["x", "y", "z"]))
    assert "kind" not in plan and plan.count("Scan ExistingRDD[chr") == 3  # hits, and the number of queries
    wide = spark.createDataFrame([("chr1", 0, 1 << 20, 1, 2)], p.schema)
    got = {r.partition: r.n for r in statistics.partition_counts(q, p.filter("priority < 2").unionByName(wide), ["x", "y", "z"]).collect()}
    assert sum(got.values()) == q.count() and got["z"] > 0


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("n", [40, 41])
def test_median_distance(spark, seed, n):
    q, f = regions(spark, seed, n)[1], regions(spark, seed + 1, 6)[1]
    got = [r.median_abs_distance for size in (7, 1 << 16) for r in overlaps.median_distance(q, f, size).collect()]
    want = overlaps.feature_distances(q, f).agg(F.percentile(F.abs("distance"), F.lit(0.5)).alias("m")).first().m
    assert got == [want, want]
    assert [r[0] for r in overlaps.median_distance(q, f.filter("chr = 'none'")).collect()] == [None]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_contingency_counts_pairs_where_it_finds_them(spark, seed):
    (a, da), (b, db) = regions(spark, seed, 150), regions(spark, seed + 1, 90)
    users, sets = da.withColumn("user_set", F.col("id") % 3), db.withColumn("set_id", F.col("id") % 4)
    hit = {(x[3], y[3] % 4) for x in a for y in b if x[0] == y[0] and y[1] < x[2] and y[2] > x[1]}
    want = []
    for u in range(3):
        for k in {k for _, k in hit}:
            n, hits, size = sum(i % 3 == u and s == k for i, s in hit), sum(s == k for _, s in hit), sum(x[3] % 3 == u for x in a)
            want.append((u, k, n, hits - n, size - n, len(a) - size - hits + n))
    alone = enrichment.contingency(users, sets)
    for out in (alone, enrichment.contingency(users, sets, da)):
        assert sorted(tuple(r) for r in out.collect()) == sorted(want)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_closest_is_one_sweep(spark, seed):
    (a, da), (b, db) = regions(spark, seed, 80, 900), regions(spark, seed + 2, 15, 900)
    b = [y for y in b if y[0] != "chr3"] + [("chr3", 850, 860, 99)]
    db = spark.createDataFrame(b, db.schema)
    want = {x[3]: min(max(0, x[1] - y[2], y[1] - x[2]) for y in b if y[0] == x[0]) for x in a}
    for size in (7, 1 << 16):
        assert {r.id: r.distance for r in overlaps.closest(da, db, size).collect()} == want
    assert final_plan(overlaps.closest(da, db)).count("Scan ExistingRDD") == 2


def test_regions_are_joined_once_for_their_tokens(spark):
    _, df = regions(spark, 2)
    z = vocabulary.Tokenizer(vocabulary.vocabulary(regions(spark, 4, 20)[1].withColumnRenamed("id", "ord")))
    out = z.tokenize(df)
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in z.names_of(z.encode(df)).select("id", "token", "name").collect())
    assert "Join" not in final_plan(out) and out.count() > 0
    none = z.tokenize(df.withColumn("chr", F.lit("none")))
    assert [tuple(r) for r in none.collect()] == [(None, z.regions().count(), "<unk>")]


def test_a_collection_is_digested_in_one_pass(spark):
    rows = [(c, i, f"s{i % 7}", "ACGT" * (i % 5)) for c in "ab" for i in range(40)]
    x = sequences.level1(sequences.level2(spark.createDataFrame(rows, "collection string, ord long, name string, seq string")))
    pairs = [json.dumps({"length": 4 * (i % 5), "name": f"s{i % 7}"}, separators=(",", ":")) for i in range(40)]
    digest = lambda s: base64.urlsafe_b64encode(hashlib.sha512(s.encode()).digest()[:24]).decode()
    assert {r.name_length_pairs for r in x.collect()} == {digest("[" + ",".join(pairs) + "]")}
    assert {r.sorted_name_length_pairs for r in x.collect()} == {digest(json.dumps(sorted(digest(p) for p in pairs), separators=(",", ":")))}
    # no array is looked up by index, which would make it anew for each element; and no join of the texts
    assert "get(" not in final_plan(x)
    assert "Join" not in final_plan(catalog.QUERIES["collection_digests"](spark, "/root/testdata/sf0.001"))


def test_alleles_are_prepared_once(spark, monkeypatch):
    pieces = sequences.chunks(spark.createDataFrame([("c", "ACGT" * 30 + "A" * 90 + "C" * 40)], "name string, seq string"), 16)
    rows = [(1, "c", 3, "T", "G"), (2, "c", 130, "A", "AA")]
    asked = []
    monkeypatch.setattr(variants, "extract", lambda p, r, size: asked.append(r) or sequences.extract(p, r, size))
    made = lambda rows: {r.id: (r.start, r.end, len(r.allele)) for r in variants.normalized(spark.createDataFrame(rows, "id long, name string, start long, ref string, alt string"), pieces, size=16, contexts=(4, 200)).collect()}
    assert made(rows[:1]) == {1: (3, 4, 1)} and len(asked) == 1  # none rolls on, so no wider context is read
    assert made(rows) == {1: (3, 4, 1), 2: (120, 210, 91)} and len(asked) == 3
    assert all("Python" not in r._jdf.queryExecution().optimizedPlan().toString() for r in asked)
