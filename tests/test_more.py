"""Vocabularies, databases of sets, classification, the store, token files and the new readers and sinks."""

import gzip
import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.functions import hypergeometric
from locusflow.operators import classification, coverage, databases, enrichment, genes, primitives, ranges, sequences, store, variants, vocabulary
from locusflow.sources import readers, sinks, tokens


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def text_of(path):
    return "".join((gzip.open(p, "rt") if p.endswith(".gz") else open(p)).read() for p in sorted(glob.glob(f"{path}/part-*")))


def test_tokenizer(spark, tmp_path):
    put(tmp_path / "u.bed", "chr2\t5\t9\nchr1\t1\t4\nchr2\t5\t9\nchr1\t10\t20\n")
    z = vocabulary.Tokenizer.from_config(spark, put(tmp_path / "t.toml", 'universe = "u.bed"\nspecial_tokens = [{name = "unk", token = "<none>"}]\n'))
    names = dict(rows(z.table, "token", "name"))
    assert [names[i] for i in range(4)] == ["chr2:5-9", "chr1:1-4", "chr1:10-20", "<none>"] and len(names) == 10 and names[9] == "<sep>"
    q = spark.createDataFrame([(1, "chr1", 3, 12), (2, "chr9", 1, 2)], "id long, chr string, start long, end long")
    assert sorted(rows(z.encode(q))) == [(1, 1), (1, 2)]
    assert rows(z.encode(q.filter("id = 2"))) == [(None, 3)] and rows(z.tokenize(q.filter("id = 2")), "name") == [("<none>",)]
    t = spark.createDataFrame([(0,), (77,)], "token long")
    assert sorted(rows(z.decode(t))) == [(0, "chr2:5-9"), (77, "<none>")] and sorted(rows(z.names_of(t)))[1] == (77, None)
    assert sorted(rows(z.table.filter(z.special_mask()), "token")) == [(i,) for i in range(3, 10)]
    five = vocabulary.universe_rows(spark, put(tmp_path / "v.bed", "chr1\t1\t2\ta\t0.5\nchr1\t3\t4\tb\t2\n"))
    assert rows(vocabulary.vocabulary(five, by_score=True).filter("token < 2").orderBy("token"), "name", "label", "score") == [("chr1:3-4", "b", 2.0), ("chr1:1-2", "a", 0.5)]
    for bad in ("chr1\t1\t2\tx\n", ""):
        with pytest.raises(ValueError, match="universe"):
            vocabulary.Tokenizer.from_auto(spark, put(tmp_path / "bad.bed", bad))
    with pytest.raises(Exception, match="not a universe line"):
        vocabulary.Tokenizer.from_bed(spark, put(tmp_path / "bad2.bed", "chr1\t1\t2\nchr1\t1\n")).table.collect()
    with pytest.raises(ValueError, match="neither"):
        vocabulary.Tokenizer.from_auto(spark, "x.txt")


def test_token_files(spark, tmp_path):
    assert tokens.encode(np.array([1, 513])) == b"GTOK\x01\x01\x00\x01\x02" and tokens.encode(np.array([70000]))[4] == 2
    for t in ([], [0, 65535], [65536, 3]):
        assert tokens.decode(tokens.encode(np.array(t, np.int64))).tolist() == t
    assert tokens.decode(tokens.append(tokens.encode(np.array([1])), np.array([2]))).tolist() == [1, 2]
    for bad in (lambda: tokens.decode(b"GTOX\x01"), lambda: tokens.append(tokens.encode(np.array([1])), np.array([70000]))):
        with pytest.raises(ValueError):
            bad()
    (tmp_path / "a.gtok").write_bytes(tokens.encode(np.array([5, 6])))
    assert rows(tokens.read(spark, f"{tmp_path}/*.gtok"), "tokens") == [([5, 6],)]
    df = spark.createDataFrame([([1, 2],), (None,)], "t array<long>")
    assert rows(df.select(tokens.decoded(tokens.encoded("t")))) == [([1, 2],), (None,)]


def test_database(spark, tmp_path):
    put(tmp_path / "db/c1/regions/x y.bed", "chr1\t1\t5\nchr1\t8\t9\n")
    put(tmp_path / "db/c1/regions/b.bed", "chr2\t1\t5\n")
    put(tmp_path / "db/c2/regions/b.bed", "chr1\t4\t20\n")
    put(tmp_path / "db/c1/index.txt", "filename\tcellType\tdescription\nx y.bed\tK562\t" + "d" * 100 + "\n")
    db = databases.RegionDB.from_folder(spark, f"{tmp_path}/db")
    assert sorted(rows(db.sets, "set_id", "filename", "collection", "cell_type")) == [(0, "b.bed", "c1", None), (1, "x y.bed", "c1", "K562"), (2, "b.bed", "c2", None)]
    q = spark.createDataFrame([(1, "chr1", 4, 9)], "id long, chr string, start long, end long")
    assert sorted(rows(db.search(q))) == [(1, "x y.bed", 2, 2, 1), (2, "b.bed", 1, 1, 1)]
    assert rows(db.list(["c2"])) == [(2, "b.bed")] and db.get(["b.bed"], ["c1"]).count() == 1
    both = db.merge(databases.RegionDB.from_folder(spark, f"{tmp_path}/db", ["c1"], limit=1))
    assert sorted(rows(both.list())) == [(0, "b.bed"), (1, "x y.bed"), (2, "b.bed"), (3, "b.bed")]
    both.save(f"{tmp_path}/saved")
    again = databases.RegionDB.load(spark, f"{tmp_path}/saved")
    assert sorted(rows(again.regions)) == sorted(rows(both.regions))
    r = spark.createDataFrame([(0, 1, 3, 1, 2, 4, 12.34567, float("nan"), 0.00012345), (0, 0, 1, 2, 3, 4, 0.5, 2.0, None)], "user_set long, set_id long, a long, b long, c long, d long, p_value_log double, odds_ratio double, q_value double")
    sinks.enrichment_results(db.annotate(enrichment.ranked(r)), f"{tmp_path}/results")
    lines = text_of(f"{tmp_path}/results").splitlines()
    assert lines[0].startswith("userSet\tdbSet\tcollection\tpValueLog") and lines[1].split("\t") == ["1", "2", "c1", "12.3457", "NaN", "3", "1", "2", "1", "2", "1.33", "1", "2", "4", "d" * 80, "K562", "", "", "", "", "x y.bed", "1.234500e-4", "2"]
    assert lines[2].split("\t")[-2] == "NA"
    empty = databases.RegionDB.from_sets(spark.createDataFrame([(7, "chr1", 5, 5), (7, "chr1", 5, 6)], "set_id long, chr string, start long, end long"))
    assert rows(empty.regions) == [(7, "chr1", 5, 6)] and rows(empty.list()) == [(7, "set_7")]


@pytest.mark.parametrize(
    ("rest", "want"),
    [
        ([None], ("bed3+0", "ucsc_bed")),
        (["n\t5\t+"], ("bed6+0", "ucsc_bed")),
        (["n\t5000\t+"], ("bed6+0", "ucsc_bed_rs")),
        (["n\t5\t+\t0.5\t-1\t-1\t9", "n\t5\t+\t1\t-1\t-1\t9"], ("bed6+4", "encode_narrowpeak")),
        (["n\t5000\t+\t0.5\t1.5\t2.5\t9"], ("bed6+4", "encode_narrowpeak_rs")),
        (["n\t5\t+\t0.5\t-1\t-1"], ("bed6+3", "encode_broadpeak")),
        (["n\t5\t+\t0.5\t2.5\t7"], ("bed6+3", "encode_rna_elements")),
        (["n\t5\t+\t1\t2\t255,0,0\t2\t1,2\t0,5\t0.5\t1.5\t2.5"], ("bed12+3", "encode_gappedpeak")),
        (["n\t5\tx"], ("bed5+1", "bed_like")),
        (["n", "n\t1"], ("unknown_bed_compliance", "unknown")),
        ([], ("unknown_bed_compliance", "unknown")),
    ],
)
def test_classification(spark, rest, want):
    df = spark.createDataFrame([("chr1", 1, 5, r) for r in rest], "chr string, start long, end long, rest string")
    assert rows(classification.classify(df), "compliance", "format") == [want]


def test_store(spark, tmp_path):
    schema = "collection string, ord long, name string, seq string"
    a, b = (store.Store(spark, f"{tmp_path}/{n}") for n in "ab")
    first = spark.createDataFrame([("x", 0, "chrX", "TTGGGGAA"), ("x", 1, "chr1", "GGAA"), ("x", 2, "chr2", "GCGC")], schema)
    a.add(first)
    a.add(first)
    a.add(spark.createDataFrame([("y", 0, "s", "GGAA"), ("y", 1, "t", "A" * 9000)], schema))
    whole = a.collections()
    digest = "XZlrcEGi6mlopZ2uD8ObHkQB1d0oDwKk"
    assert whole.count() == 2 and rows(a.collections(names="Fw1r9eRxfOZD98KKrhlYQNEdSRHoVxAG"), "digest", "n") == [(digest, 3)]
    assert rows(a.collections(1, 1), "digest") == [rows(whole, "digest")[1]] and a.collections(5, 1).count() == 0
    assert rows(a.members(digest), "ord", "name", "length") == [(0, "chrX", 8), (1, "chr1", 4), (2, "chr2", 4)]
    assert rows(a.attribute("lengths", "cGRMZIb3AVgkcAfNv39RN7hnT5Chk7RX"), "value") == [("8",), ("4",), ("4",)]
    assert rows(a.statistics()) == [(2, 4, 9016)]
    long = a.sequences().filter("length = 9000").first().sq
    q = spark.createDataFrame([(1, long, 4090, 4100)], "id long, name string, start long, end long")
    assert rows(a.substrings(q), "bases") == [("A" * 10,)] and "".join(r.bases for r in a.stream(long).collect()) == "A" * 9000
    b.take_from(a, digest)
    b.take_from(a, digest)
    assert rows(b.statistics()) == [(1, 3, 16)]
    a.remove(digest)
    assert rows(a.statistics()) == [(1, 2, 9004)] and a.collections().count() == 1
    with pytest.raises(ValueError, match="no attribute"):
        a.collections(colour="x")
    a.load_aliases(put(tmp_path / "alias.tsv", "# c\none\tSQ.1\ntwo\tSQ.1\n"), "sequence", "ns")
    names = spark.createDataFrame([("ns", "one"), ("ns", "none")], "namespace string, alias string")
    assert sorted(rows(a.resolve(names, "sequence"), "alias", "digest")) == [("none", None), ("one", "SQ.1")]
    assert sorted(rows(a.named(spark.createDataFrame([("SQ.1",)], "digest string"), "sequence"), "alias")) == [("one",), ("two",)]
    a.remove_aliases("sequence", "ns", "one")
    assert rows(a.aliases(), "alias") == [("two",)]
    a.set_metadata(spark.createDataFrame([(digest, '{"genome": "x"}')], "digest string, json string"))
    a.set_metadata(spark.createDataFrame([(digest, '{"genome": "y"}')], "digest string, json string"))
    assert rows(a.metadata()) == [(digest, '{"genome": "y"}')]
    with pytest.raises(Exception, match="not a JSON object"):
        a.set_metadata(spark.createDataFrame([(digest, "[1")], "digest string, json string"))
    a.remove_metadata(digest)
    assert a.metadata().count() == 0
    store.index_lines(b.members(digest)).coalesce(1).write.text(f"{tmp_path}/index")
    assert sorted(rows(store.read_index(spark, f"{tmp_path}/index"), "name", "length")) == [("chr1", 4), ("chr2", 4), ("chrX", 8)]


def test_readers_and_sinks(spark, tmp_path):
    assert readers.kind_of("a/b.BED.gz") == ("bed", True) and readers.kind_of("x.narrowPeak") == ("narrowpeak", False) and readers.kind_of("x") == ("unknown", False)
    p = put(tmp_path / "s/a.bed", "chr1\t1\t5\tn\t7\nchr1\t6\t8\n")
    put(tmp_path / "s/b.bed", "chr2\t1\t5\tn\t0\t+\nchr2\t4\t9\tn\t0\t+\nchr2\t4\t9\tn\t0\t-\n")
    assert rows(readers.scored_bed(spark, p), "start", "score") == [(1, 7.0), (6, 1.0)]
    assert sorted(rows(readers.region_sets(spark, f"{tmp_path}/s"), "set_id", "chr", "start")) == [(0, "chr1", 1), (0, "chr1", 6), (1, "chr2", 1), (1, "chr2", 4), (1, "chr2", 4)]
    assert readers.bed_list(spark, put(tmp_path / "list", "# x\na.bed\n/b.bed\n\n"), "/d/") == ["/d/a.bed", "/b.bed"]
    m = genes.model_from_beds(spark, p, f"{tmp_path}/s/b.bed")
    assert sorted(rows(m)) == [("chr1", 1, 5, "*", "gene"), ("chr1", 6, 8, "*", "gene"), ("chr2", 1, 9, "+", "exon"), ("chr2", 4, 9, "-", "exon")]
    track = spark.createDataFrame([("chr1", 2, 4, 3), ("chr1", 8, 9, 1), ("chr2", 1, 2, 1)], "chr string, start long, end long, count long")
    sinks.wig_variable(track, f"{tmp_path}/wig")
    assert text_of(f"{tmp_path}/wig") == "variableStep chrom=chr1\n2 3\n3 3\n8 1\nvariableStep chrom=chr2\n1 1\n"
    for gap, want in ((0, []), (3, []), (4, [(4, 8)]), (-1, [(4, 8)])):
        assert rows(coverage.filled(track, gap).filter("count = 0"), "start", "end") == want
    sinks.dense_matrix(spark.createDataFrame([("A", 1, 2), ("B", 2, 5)], "barcode string, peak long, n long").coalesce(1), f"{tmp_path}/dense")
    assert sorted(text_of(f"{tmp_path}/dense").split()) == ["A,2,0", "B,0,5", "barcode,1,2"]


@pytest.mark.parametrize("mode", ["left", "both"])
def test_wide_rows_meet_all_partners_once(spark, mode):
    rng = np.random.default_rng(5)
    a = [("chr1", int(s), int(s + w), i) for i, (s, w) in enumerate(zip(rng.integers(0, 4000, 60), rng.choice([1, 5, 900, 2500], 60)))]
    b = [("chr1", int(s), int(s + w), i) for i, (s, w) in enumerate(zip(rng.integers(0, 4000, 60), rng.choice([1, 7, 40] if mode == "left" else [1, 7, 900, 3000], 60)))]
    schema = "chr string, start long, end long, id long"
    got = sorted(rows(primitives.iv_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), tile=2, wide=mode), "q_id", "s_id"))
    assert got == sorted((x[3], y[3]) for x in a for y in b if y[1] < x[2] and y[2] > x[1])


def test_exact_tests_of_large_tables():
    # sums over the whole support in logarithms
    from math import exp, fsum, lgamma, log

    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    for a, b, c, d in ((30, 400, 500, 9000), (3, 40, 900, 100), (0, 5, 7, 9), (2000, 3000, 4000, 6000), (12, 0, 3, 4)):
        total = choose(a + b + c + d, a + c)
        want = min(1.0, fsum(exp(choose(a + b, i) + choose(c + d, a + c - i) - total) for i in range(a, min(a + b, a + c) + 1)))
        assert hypergeometric.fisher_greater(a, b, c, d) == pytest.approx(want, rel=1e-8, abs=1e-300)
    big = hypergeometric.odds_ratio(20000, 100000, 50000, 800000)
    assert log(big) == pytest.approx(log(20000 * 800000 / (100000 * 50000)), abs=1e-3)
    assert 0 <= hypergeometric.fisher_greater(500000, 500000, 500000, 500000) <= 1


def test_alleles_past_the_end(spark):
    pieces = sequences.chunks(spark.createDataFrame([("s", "ACGT")], "name string, seq string"))
    v = spark.createDataFrame([(1, "s", 64, "", "A"), (2, "s", 4, "", "A"), (3, "s", 3, "T", "")], "id long, name string, start long, ref string, alt string")
    got = {r.id: (r.start, r.allele) for r in variants.normalized(v, pieces, "null").collect()}
    assert got == {1: (None, None), 2: (4, "A"), 3: (3, "")}
    with pytest.raises(Exception, match="not the reference"):
        variants.normalized(v, pieces).collect()
    x = spark.range(1).select(variants.length_allele_id(F.lit("SQ.x"), F.lit(1), F.lit(3), F.lit(4), F.lit(2)).alias("i"))
    assert x.first().i.startswith("ga4gh:VA.") and len(x.first().i) == 41


def test_union_except_of_many(spark):
    r = spark.createDataFrame([(1, "chr1", 0, 10), (2, "chr1", 5, 15), (3, "chr1", 20, 30), (3, "chr1", 25, 28)], "set_id long, chr string, start long, end long")
    got = sorted(rows(ranges.union_except(r, r.select("set_id").distinct()), "set_id", "start", "end"))
    assert got == [(1, 5, 15), (1, 20, 30), (2, 0, 10), (2, 20, 30), (3, 0, 15)]
