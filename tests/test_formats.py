"""Readers, sinks and the operators on their records, against known or plain results."""

import glob
import gzip
import itertools
import os
import random
import statistics as plain

import pytest
from pyspark.sql import functions as F

from locusflow.operators import alignments, coverage, genes, sequences, signal, variants
from locusflow.sources import readers, sinks
from locusflow.streaming import coverage as live


def put(path, text):
    path.write_text(text)
    return str(path)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def text_of(path):
    out = ""
    for p in sorted(glob.glob(f"{path}/part-*")):
        out += (gzip.open(p, "rt") if p.endswith(".gz") else open(p)).read()
    return out


def test_bed(spark, tmp_path):
    p = put(tmp_path / "a.bed", "browser x\n#c\nchrom\tstart\tend\nchr1\t5\t9\tn\t+\nchr2\t1\t2\n\n")
    assert rows(readers.bed(spark, p), "chr", "start", "end", "rest") == [("chr1", 5, 9, "n\t+"), ("chr2", 1, 2, None)]
    bad = put(tmp_path / "bad.bed", "chr1\t1\t2\nchr1\tx\t2\n")
    with pytest.raises(Exception, match="not a BED line"):
        readers.bed(spark, bad).collect()
    assert rows(readers.bed_loose(spark, bad)) == [("chr1", -1, 2), ("chr1", 1, 2)]
    assert readers.bed(spark, put(tmp_path / "none.bed", "")).count() == 0
    out = str(tmp_path / "out")
    sinks.bed(readers.bed(spark, p), out, gz=True)
    assert text_of(out) == "chr1\t5\t9\tn\t+\nchr2\t1\t2\n"


def test_small_tables(spark, tmp_path):
    assert rows(readers.chrom_sizes(spark, put(tmp_path / "s", "chr1 20\nchr2\t9\n"))) == [("chr1", 20), ("chr2", 9)]
    f = readers.fragments(spark, put(tmp_path / "x.frag.tsv", "# h\nchr1\t1\t5\tAA-1\t2\n"))
    assert rows(f.withColumn("stem", readers.file_stem(F.col("file"))), "chr", "start", "end", "barcode", "support", "stem") == [("chr1", 1, 5, "AA-1", 2, "x")]
    m = readers.signal_matrix(spark, put(tmp_path / "m.tsv", "id\ta.1\tb\nchr1_1_5\t0.5\t2\nchr1_x\t1\t1\n"))
    assert rows(m) == [("chr1", 1, 5, "a.1", 0.5), ("chr1", 1, 5, "b", 2.0)]
    assert rows(readers.barcode_map(spark, put(tmp_path / "b", "xAA c1\n"))) == [("xAA", "c1")]


def test_fasta_and_collection_digests(spark, tmp_path):
    p = put(tmp_path / "base.fa", ">chrX\nTTGG\nGGAA\n>chr1 one > two\nGGAA\n>chr2\nGCGC\n")
    records = readers.fasta(spark, p)
    assert rows(records, "name", "description", "seq") == [("chr1", "one > two", "GGAA"), ("chr2", None, "GCGC"), ("chrX", None, "TTGGGGAA")]
    named = records.select(F.lit("base").alias("collection"), F.struct("block", "line").alias("ord"), "name", "seq")
    got = sequences.level1(sequences.level2(named)).first()
    # fixed values
    assert got.names == "Fw1r9eRxfOZD98KKrhlYQNEdSRHoVxAG"
    assert got.sequences == "0uDQVLuHaOZi1u76LjV__yrVUIz9Bwhr"
    assert got.lengths == "cGRMZIb3AVgkcAfNv39RN7hnT5Chk7RX"
    assert got.digest == "XZlrcEGi6mlopZ2uD8ObHkQB1d0oDwKk"
    assert got.name_length_pairs == "B9MESWM8k-hK_OeQK8bZNAG74pLY0Ujq"
    assert got.sorted_name_length_pairs == "zjM1Ie9m0zFbqsAnZ6jAJSXuFpKTr40J"
    assert got.sorted_sequences == "KgWo6TT1Lqw6vgkXU9sYtCU9xwXoDt6M"
    out = str(tmp_path / "fa")
    sinks.fasta(records.orderBy("line"), out, 3)
    assert text_of(out).startswith(">chrX\nTTG\nGGG\nAA\n>chr1\nGGA\nA\n")


def test_compare(spark):
    a, b = list("wxyyz"), list("zyyxq")
    e = spark.createDataFrame([(c, "names", i, v) for c, s in (("A", a), ("B", b), ("C", list("xyyz")), ("D", list("xyzz"))) for i, v in enumerate(s)], "collection string, attribute string, ord int, value string")
    pairs = spark.createDataFrame([("A", "B"), ("A", "A"), ("A", "C"), ("A", "D")], "a string, b string")
    got = {(r.a, r.b): tuple(r)[3:] for r in sequences.compare(e, pairs).collect()}
    assert got == {("A", "B"): (5, 5, 4, False), ("A", "A"): (5, 5, 5, True), ("A", "C"): (5, 4, 4, True), ("A", "D"): (5, 4, 3, None)}


def test_extract_across_chunks(spark):
    seq = "".join(random.Random(1).choices("ACGT", k=53))
    pieces = sequences.chunks(spark.createDataFrame([("s", seq)], "name string, seq string"), 7)
    want = [(i, "s", a, b) for i, (a, b) in enumerate(itertools.combinations(range(0, 60, 4), 2))] + [(999, "s", 5, 5), (1000, "t", 1, 3)]
    got = sequences.extract(pieces, spark.createDataFrame(want, "id int, name string, start long, end long"), 7)
    assert {r.id: r.bases for r in got.collect()} == {i: seq[a:b] if n == "s" else "" for i, n, a, b in want}


def test_alleles_are_fully_justified(spark):
    rng = random.Random(3)
    seq = "".join(rng.choices("AC", k=60)) + "ACACACACACAC" * 8 + "".join(rng.choices("AC", k=40))
    cases = []
    for i in range(150):
        s, n = rng.randrange(len(seq) - 6), rng.randrange(5)
        alt = "".join(rng.choices("AC", k=rng.randrange(5)))
        if seq[s : s + n] != alt:
            cases.append((i, "s", s, seq[s : s + n], alt))
    pieces = sequences.chunks(spark.createDataFrame([("s", seq)], "name string, seq string"), 16)
    df = spark.createDataFrame(cases, "id int, name string, start long, ref string, alt string")
    got = {r.id: r for r in variants.normalized(df, pieces, size=16, contexts=(2, 11)).collect()}
    assert len(got) == len(cases)
    for i, _, s, ref, alt in cases:
        r = got[i]
        changed = seq[:s] + alt + seq[s + len(ref) :]
        assert seq[: r.start] + r.allele + seq[r.end :] == changed
        # every place where an equal insertion or deletion can be is inside, and nothing else
        if len(r.allele) != r.end - r.start and len(ref) * len(alt) == 0:
            d = len(alt) - len(ref)
            k = abs(d)
            at = [p for p in range(len(seq) + 1) if (d < 0 and p + k <= len(seq) and seq[:p] + seq[p + k :] == changed) or (d > 0 and seq[:p] + changed[p : p + k] + seq[p:] == changed)]
            assert (r.start, r.end) == (min(at), max(at) + (k if d < 0 else 0))
    wrong = spark.createDataFrame([(1, "s", 0, "TTT", "A")], df.schema)
    with pytest.raises(Exception, match="not the reference"):
        variants.normalized(wrong, pieces, size=16).collect()
    assert variants.normalized(wrong, pieces, "null", size=16).first().start is None


def test_computed_identifiers(spark):
    one = spark.range(1)
    # fixed values
    a, b = F.lit("SQ.F-LrLMe1SRpfUZHkQmvkVKFEGaoDeHul"), F.lit("SQ.IIB53T8CNeJJdUqzn9V_JnRtQadwWCbl")
    r = one.select(variants.location_digest(a, F.lit(55181319), F.lit(55181320)), variants.allele_id(b, F.lit(44908821), F.lit(44908822), F.lit("T"))).first()
    assert tuple(r) == ("_G2K0qSioM74l_u3OaKR0mgLYdeTL7Xd", "ga4gh:VA.0AePZIWZUNsUlQTamyLrjm2HWUw2opLt")


def test_vcf_to_identifiers(spark, tmp_path):
    p = put(tmp_path / "v.vcf", "##x\n#CHROM\nc\t3\tn\tG\tT,<DEL>,*\t.\nc\t0\tn\tG\tT\t.\nd\t1\tn\tA\tC\t.\n")
    v = readers.vcf(spark, p).withColumn("id", F.monotonically_increasing_id()).withColumnRenamed("name", "label").withColumnRenamed("chr", "name")
    pieces = sequences.chunks(spark.createDataFrame([("c", "acgt")], "name string, seq string"))
    got = variants.identified(v, pieces, spark.createDataFrame([("c", "SQ.x")], "name string, accession string")).collect()
    assert [(r.name, r.start, r.end, r.allele, r.vrs_id[:9]) for r in got] == [("c", 2, 3, "T", "ga4gh:VA.")]


def test_five_numbers_and_signal(spark):
    rng = random.Random(5)
    for n in (1, 2, 3, 4, 7, 10, 33):
        v = sorted(rng.choice([rng.random() * 5, 2.0, 40.0]) for _ in range(n))
        low, high = v[: (n + 1) // 2], v[n // 2 :]
        lo, hi = plain.median(low), plain.median(high)
        want = (min(x for x in v if x >= lo - 1.5 * (hi - lo)), lo, plain.median(v), hi, max(x for x in v if x <= hi + 1.5 * (hi - lo)))
        got = signal.five_numbers(spark.createDataFrame([("c", x) for x in v], "condition string, value double")).first()
        assert tuple(got)[1:] == pytest.approx(want)
    s = spark.createDataFrame([("chr1", 1, 5, "a", 0.5), ("chr1", 4, 9, "a", 0.2), ("chr1", 4, 9, "b", 3.0)], "chr string, start long, end long, condition string, value double")
    q = spark.createDataFrame([("chr1", 3, 6, 1), ("chr1", 20, 30, 2)], "chr string, start long, end long, id long")
    assert rows(signal.region_signal(q, s), "id", "condition", "value") == [(1, "a", 0.5), (1, "b", 3.0)]


def test_library_complexity(spark, tmp_path):
    line = "{}\t{}\t{}\t{}\t{}\t4M\t*\t0\t{}\tACGT\tIIII\n".format
    pair = lambda n, c, p, q: line(n, 65, c, p, 60, 9) + line(n, 129, c, q, 60, -9)
    text = "@HD\tVN:1.0\n" + pair("a", "chr1", 3, 9) + pair("b", "chr1", 3, 9) + pair("c", "chr1", 4, 9) + pair("m", "chrM", 1, 2)
    text += line("low", 65, "chr1", 3, 10, 9) + line("alone", 65, "chr1", 7, 60, 9) + line("dup", 65 + 1024, "chr2", 7, 255, 9) + line("un", 4, "*", 0, 0, 0)
    reads = readers.sam(spark, put(tmp_path / "r.sam", text))
    r = alignments.library_complexity(reads).first()
    assert (r.total, r.distinct, r.one, r.two, r.duplicates, r.mito) == (3, 2, 1, 1, 1, 2)
    assert (r.nrf, r.pbc1, r.pbc2) == pytest.approx((1 / 3, 1 / 2, 1))
    assert tuple(alignments.library_complexity(reads.filter("false")).first()) == (0,) * 9
    cut = reads.filter("qname = 'a'").withColumnRenamed("pos", "start").select(alignments.atac_position())
    assert sorted(x[0] for x in cut.collect()) == [6, 12]


GTF = 't\tx\t{}\t{}\t{}\t.\t{}\t.\tgene_id "g"; transcript_id "{}"; gene_biotype "protein_coding";\n'.format


def test_gene_model(spark, tmp_path):
    text = "#h\n" + GTF("gene", 1, 100, "+", "") + GTF("exon", 1, 50, "+", "p") + GTF("CDS", 11, 40, "+", "p") + GTF("exon", 1, 50, "-", "m") + GTF("CDS", 11, 40, "-", "m")
    got = genes.gene_model(genes.gtf(spark, put(tmp_path / "a.gtf", text), protein_coding=True, ucsc=True))
    assert rows(got.filter("part like '%utr'"), "chr", "start", "end", "strand", "part") == [("chrt", 0, 10, "+", "five_utr"), ("chrt", 0, 10, "-", "three_utr"), ("chrt", 40, 50, "+", "three_utr"), ("chrt", 40, 50, "-", "five_utr")]
    with_utr = put(tmp_path / "b.gtf", text + GTF("UTR", 1, 10, "-", "m"))
    got = genes.gene_model(genes.gtf(spark, with_utr))
    assert rows(got.filter("part like '%utr'"), "start", "end", "strand", "part") == [(0, 10, "-", "three_utr")]
    assert rows(got.filter("part = 'genes'"), "chr", "start", "end") == [("t", 0, 100)]


def test_expected_partitions(spark):
    observed = spark.createDataFrame([("p", 3), ("e", 0), ("intergenic", 7)], "partition string, n long")
    parts = spark.createDataFrame([("p", "c", 0, 10), ("e", "c", 5, 15)], "partition string, chr string, start long, end long")
    got = {r.partition: r for r in genes.expected(observed, parts, spark.createDataFrame([("c", 100)], "chr string, size long")).collect()}
    assert [got[k].expected for k in ("p", "e", "intergenic")] == pytest.approx([1, 1, 8])
    assert got["e"].log10_oe == float("-inf")
    assert got["p"].p == pytest.approx(0.0350, abs=1e-4)  # chi-square 4 + 4/9


def test_tracks_and_counts(spark, tmp_path):
    track = spark.createDataFrame([("c", 2, 4, 1), ("c", 4, 11, 2), ("c", 13, 14, 5)], "chr string, start long, end long, count long")
    out = str(tmp_path / "w")
    sinks.wig(track, out, 8)
    assert text_of(out) == "fixedStep chrom=c start=2 step=1\n1\n1\n2\n2\n2\n2\nfixedStep chrom=c start=8 step=1\n2\n2\n2\nfixedStep chrom=c start=13 step=1\n5\n"
    sinks.bedgraph(track, out)
    assert text_of(out) == "c\t1\t3\t1\nc\t3\t10\t2\nc\t12\t13\t5\n"
    counts = spark.createDataFrame([("AC", "p2", 3), ("AA", "p1", 1), ("TT", "p1", 2)], "barcode string, peak string, n long")
    sinks.matrix_market(counts, str(tmp_path / "m"))
    assert text_of(tmp_path / "m" / "matrix").splitlines()[1:] == ["3 2 3", "1 1 1", "2 2 3", "3 1 2"]
    assert text_of(tmp_path / "m" / "barcodes") == "AA\nAC\nTT\n"
    f = spark.createDataFrame([("c", 1, 2, "AA", 1, "x"), ("c", 5, 7, "AC", 1, "y")], "chr string, start long, end long, barcode string, support long, cluster string")
    sinks.pseudobulk(f, str(tmp_path / "pb"))
    assert text_of(tmp_path / "pb" / "cluster=y") == "c\t5\t7\tAC\t1\n"


@pytest.mark.parametrize("kind,smooth", [("core", 0), ("start", 2), ("end", 2)])
def test_streaming_coverage_is_batch_coverage(spark, tmp_path, kind, smooth):
    rng = random.Random(8)
    data = sorted((c, s, s + rng.randrange(3, 12)) for c in ("c1", "c2") for s in (rng.randrange(60) for _ in range(40)))
    data = sorted(data, key=lambda r: (r[1], r[0]))
    schema = "chr string, start long, end long"
    src, out = tmp_path / "in", str(tmp_path / f"q{kind}")
    src.mkdir()
    for i in range(4):
        part = data[i * 20 : i * 20 + 20] + ([("c1", None, None), ("c2", None, None)] if i == 3 else [])
        (src / f"{i}.json").write_text("\n".join('{"chr":"%s"%s}' % (c, "" if s is None else f',"start":{s},"end":{e}') for c, s, e in part))
        os.utime(src / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    q = live.coverage(stream, kind, smooth).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-c").trigger(availableNow=True).start()
    q.awaitTermination()
    df = spark.createDataFrame(data, schema)
    events = coverage.core_events(df) if kind == "core" else coverage.point_events(df, kind, smooth)
    spread = lambda t: rows(coverage.fixed_step(t))
    assert spread(spark.read.parquet(out)) == spread(coverage.runs(events))
