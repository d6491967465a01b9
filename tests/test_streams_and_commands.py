"""Streams of records, and commands on files."""

import gzip
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow import __main__ as commands
from locusflow.functions.digests import sha512t24u
from locusflow.operators import sequences, variants
from locusflow.sources import readers
from locusflow.streaming import records


def drop(folder, texts, kind="txt"):
    folder.mkdir(exist_ok=True)
    for i, t in enumerate(texts):
        p = folder / f"{i}.{kind}"
        p.write_text(t)
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def drained(df, out):
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-c").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def test_streamed_regions(spark, tmp_path):
    src = drop(tmp_path / "in", ["#h\nchr1\t5\t9\tn\t+\nchrom\tstart\tend\n", "track x\nchr2\t1\t2\n\n"])
    got = drained(records.bed(spark, src, 1), str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == [("chr1", 5, 9, "n\t+"), ("chr2", 1, 2, None)]


def test_streamed_variants_are_those_of_a_batch(spark, tmp_path):
    seq = "".join(random.Random(5).choices("ACGT", k=60))
    s = spark.createDataFrame([("c", seq)], "name string, seq string")
    pieces, names = sequences.chunks(s, 4096), s.select("name", F.concat(F.lit("SQ."), sha512t24u(F.col("seq"))).alias("accession"))
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    lines = [f"c\t{i + 1}\tv{i}\t{seq[i]}\t{other[seq[i]]},<DEL>\t.\t.\t.\n" for i in (0, 7, 30, 59)] + ["c\tx\t.\tA\tC\t.\n", "d\t4\t.\tA\tC\t.\n"]
    src = drop(tmp_path / "in", ["##v\n" + "".join(lines[:2]), "".join(lines[2:]) + lines[0]])
    out = str(tmp_path / "out")
    q = records.identified(records.vcf(spark, src, 1), pieces, names, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "c"))
    q.awaitTermination()
    got = sorted({tuple(r) for r in spark.read.parquet(out).select("chr", "start", "ref", "alt", "from", "to", "vrs_id").collect()})
    v = readers.vcf(spark, src).select(F.col("chr").alias("name"), "start", "ref", "alt").distinct().withColumn("id", F.struct("name", "start", "ref", "alt"))
    want = variants.identified(v, pieces, names).select("id.name", "id.start", "id.ref", "id.alt", F.col("start").alias("f"), "end", "vrs_id")
    assert got == sorted(map(tuple, want.collect())) and len(got) == 4


def test_streamed_sequences(spark, tmp_path):
    text = [">a one\nACGT\nac", "gt\n>b\n", ">c  two words\nNN\n"]
    lines = [line for t in "".join(text).split("\n") for line in [t] if line]
    rows = [{"stream": s, "ord": i, "line": line} for s in ("x", "y") for i, line in enumerate(lines)] + [{"stream": "x", "ord": 99, "line": None}]
    rows.sort(key=lambda r: r["ord"])
    src = drop(tmp_path / "in", ["\n".join(json.dumps(r) for r in rows[i : i + 4]) for i in range(0, len(rows), 4)], "json")
    stream = spark.readStream.schema("stream string, ord long, line string").option("maxFilesPerTrigger", 1).json(src)
    got = drained(records.sequence_digests(stream), str(tmp_path / "out"))
    named = spark.createDataFrame([("a", "one", "ACGTACGT"), ("b", None, ""), ("c", "two words", "NN")], "name string, description string, seq string")
    want = [tuple(r) for r in named.select("name", "description", F.length("seq").cast("long"), sha512t24u(F.col("seq")), F.md5("seq")).orderBy("name").collect()]
    rows = sorted(map(tuple, got.collect()))
    assert [r[1:] for r in rows if r[0] == "x"] == want and [r[1:] for r in rows if r[0] == "y"] == want[:2]  # y's last record is still open


@pytest.fixture
def beds(tmp_path):
    (tmp_path / "a.bed").write_text("chr1\t5\t9\tn\nchr1\t8\t12\nchr2\t1\t4\n")
    (tmp_path / "b.bed").write_text("chr1\t10\t20\nchr2\t2\t3\n")
    (tmp_path / "sizes").write_text("chr1\t30\nchr2\t6\n")
    return tmp_path


@pytest.mark.parametrize(
    "words,want",
    [
        ("reduce --input a.bed", "chr1 5 12|chr2 1 4"),
        ("shift --offset 2 --input a.bed", "chr1 7 11|chr1 10 14|chr2 3 6"),
        ("flank --width 2 --start --input a.bed", "chr1 3 5|chr1 6 8|chr2 0 1"),
        ("resize --width 2 --fix end --input b.bed", "chr1 18 20|chr2 1 3"),
        ("gaps --chrom-sizes sizes --input a.bed", "chr1 0 5|chr1 12 30|chr2 0 1|chr2 4 6"),
        ("trim --chrom-sizes sizes --input a.bed", "chr1 5 9|chr1 8 12|chr2 1 4"),
        ("setdiff -a a.bed -b b.bed", "chr1 5 10|chr2 1 2|chr2 3 4"),
        ("intersect -a a.bed -b b.bed", "chr1 10 12|chr2 2 3"),
        ("pintersect -a a.bed -b b.bed", "chr1 8 8|chr1 10 10"),
        ("concat -a b.bed -b b.bed", "chr1 10 20|chr1 10 20|chr2 2 3|chr2 2 3"),
    ],
)
def test_range_commands(spark, beds, words, want):
    files = ("a.bed", "b.bed", "sizes")
    out = f"{beds}/out/x.bed"
    commands.main(["ranges", *[f"{beds}/{w}" if w in files else w for w in words.split()], "--output", out], spark)
    got = sorted(tuple(x.split("\t")) for x in open(out).read().splitlines())
    want = sorted(tuple(x.split()) for x in want.split("|"))
    assert got == want


def test_other_commands(spark, beds, capsys):
    run = lambda *words: commands.main(list(words), spark)
    run("ranges", "jaccard", "-a", f"{beds}/a.bed", "-b", f"{beds}/b.bed")
    assert float(capsys.readouterr().out) == 3 / 18
    run("overlaps", "--query", f"{beds}/b.bed", "--universe", f"{beds}/a.bed", "--output", f"{beds}/o.bed.gz")
    assert gzip.open(f"{beds}/o.bed.gz", "rt").read() == "chr1\t8\t12\nchr2\t1\t4\n"
    run("consensus", "--beds", f"{beds}/a.bed", f"{beds}/b.bed", "--min-count", "2")
    assert capsys.readouterr().out.splitlines() == ["chr1\t5\t20\t2", "chr2\t1\t4\t2"]
    run("uniwig", "--file", f"{beds}/a.bed", "--chromref", f"{beds}/sizes", "--outputtype", "npy", "--fileheader", f"{beds}/npy", "--counttype", "core")
    assert np.load(f"{beds}/npy/chr2_core.npy").tolist() == [1, 1, 0, 0, 0]  # from position 2 to the end
    run("uniwig", "--file", f"{beds}/a.bed", "--chromref", f"{beds}/sizes", "--outputtype", "bedgraph", "--fileheader", f"{beds}/t", "--counttype", "core")
    assert open(f"{beds}/t_core.bedGraph").read() == "chr1\t5\t11\t1\nchr2\t1\t3\t1\n"
    run("igd", "create", "--filelist", f"{beds}/*.bed", "--output", f"{beds}/db")
    run("igd", "search", "--database", f"{beds}/db", "--query", f"{beds}/b.bed")
    assert "a.bed" in capsys.readouterr().out
    (beds / "g.fa").write_text(">chrX\nTTGGGGAA\n>chr1\nGGAA\n>chr2\nGCGC\n")
    run("refget", "--fasta", f"{beds}/g.fa")
    assert json.loads(capsys.readouterr().out)["digest"] == "XZlrcEGi6mlopZ2uD8ObHkQB1d0oDwKk"  # fixed value
    with pytest.raises(SystemExit):
        run("ranges", "reduce")
