"""Transcript coordinates and variant descriptions on a small genome."""

import random

import pytest
from pyspark.sql import functions as F

from locusflow.operators import nomenclature, sequences, transcripts, variants

SEQ = "".join(random.Random(2).choices("ACGT", k=120))
EXONS = [(10, 20), (30, 42), (60, 75)]
FLIP = str.maketrans("ACGT", "TGCA")
T = "tx string, gene string, chr string, strand string, exons array<struct<start:long,end:long>>, cds_start long, cds_end long, mane boolean"


@pytest.fixture(scope="module")
def tx(spark):
    return spark.createDataFrame([("P.1", "G", "c", "+", EXONS[::-1], 14, 65, True), ("M.1", "H", "c", "-", EXONS, 14, 65, True), ("N.1", "G", "c", "+", EXONS, None, None, False)], T)


@pytest.fixture(scope="module")
def pieces(spark):
    return sequences.chunks(spark.createDataFrame([("c", SEQ)], "name string, seq string"), 16)


def places(strand):
    g = [p for a, b in EXONS for p in range(a, b)]
    return g if strand == "+" else g[::-1]


def test_positions(spark, tx):
    want, ask = {}, []
    for name, strand in (("P.1", "+"), ("M.1", "-")):
        g = places(strand)
        first = g.index(14 if strand == "+" else 64)
        stop = g.index(64 if strand == "+" else 14)
        for off, pos in enumerate(g):
            n = off - first + 1 if off >= first else off - first
            star = off > stop
            ask.append((len(ask), name, "c", off - stop if star else n, star, 0))
            want[len(ask) - 1] = pos
            ask.append((len(ask), name, "n", off + 1, False, 2))
            want[len(ask) - 1] = pos + (2 if strand == "+" else -2)
        ask += [(len(ask), name, "c", 0, False, 0), (len(ask) + 1, name, "n", len(g) + 1, False, 0), (len(ask) + 2, name, "c", 99, True, 0)]
    df = spark.createDataFrame(ask, "id int, tx string, kind string, number long, after_stop boolean, intronic long")
    got = {r.id: r.position for r in transcripts.to_genome(df, tx).collect()}
    assert got == {a[0]: want.get(a[0]) for a in ask}
    mane = spark.createDataFrame([(1, "G", "c", 1, False, 0)], "id int, gene string, kind string, number long, after_stop boolean, intronic long")
    assert [r.position for r in transcripts.to_genome(mane, tx, "gene").collect()] == [14]


def test_lengths_and_sequence(spark, tx, pieces):
    r = {x.tx: x for x in transcripts.indexed(tx).withColumn("coding", transcripts.coding_length()).withColumn("back", transcripts.offset_of(F.lit(31))).withColumn("intron", transcripts.offset_of(F.lit(25))).collect()}
    assert [(r[k].length, r[k].coding, r[k].back, r[k].intron) for k in ("P.1", "M.1", "N.1")] == [(37, 23, 11, None), (37, 23, 25, None), (37, None, 11, None)]
    joined = "".join(SEQ[a:b] for a, b in EXONS)
    got = {x.tx: x.bases for x in transcripts.mature(tx, pieces, 16).collect()}
    assert got == {"P.1": joined, "N.1": joined, "M.1": joined[::-1].translate(FLIP)}


def test_parse(spark):
    good = ["NC_1.1:g.5A>T", "NM_1.2(GENE):c.-3+2_*4-1del", "NM_1:c.7_8insACG", "NM_1:n.4_6delACTinsGG", "x:g.(3dup)", "x:g.3_4inv", "x:c.9=", "x:c.5A=", "x:g.(4_6)_246del", "x:g.(?_6)_(9_?)dup", "x:g.=", "x:c.?", "x:m.8993T>G", "x:r.76a>u", "x:g.5copy3", "x:g.7CAG[23]", "x:c.4?", "x:g.4_6inv",
            "NP_1:p.Val600Glu", "NP_1(G):p.(Trp24Ter)", "NP_1:p.Lys2_Leu3insGlnSer", "NP_1:p.Arg97ProfsTer23", "NP_1:p.Ter110GlnextTer17", "NP_1:p.?", "x:g.5del3", "x:g.5AC>GT"]
    bad = ["x:c.(-12)del", "NM_1:q.5A>T", "x:p.5A>T", "x:g.(?_?)del", "x:g.?_5del", "x:g.*5del", "x:g.5copy", "x:g.7CAG[]", "x:g.5_6", "x:g.7insA", "g.5A>T", "x:g.(3dup", "x:c.[5A>T]", "", None]
    df = spark.createDataFrame([(s,) for s in good + bad], "s string").select("s", nomenclature.parse("s").alias("h"))
    got = {r.s: r.h for r in df.collect()}
    assert {s for s in got if got[s].valid} == set(good)
    h = got["NM_1.2(GENE):c.-3+2_*4-1del"]
    assert (h.accession, h.gene, h.kind, h.edit, tuple(h.first), tuple(h.second)) == ("NM_1.2", "GENE", "c", "del", (-3, False, 2), (4, True, -1))
    h = got["x:g.(?_6)_(9_?)dup"]
    assert (h.edit, h.first.number, h.second.number, h.uncertain, h.ranged, h.whole) == ("dup", 6, 9, True, True, False)
    assert (got["x:g.(4_6)_246del"].first.number, got["x:g.(4_6)_246del"].second.number) == (6, 246)
    assert (got["x:g.7CAG[23]"].edit, got["x:g.7CAG[23]"].ref, got["x:g.7CAG[23]"].copies, got["x:g.5copy3"].copies) == ("repeat", "CAG", 23, 3)
    assert (got["x:g.="].edit, got["x:g.="].whole, got["x:c.?"].edit, got["x:r.76a>u"].alt) == ("same", True, "unknown", "U")
    h = got["NP_1:p.Lys2_Leu3insGlnSer"]
    assert (h.kind, h.edit, h.alt, h.first.number, h.second.number, got["NP_1:p.Arg97ProfsTer23"].valid, got["NP_1(G):p.(Trp24Ter)"].uncertain) == ("p", "ins", "GlnSer", 2, 3, True, True)
    assert (got["NM_1:n.4_6delACTinsGG"].ref, got["NM_1:n.4_6delACTinsGG"].alt) == ("ACT", "GG")


def test_alleles_agree_between_transcript_and_genome(spark, tx, pieces):
    g, minus = places("+"), places("-")
    flip = lambda s: s[::-1].translate(FLIP)
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    p = g[15]
    base, m = SEQ[p], minus.index(p) + 1
    same = [  # one variant as genome, plus and minus strand describe it
        [f"c:g.{p + 1}{base}>{other[base]}", f"P.1:n.16{base}>{other[base]}", f"M.1:n.{m}{flip(base)}>{flip(other[base])}"],
        [f"c:g.{p + 1}_{p + 3}del", "P.1:n.16_18del", f"M.1:n.{m - 2}_{m}del"],
        [f"c:g.{p + 1}_{p + 2}insGGA", "P.1:n.16_17insGGA", f"M.1:n.{m - 1}_{m}insTCC"],
        [f"c:g.{p + 1}_{p + 3}dup", "P.1:n.16_18dup", f"M.1:n.{m - 2}_{m}dup"],
    ]
    rows = [(i * 10 + k, s) for i, group in enumerate(same) for k, s in enumerate(group)] + [(90, "c:g.3_5inv"), (91, "P.1:n.99del"), (92, "c:g.3_9insA"), (93, "c:g.="), (94, "c:g.(3_5)_9del"), (95, "c:g.5copy2"), (96, "c:g.3A[4]"), (97, "c:m.5del"), (98, "c:g.5?")]
    found = nomenclature.alleles(spark.createDataFrame(rows, "id int, hgvs string"), pieces, tx, 16)
    got = {r.id: (r.name, r.start, r.end, r.allele) for r in variants.normalized(found, pieces, size=16).collect()}
    assert set(got) == {i * 10 + k for i in range(4) for k in range(3)}
    for i in range(4):
        assert got[i * 10] == got[i * 10 + 1] == got[i * 10 + 2]
    assert got[0] == ("c", p, p + 1, other[base])


def test_ingest(spark, tmp_path):
    import gzip
    import json

    record = lambda i, **k: {"id": i, "gene_name": "G", "contig": "NC_1.1", "strand": -1, "cds_start": 12, "cds_end": 30, "exons": [[10, 20], [25, 40]], "other": {"x": 1}} | k
    records = [record("NM_1.2"), record("ENST2.9", strand=1, gene_name=None), record("NM_3.1", cds_start=None, cds_end=None), record("NM_4.1", contig="NC_9.9"), record("NM_5.1", strand=0), record("NM_6.1", exons=[])]
    with gzip.open(tmp_path / "t.json.gz", "wt") as f:
        json.dump({"version": "1", "transcripts": {r["id"]: r for r in records}}, f)
    (tmp_path / "m.txt").write_text("#GeneID\tRefSeq_nuc\tEnsembl_nuc\tMANE_status\n1\tNM_1.2\tENST1.1\tMANE Select\n2\tNM_2.1\tENST2.3\tMANE Plus Clinical\n3\tNM_3.1\tENST3.1\tother\n4\tNM_7.1\n")
    mane = transcripts.mane_summary(spark, str(tmp_path / "m.txt"))
    assert sorted(tuple(r) for r in mane.collect()) == [("ENST1", False), ("ENST1.1", False), ("ENST2", True), ("ENST2.3", True), ("NM_1", False), ("NM_1.2", False), ("NM_2", True), ("NM_2.1", True)]
    t = transcripts.ingest(spark, str(tmp_path / "t.json.gz"), spark.createDataFrame([("NC_1.1", "c")], "contig string, chr string"), mane)
    got = {r.tx: (r.gene, r.chr, r.strand, [tuple(e) for e in r.exons], r.cds_start, r.mane, r.clinical) for r in t.collect()}
    e = [(10, 20), (25, 40)]
    assert got == {"NM_1.2": ("G", "c", "-", e, 12, True, False), "ENST2.9": ("", "c", "+", e, 12, True, True), "NM_3.1": ("G", "c", "-", e, None, False, False)}
    assert transcripts.indexed(t).count() == 3
    with pytest.raises(ValueError, match="MANE_status"):
        (tmp_path / "n.txt").write_text("RefSeq_nuc\tEnsembl_nuc\na\tb\n")
        transcripts.mane_summary(spark, str(tmp_path / "n.txt"))
