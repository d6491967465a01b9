"""Binary formats against plain readers and writers of the published layouts."""

import glob
import gzip
import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.operators import alignments
from locusflow.sources import arrays, bam, files, indexed, readers, sinks

REFS = [("chr1", 90_000), ("chr2", 40_000)]


def block(data):
    z = zlib.compressobj(wbits=-15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def plain_reads(n=300):
    r = random.Random(4)
    out = [(f"q{i}", r.choice([0, 16, 65, 1024 + 16]), c, r.randrange(REFS[c][1] - 200), r.choice([255, 0, 31, 60]), [(5, 4), (20, 0), (r.randrange(1, 9), 2), (10, 7)], r.randrange(-50, 50), 35) for c in (0, 1) for i in range(n // 2)]
    out.sort(key=lambda x: (x[2], x[3]))
    return out + [("lost", 4, -1, -1, 255, [], 0, 7)]


def write_bam(path, reads, small=400):
    """Blocks of a few hundred bytes, records across them; an index of windows."""
    head = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", len(REFS))
    for n, size in REFS:
        head += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size)
    data, begins = head, []
    for name, flag, ref, pos, mapq, cigar, tlen, length in reads:
        r = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(cigar), flag, length, -1, -1, tlen) + name.encode() + b"\0"
        r += b"".join(struct.pack("<I", n << 4 | op) for n, op in cigar) + bytes((length + 1) // 2 + length)
        begins.append(len(data))
        data += struct.pack("<i", len(r)) + r
    out, places = b"", []
    for i in range(0, len(data), small):
        places.append(len(out))
        out += block(data[i : i + small])
    path.write_bytes(out + block(b""))
    virtual = [places[b // small] << 16 | b % small for b in begins]
    index = b"BAI\1" + struct.pack("<i", len(REFS))
    for c in range(len(REFS)):
        windows = [0] * 8
        for v, r in reversed(list(zip(virtual, reads))):
            if r[2] == c:
                windows[min(r[3] >> 14, 7)] = v
        index += struct.pack("<iIiQQ", 1, 0, 1, 1, 2) + struct.pack("<i", 8) + struct.pack("<8Q", *windows)
    (path.parent / (path.name + ".bai")).write_bytes(index)


@pytest.mark.parametrize("indexed_", [True, False])
def test_bam(spark, tmp_path, indexed_):
    reads = plain_reads()
    p = tmp_path / "x.bam"
    write_bam(p, reads)
    if not indexed_:
        (tmp_path / "x.bam.bai").unlink()
    split = p.stat().st_size // 4
    assert (len(bam.cuts(str(p), split)) > 2) == indexed_
    got = [tuple(r) for r in bam.bam(spark, str(p), split).orderBy("file", "block", "line").drop("file", "block", "line").collect()]
    names = {0: "chr1", 1: "chr2", -1: "*"}
    end = lambda x: x[3] + sum(n for n, op in x[5] if op in (0, 2, 7))
    assert got == [(x[0], x[1], names[x[2]], x[3] if x[3] >= 0 else None, end(x) if x[3] >= 0 else None, x[4] if x[4] != 255 else None, x[6], x[7]) for x in reads]
    assert sorted(tuple(r)[1:] for r in bam.sizes(spark, str(tmp_path)).collect()) == REFS


def test_bam_tracks_and_cuts(spark, tmp_path):
    reads = plain_reads()[:-1] + [("edge", 0, 1, 39_990, 60, [(10, 0)], 0, 10)]
    write_bam(tmp_path / "x.bam", reads)
    df, sizes = bam.bam(spark, str(tmp_path)), bam.sizes(spark, str(tmp_path)).select("chr", "size")
    got = {}
    for r in alignments.tracks(df, sizes, ("start", "end", "core"), 2).collect():
        for q in range(r.start, r.end):
            got[r.kind, r.chr, q] = r["count"]
    want = {}
    for _, _, c, pos, _, cigar, _, _ in reads:
        name, size = REFS[c]
        end = pos + sum(n for n, op in cigar if op in (0, 2, 7))
        at = {"start": range(max(1, pos + 1 - 2), pos + 1 + 2 + 1), "end": range(max(1, end - 2), end + 3), "core": range(pos + 1, end)}
        for kind, places in at.items():
            for q in places:
                if q <= size:
                    want[kind, name, q] = want.get((kind, name, q), 0) + 1
    assert got == want
    cuts = sorted(tuple(r) for r in alignments.cut_sites(df).collect())
    assert cuts == sorted((REFS[x[2]][0], s, s + 1) for x in reads for s in [x[3] + sum(n for n, op in x[5] if op in (0, 2, 7)) - 5 if x[1] & 16 else x[3] + 4])


def test_damaged_bam(spark, tmp_path):
    write_bam(tmp_path / "x.bam", plain_reads(40))
    whole = (tmp_path / "x.bam").read_bytes()
    (tmp_path / "x.bam").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="ends inside|damaged|no compressed|decompress"):
        bam.bam(spark, str(tmp_path)).collect()


def runs(n, seed=3, chromosomes=("chr1", "chr10", "chr2")):
    r, out = random.Random(seed), []
    for c in chromosomes:
        at = 1
        for _ in range(n):
            at += r.choice([0, 0, 3, 20])
            end = at + r.randrange(1, 12)
            out.append((c, at, end, r.randrange(1, 9)))
            at = end
    return out


def track_of(spark, rows):
    return spark.createDataFrame(rows, "chr string, start long, end long, count long")


@pytest.mark.parametrize("step", [1, 5])
def test_arrays(spark, tmp_path, step):
    rows, folder = runs(900), f"{tmp_path}/a"
    sizes = spark.createDataFrame([("chr2", 60_000)], "chr string, size long")
    t = track_of(spark, rows)
    arrays.npy(t.withColumn("kind", F.lit("core")).unionByName(t.filter("chr = 'chr1'").withColumn("kind", F.lit("end"))), folder, sizes, step, 1000)
    meta = json.load(open(f"{folder}/npy_meta.json"))
    assert set(meta) == {"chr1", "chr10", "chr2"} and set(meta["chr1"]) == {"core", "end", "stepsize"}
    for c in meta:
        at = {q: n for ch, s, e, n in rows if ch == c for q in range(s, e) if q % step == 0}
        got = np.load(f"{folder}/{c}_core.npy")
        first = meta[c]["core"]
        assert got.dtype == np.uint32 and first == min(at) and got.tolist() == [at.get(first + i * step, 0) for i in range(len(got))]
        assert first + (len(got) - 1) * step == (60_000 if c == "chr2" else max(at))
    back = {(r.kind, r.chr, q * step): r["count"] for r in arrays.npy_tracks(spark, folder, 1000).collect() for q in range(r.start, r.end)}
    assert {k[1:]: v for k, v in back.items() if k[0] == "core"} == {(c, q): n for c, s, e, n in rows for q in range(s, e) if q % step == 0}
    arrays.npy_to_wig(spark, folder, f"{tmp_path}/w")
    seen, at = {}, None
    for p in sorted(glob.glob(f"{tmp_path}/w/core/part-*")):
        for line in open(p):
            if line.startswith("fixedStep"):
                f = dict(x.split("=") for x in line.split()[1:])
                name, at = f["chrom"], int(f["start"])
                assert f["step"] == str(step)
            else:
                seen[name, at] = int(line)
                at += step
    assert seen == {k[1:]: v for k, v in back.items() if k[0] == "core"}


def read_indexed(path):
    """(mark, chromosomes, summary, blocks found through the index) by the published layout."""
    d = open(path, "rb").read()
    mark, version, zooms, tree, data, index, fields, defined, _, summary, raw, _ = struct.unpack_from("<IHHQQQHHQQIQ", d)
    assert version == 4 and zooms == 0 and d[-4:] == struct.pack("<I", mark)
    _, _, key, value, count, _ = struct.unpack_from("<IIIIQQ", d, tree)
    assert value == 8
    chroms = {}

    def names(at):
        leaf, _, n = struct.unpack_from("<BBH", d, at)
        for i in range(n):
            k = at + 4 + i * (key + 8)
            if leaf:
                chroms.update({struct.unpack_from("<I", d, k + key)[0]: (d[k : k + key].rstrip(b"\0").decode(), struct.unpack_from("<I", d, k + key + 4)[0])})
            else:
                names(struct.unpack_from("<Q", d, k + key)[0])

    names(tree + 32)
    assert len(chroms) == count
    found = []

    def places(at, low, high):
        leaf, _, n = struct.unpack_from("<BBH", d, at)
        for i in range(n):
            if leaf:
                c0, s, c1, e, to, size = struct.unpack_from("<IIIIQQ", d, at + 4 + 32 * i)
                found.append((c0, s, e, zlib.decompress(d[to : to + size])))
            else:
                c0, s, c1, e, to = struct.unpack_from("<IIIIQ", d, at + 4 + 24 * i)
            assert low <= (c0, s) and (c1, e) <= high
            if not leaf:
                places(to, (c0, s), (c1, e))

    c0, s, c1, e = struct.unpack_from("<IIII", d, index + 16)
    places(index + 48, (c0, s), (c1, e))
    assert struct.unpack_from("<Q", d, index + 8)[0] == len(found) and all(len(b[3]) <= raw for b in found)
    return mark, chroms, struct.unpack_from("<Qdddd", d, summary), found, struct.unpack_from("<Q", d, data)[0]


@pytest.mark.parametrize("items,node", [(1024, 256), (7, 3)])
def test_bigwig(spark, tmp_path, items, node):
    rows = runs(300, 5, [f"chr{i}" for i in range(1, 8)])
    sizes = spark.createDataFrame([(f"chr{i}", 3000) for i in range(1, 12) if i != 3], "chr string, size long")
    indexed.bigwig(track_of(spark, rows), sizes, f"{tmp_path}/x.bw", items, node)
    mark, chroms, (covered, low, high, total, squares), blocks, n = read_indexed(f"{tmp_path}/x.bw")
    assert mark == 0x888FFC26 and [chroms[i][0] for i in range(10)] == sorted(f"chr{i}" for i in range(1, 12) if i != 3) and n == len(blocks)
    got = []
    for c, s, e, b in blocks:
        chrom, start, end, _, _, kind, _, k = struct.unpack_from("<IIIIIBBH", b)
        assert (chrom, start, end, kind) == (c, s, e, 1) and k <= items
        got += [(chroms[c][0], *struct.unpack_from("<IIf", b, 24 + 12 * i)) for i in range(k)]
    want = [(c, s - 1, min(e - 1, 3000), n) for c, s, e, n in sorted(rows) if c != "chr3" and s - 1 < 3000]
    assert got == want
    assert (covered, low, high) == (sum(e - s for _, s, e, _ in want), min(w[3] for w in want), max(w[3] for w in want))
    assert (total, squares) == (sum((e - s) * v for _, s, e, v in want), sum((e - s) * v * v for _, s, e, v in want))
    indexed.bigwig(track_of(spark, []), sizes, f"{tmp_path}/none.bw")
    assert read_indexed(f"{tmp_path}/none.bw")[3] == []


def test_bigbed(spark, tmp_path):
    r = random.Random(9)
    rows = [(f"chr{r.randrange(1, 4)}", s, s + r.randrange(0, 60), f"n{i}\t{i}") for i in range(500) for s in [r.randrange(900)]]
    sizes = spark.createDataFrame([("chr1", 1000), ("chr2", 920)], "chr string, size long")
    indexed.bigbed(spark.createDataFrame(rows, "chr string, start long, end long, rest string"), sizes, f"{tmp_path}/x.bb", 16, 4)
    mark, chroms, _, blocks, n = read_indexed(f"{tmp_path}/x.bb")
    got = []
    for _, _, _, b in blocks:
        while b:
            c, s, e = struct.unpack_from("<III", b)
            rest, _, b = b[12:].partition(b"\0")
            got.append((chroms[c][0], s, e, rest.decode()))
    size = {"chr1": 1000, "chr2": 920}
    assert mark == 0x8789F2EB and n == len(got)
    assert got == sorted((c, s, min(e, size[c]), x) for c, s, e, x in rows if c in size and s < min(e, size[c]))


def test_combined(spark, tmp_path):
    df = spark.createDataFrame([("c", i, i + 1) for i in range(100)], "chr string, start long, end long")
    for gz in (False, True):
        sinks.bed(df, f"{tmp_path}/p{gz}", gz)
        files.combine(spark, f"{tmp_path}/p{gz}", f"{tmp_path}/all{gz}")
        data = open(f"{tmp_path}/all{gz}", "rb").read()
        assert (gzip.decompress(data) if gz else data).decode() == "".join(f"c\t{i}\t{i + 1}\n" for i in range(100))
    assert readers.kind_of("a/X.BAM") == ("bam", False)
