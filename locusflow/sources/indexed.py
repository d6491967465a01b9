"""bigWig and bigBed files: blocks of sorted items, compressed by many tasks, behind
a tree of chromosomes and an index of places. Without zoom levels.

Blocks are cut, compressed and written to the shared folder in parallel; as a
file is one stream, one task then copies them behind the header. It holds an
index entry (32 bytes) a block of ITEMS items.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.plans.scratch import materialize
from locusflow.sources.files import written

C = F.col
ITEMS = 1024
NODE = 256
#: Marks of the formats; fixed values.
WIG_MARK, BED_MARK, TREE_MARK, INDEX_MARK, VERSION = 0x888FFC26, 0x8789F2EB, 0x78CA8C91, 0x2468ACE0, 4
_BLOCK = "chrom long, start long, end long, items long, covered long, low double, high double, total double, squares double, raw long, data binary"


def _levels(count: int, node: int) -> list[int]:
    """Numbers of nodes of a tree with so many items, from the root down."""
    out = [-(-count // node) or 1]
    while out[0] > 1:
        out.insert(0, -(-out[0] // node))
    return out


def _tree(items: list, at: int, node: int, leaf_size: int, inner_size: int, leaf, inner, join) -> bytes:
    """Nodes of a tree whose first byte is at `at`, level by level, all of full size but for a level's last."""
    levels = _levels(len(items), node)
    rows, packed = items, []
    for depth in range(len(levels) - 1, -1, -1):
        groups = [rows[i : i + node] for i in range(0, len(rows), node)] or [[]]
        packed.insert(0, (groups, depth == len(levels) - 1))
        rows = [join(g) for g in groups] if items else []
    starts, place = [], at
    for groups, is_leaf in packed:
        size = 4 + node * (leaf_size if is_leaf else inner_size)
        starts.append([place + i * size for i in range(len(groups))])
        place += size * len(groups)
    out = []
    for depth, (groups, is_leaf) in enumerate(packed):
        child = 0
        for g in groups:
            body = b"".join(leaf(x) for x in g) if is_leaf else b"".join(inner(x, starts[depth + 1][child + k]) for k, x in enumerate(g))
            child += len(g)
            out.append((struct.pack("<BBH", is_leaf, 0, len(g)) + body).ljust(4 + node * (leaf_size if is_leaf else inner_size), b"\0"))
    return b"".join(out)


def chromosome_tree(names: list[tuple[str, int]], at: int, node: int = NODE) -> bytes:
    """names: (chr, size) in order of bytes; a chromosome's number is its place."""
    key = max((len(n.encode()) for n, _ in names), default=1)
    items = [(n.encode().ljust(key, b"\0"), i, size) for i, (n, size) in enumerate(names)]
    head = struct.pack("<IIIIQQ", TREE_MARK, node, key, 8, len(items), 0)
    return head + _tree(items, at + len(head), node, key + 8, key + 8, lambda x: x[0] + struct.pack("<II", x[1], x[2]), lambda x, to: x[0] + struct.pack("<Q", to), lambda g: g[0])


def block_index(blocks: list[tuple[int, int, int, int, int]], at: int, node: int = NODE, per_block: int = ITEMS) -> bytes:
    """blocks: (chromosome, start, end, place, bytes) in the order of the file."""
    items = [(c, s, c, e, place, size) for c, s, e, place, size in blocks]

    def join(g):
        return (*min(x[:2] for x in g), *max(x[2:4] for x in g))

    bounds = join(items) if items else (0, 0, 0, 0)
    end = blocks[-1][3] + blocks[-1][4] if blocks else at
    head = struct.pack("<IIQIIIIQII", INDEX_MARK, node, len(items), *bounds, end, per_block, 0)
    return head + _tree(items, at + len(head), node, 32, 24, lambda x: struct.pack("<IIIIQQ", *x), lambda x, to: struct.pack("<IIIIQ", *x[:4], to), join)


def _cut(frames, pack, most: int):
    """Blocks of at most so many sorted rows of one chromosome; batches may end anywhere."""
    held = None
    for f in frames:
        held = f if held is None else pd.concat([held, f], ignore_index=True)
        edges = np.flatnonzero(np.diff(held["chrom"].to_numpy())) + 1
        out, done = [], 0
        for stop in [*edges, len(held)]:
            whole = stop < len(held)  # rows of the last chromosome may go on in the next batch
            while stop - done >= most or (whole and stop > done):
                n = min(most, stop - done)
                out.append(pack(held.iloc[done : done + n]))
                done += n
        held = held.iloc[done:].reset_index(drop=True)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _BLOCK.split(", ")])
    if held is not None and len(held):
        yield pd.DataFrame([pack(held)], columns=[c.split()[0] for c in _BLOCK.split(", ")])


def _pack_values(x: pd.DataFrame) -> tuple:
    chrom, start, end, v = int(x["chrom"].iloc[0]), x["start"].to_numpy(), x["end"].to_numpy(), x["value"].to_numpy("float64")
    items = np.empty(len(x), [("s", "<u4"), ("e", "<u4"), ("v", "<f4")])
    items["s"], items["e"], items["v"] = start, end, v
    raw = struct.pack("<IIIIIBBH", chrom, start[0], end[-1], 0, 0, 1, 0, len(x)) + items.tobytes()
    w = end - start
    return chrom, start[0], end[-1], len(x), w.sum(), v.min(), v.max(), (v * w).sum(), (v * v * w).sum(), len(raw), zlib.compress(raw)


def _pack_rows(x: pd.DataFrame) -> tuple:
    chrom, start, end = int(x["chrom"].iloc[0]), x["start"].to_numpy(), x["end"].to_numpy()
    raw = b"".join(struct.pack("<III", chrom, s, e) + (r or "").encode() + b"\0" for s, e, r in zip(start, end, x["rest"]))
    return chrom, start[0], end.max(), len(x), (end - start).sum(), 1.0, 1.0, float((end - start).sum()), float((end - start).sum()), len(raw), zlib.compress(raw)


def _save(rows: DataFrame, sizes: DataFrame, path: str, pack, mark: int, fields: int, most: int, node: int) -> None:
    names = sorted(((r["chr"], r["size"]) for r in sizes.select("chr", "size").collect()), key=lambda n: n[0].encode())  # a row a chromosome
    numbers = rows.sparkSession.createDataFrame([(n, i, s) for i, (n, s) in enumerate(names)], "chr string, chrom long, size long")
    x = rows.join(numbers, "chr").withColumn("end", F.least("end", "size")).filter("start < end").drop("chr", "size")
    tied = [c for c in ("rest", "value") if c in x.columns]
    x = x.repartitionByRange("chrom", "start", "end").sortWithinPartitions("chrom", "start", "end", *tied)
    blocks = materialize(x.mapInPandas(lambda f: _cut(f, pack, most), _BLOCK).withColumn("ord", F.monotonically_increasing_id()), "blocks")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    t = blocks.agg(F.count("*").alias("n"), total("items").alias("items"), total("covered").alias("covered"), F.coalesce(F.min("low"), F.lit(0.0)).alias("low"), F.coalesce(F.max("high"), F.lit(0.0)).alias("high"), total("total").alias("total"), total("squares").alias("squares"), F.coalesce(F.max("raw"), F.lit(0)).alias("raw"), total(F.octet_length("data")).alias("bytes")).first()
    summary_at, tree_at = 64, 104
    tree = chromosome_tree(names, tree_at, node)
    data_at = tree_at + len(tree)
    index_at = data_at + 8 + t["bytes"]
    head = struct.pack("<IHHQQQHHQQIQ", mark, VERSION, 0, tree_at, data_at, index_at, fields, min(fields, 3), 0, summary_at, t["raw"], 0)
    head += struct.pack("<Qdddd", t["covered"], t["low"], t["high"], float(t["total"]), float(t["squares"])) + tree + struct.pack("<Q", t["items"] if mark == BED_MARK else t["n"])

    def copy(frames):
        at, index = len(head), []
        with written(path) as out:
            out.write(head)
            for f in frames:
                for r in f[f["ord"] >= 0].itertuples(index=False):
                    out.write(r.data)
                    index.append((r.chrom, r.start, r.end, at, len(r.data)))
                    at += len(r.data)
            if at != index_at:
                raise ValueError(f"{at - len(head)} bytes of blocks, not {index_at - len(head)}")
            out.write(block_index(index, at, node, most) + struct.pack("<I", mark))
        yield pd.DataFrame({"n": [len(index)]})

    # the row before all blocks has the file written where there are none
    none = blocks.sparkSession.createDataFrame([(-1, 0, 0, 0, b"")], "ord long, chrom long, start long, end long, data binary")
    none.unionByName(blocks.select("ord", "chrom", "start", "end", "data")).repartition(1).sortWithinPartitions("ord").mapInPandas(copy, "n long").collect()


def bigwig(track: DataFrame, sizes: DataFrame, path: str, items: int = ITEMS, node: int = NODE) -> None:
    """Runs (chr, start, end, count) of positions from 1 that don't meet, as a bigWig
    file. sizes: (chr, size); what lies outside of them is left out."""
    rows = track.select("chr", (C("start") - 1).alias("start"), (C("end") - 1).alias("end"), C("count").cast("double").alias("value"))
    _save(rows, sizes, path, _pack_values, WIG_MARK, 0, items, node)


def bigbed(regions: DataFrame, sizes: DataFrame, path: str, items: int = ITEMS, node: int = NODE) -> None:
    """Regions (chr, start, end and, where there is one, rest: further fields) as a
    bigBed file. sizes: (chr, size); ends beyond them are cut, regions of other
    chromosomes and empty ones are left out."""
    rest = C("rest") if "rest" in regions.columns else F.lit(None).cast("string")
    rows = regions.select("chr", C("start").cast("long").alias("start"), C("end").cast("long").alias("end"), rest.alias("rest"))
    n = 3
    if "rest" in regions.columns:
        n += regions.agg(F.coalesce(F.max(F.size(F.split("rest", "\t", -1))), F.lit(0))).first()[0]
    _save(rows, sizes, path, _pack_rows, BED_MARK, max(n, 3), items, node)
