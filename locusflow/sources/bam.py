"""BAM files: headers, and reads in the columns of readers.sam().

A file with an index (.bai beside it) is read in pieces of about SPLIT_BYTES, cut at
record starts that the index names; one without is read by one task. A task
holds one compressed block and one batch of rows at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.sources.files import listed, located, spread

SPLIT_BYTES = 64 << 20
BATCH = 20_000
_READS = "qname string, flag long, chr string, pos long, end long, mapq long, tlen long, length long, file string, block long, line long"
_SCHEMA = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _READS.split(", ")])
#: CIGAR operations that cover the reference: M, D, N, = and X; fixed values.
_COVERS = {0, 2, 3, 7, 8}


class Blocks:
    """The bytes behind a virtual offset (place of a block, and place in it) of a
    file of gzip blocks. Raises where a block is cut short or its size is wrong."""

    def __init__(self, path: str, offset: int = 0):
        system, inside = located(path)
        self._file = system.open_input_file(inside)
        self._place, self._next, self._data, self._at = 0, offset >> 16, b"", 0
        if offset & 0xFFFF:
            self._load()
            self._at = offset & 0xFFFF

    def __enter__(self) -> Blocks:
        return self

    def __exit__(self, *_) -> None:
        self._file.close()

    def _load(self) -> bool:
        self._file.seek(self._next)
        head = self._file.read(18)
        if not head:
            return False
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError(f"no compressed block at byte {self._next}")
        extra = struct.unpack_from("<H", head, 10)[0]
        fields = head[12:] + self._file.read(max(0, extra - 6))
        size, at = None, 0
        while at + 4 <= extra:
            name, length = fields[at : at + 2], struct.unpack_from("<H", fields, at + 2)[0]
            if name == b"BC":
                size = struct.unpack_from("<H", fields, at + 4)[0] + 1
            at += 4 + length
        if size is None:
            raise ValueError(f"a block without its size at byte {self._next}")
        self._file.seek(self._next + 12 + extra)
        body = self._file.read(size - 12 - extra)
        self._data = zlib.decompress(body[:-8], -15)
        if len(body) < 8 or struct.unpack("<I", body[-4:])[0] != len(self._data):
            raise ValueError(f"a damaged block at byte {self._next}")
        self._place, self._next, self._at = self._next, self._next + size, 0
        return True

    def tell(self) -> int | None:
        """The virtual offset of the next byte; None at the end of the file."""
        while self._at >= len(self._data):
            if not self._load():
                return None
        return self._place << 16 | self._at

    def read(self, n: int) -> bytes:
        out = []
        while n:
            if self._at >= len(self._data) and not self._load():
                raise ValueError("the file ends inside a record")
            piece = self._data[self._at : self._at + n]
            out.append(piece)
            self._at += len(piece)
            n -= len(piece)
        return b"".join(out)

    def number(self) -> int:
        return struct.unpack("<i", self.read(4))[0]


def header(blocks: Blocks) -> list[tuple[str, int]]:
    """(name, length) of the reference sequences; the reads are next."""
    if blocks.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    blocks.read(blocks.number())
    names = []
    for _ in range(blocks.number()):
        name = blocks.read(blocks.number())[:-1].decode()
        names.append((name, blocks.number()))
    return names


def index_starts(data: bytes) -> list[int]:
    """Virtual offsets of record starts that an index names, in order."""
    if data[:4] != b"BAI\1":
        raise ValueError("not a BAM index")
    at, starts = 8, set()
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        (bins,) = struct.unpack_from("<i", data, at)
        at += 4
        for _ in range(bins):
            (chunks,) = struct.unpack_from("<i", data, at + 4)
            at += 8 + 16 * chunks
        (windows,) = struct.unpack_from("<i", data, at)
        starts.update(np.frombuffer(data, "<u8", windows, at + 4).tolist())
        at += 4 + 8 * windows
    return sorted(starts - {0})


def cuts(path: str, split: int) -> list[tuple[int, int | None]]:
    """Pieces (from, to) of a file, in virtual offsets; the last goes on to the end."""
    with Blocks(path) as b:
        header(b)
        first = b.tell()
    if first is None:
        return []
    points = [first]
    for name in (path + ".bai", path.removesuffix(".bam") + ".bai"):
        system, inside = located(name)
        if system.get_file_info(inside).type == fs.FileType.File:
            with system.open_input_stream(inside) as f:
                for s in index_starts(f.read()):
                    if (s >> 16) - (points[-1] >> 16) >= split:
                        points.append(s)
            break
    return list(zip(points, [*points[1:], None]))


def records(path: str, start: int, stop: int | None) -> Iterator[tuple]:
    """Rows of _READS from one virtual offset up to another."""
    with Blocks(path) as b:
        names = [n for n, _ in header(b)]
    with Blocks(path, start) as b:
        while (line := b.tell()) is not None and (stop is None or line < stop):
            r = b.read(b.number())
            ref, pos, name_size, mapq, _, ops, flag, length, _, _, tlen = struct.unpack_from("<iiBBHHHiiii", r)
            cigar = struct.unpack_from(f"<{ops}I", r, 32 + name_size)
            end = pos + sum(c >> 4 for c in cigar if c & 15 in _COVERS)
            placed = pos >= 0
            qname = r[32 : 31 + name_size].decode()
            yield qname, flag, names[ref] if ref >= 0 else "*", pos if placed else None, end if placed else None, mapq if mapq != 255 else None, tlen, length, path, 0, line


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = BATCH) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def sizes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, chr, size) of the headers of BAM files."""
    schema = pa.schema([("file", pa.string()), ("chr", pa.string()), ("size", pa.int64())])

    def rows(batches):
        for p in (p for batch in batches for p in batch.column("path").to_pylist()):
            with Blocks(p) as b:
                yield from ((p, *x) for x in header(b))

    return listed(spark, path, "*.bam").mapInArrow(lambda batches: _batches(rows(batches), schema), "file string, chr string, size long")


def bam(spark: SparkSession, path: str | list[str], split: int = SPLIT_BYTES) -> DataFrame:
    """(qname, flag, chr, pos, end, mapq, tlen, length, file, block, line) as of
    readers.sam(), of a file, a folder or a glob; line is the virtual offset of a
    record, so (file, block, line) is the order of reads."""
    files = listed(spark, path, "*.bam")
    n = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    schema = pa.schema([("path", pa.string()), ("first", pa.int64()), ("last", pa.int64())])

    def pieces(batches):
        for p in (p for batch in batches for p in batch.column("path").to_pylist()):
            yield from ((p, *c) for c in cuts(p, split))

    def read(batches):
        for batch in batches:
            for x in batch.to_pylist():
                yield from records(x["path"], x["first"], x["last"])

    work = spread(files, n[0]).mapInArrow(lambda batches: _batches(pieces(batches), schema), "path string, first long, last long")
    return spread(work, n[0] + n[1] // split).mapInArrow(lambda batches: _batches(read(batches), _SCHEMA), _READS)
