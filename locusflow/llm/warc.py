"""WARC archives with a Zstandard dictionary in a leading skippable frame.

The dictionary is trained on a sample of all records, those with the smallest
hashes of their place in the table, of bounded number and size. Each task writes
archives to the shared folder. The dictionary, itself compressed, stands in a
skippable frame before all others; every record is a frame of its own, compressed
with it, so records can be read one by one. A file gets its name, from the attempt
that wrote it, only when it is whole, and only files in the manifest are read: lost
executors and repeated tasks leave no half or double records. Reading measures and
hashes each payload anew and raises if a header says otherwise.

Records with equal payloads of REVISIT_FROM bytes or more: the one with the
largest page_id is a response, the others are revisits of it without payload, so
their size and digest come from their headers.

Defined cases: null html is an empty payload, null url an empty target; pages
with a null id count below all ids, and if all are null each is a response; rows
that share the largest id are each a response, and revisits name the last of them;
rows that share an id have record ids of their own; very long payloads are one
record; extra columns are ignored; an empty table writes no archive and gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm.common import hash_sample, materialize, prepare, scratch, with_row_key

REVISIT_FROM = 1000
#: The dictionary's size, and its sample: records, and bytes from each.
DICTIONARY_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES = 64 << 10, 1000, 16 << 10
#: An archive that has grown to this is closed and the next one is begun.
ARCHIVE_BYTES, LEVEL = 1 << 30, 3
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
MANIFEST = "archive string, records long, bytes long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def file_system(path: str):
    """(file system, path in it) of a URI of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def record(page_id: int | None, key: str, url: str, payload: bytes, date: str, revisit_of: int | None = None, revisit_key: str | None = None) -> bytes:
    """key: the row's place in its table; revisit_of and revisit_key: of the response that this is a revisit of."""
    revisit = revisit_key is not None
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"" if revisit else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Bytes: {len(payload)}",
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(revisit_key)}", f"X-Refers-To-Page-Id: {revisit_of}"] if revisit else []),
        "Content-Type: application/octet-stream",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """A RECORD row; raises where the record isn't what its header says."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    length = int(fields["Content-Length"])
    payload, digest, size = rest[:length], base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), int(fields["X-Payload-Bytes"])
    if len(payload) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"{fields['WARC-Record-ID']}: the block isn't of {length} bytes")
    if fields["WARC-Type"] == "response":
        read = hashlib.sha1(payload).hexdigest()
        if (read, length) != (digest, size):
            raise ValueError(f"{fields['WARC-Record-ID']}: {length} bytes with digest {read} were read, the header has {size} and {digest}")
        digest, size = read, length
    whole = lambda k: int(fields[k]) if k in fields else None
    return whole("X-Page-Id"), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], whole("X-Refers-To-Page-Id"), payload


def dictionary(samples: list[bytes]) -> bytes:
    """Trained; of too few or too small records, their plain content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


class ArchiveWriter:
    def __init__(self, folder: str, made: bytes):
        self.fs, self.folder = file_system(folder)
        self.base = folder
        self.fs.create_dir(self.folder, recursive=True)
        self.name = f"part-{uuid.uuid4().hex}.warc.zst"
        self.records = self.bytes = 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(made))
        self.out = self.fs.open_output_stream(f"{self.folder}/.{self.name}")
        packed = zstandard.ZstdCompressor(level=19).compress(made)
        self._write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)

    def add(self, data: bytes) -> None:
        self.records += 1
        self._frame(data)

    def _frame(self, data: bytes) -> None:
        self._write(self.compressor.compress(data))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        self.fs.move(f"{self.folder}/.{self.name}", f"{self.folder}/{self.name}")
        return f"{self.base}/{self.name}", self.records, self.bytes


def read_archive(path: str) -> Iterator[bytes]:
    """The records of an archive, in order; at most one record and a read of it are held at once."""
    fs, at = file_system(path)
    with fs.open_input_stream(at) as f:
        data, made = b"", None
        while True:
            while len(data) < 8 and (more := f.read(1 << 15)):
                data += more
            if not data:
                return
            magic, size = struct.unpack_from("<II", data)
            if 0x184D2A50 <= magic <= 0x184D2A5F:
                while len(data) < 8 + size:
                    data += f.read(1 << 15)
                if magic == SKIPPABLE:
                    body = data[8 : 8 + size]
                    if struct.unpack_from("<I", body)[0] == FRAME:
                        body = zstandard.ZstdDecompressor().decompress(body)
                    made = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
                data = data[8 + size :]
                continue
            frame, out = made.decompressobj(), io.BytesIO()
            while True:
                out.write(frame.decompress(data))
                if frame.eof:
                    break
                data = f.read(1 << 15)
                if not data:
                    raise EOFError(f"{path} ends in a record")
            data = frame.unused_data
            yield out.getvalue()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None) -> DataFrame:
    """Writes the pages below folder and returns the manifest. Payloads aren't
    shuffled if few repeat: only digests are grouped. date: of the capture, in
    the form of WARC-Date; the time of writing if None."""
    spark = pages.sparkSession
    prepare(spark)
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    keyed, key = with_row_key(pages)
    place = F.concat_ws(":", *key).alias("key")
    rows = keyed.select(F.col(id_col).cast("long").alias("page_id"), place, F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    sample = rows.select("page_id", "key", "url", F.substring("payload", 1, SAMPLE_BYTES).alias("payload"))
    sample = hash_sample(sample, [F.col("key")], SAMPLE_RECORDS, pages.count()).collect()
    made = spark.sparkContext.broadcast(dictionary([record(r["page_id"], r["key"], r["url"], bytes(r["payload"]), date) for r in sample]))  # of DICTIONARY_BYTES
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    again = rows.filter(F.col("size") >= REVISIT_FROM).groupBy("digest", "size").agg(F.max(F.struct("page_id", "key")).alias("of"), F.count("*").alias("n"))
    again = materialize(again.filter("n > 1 and of.page_id is not null").select("digest", "size", "of"), "repeated")
    rows = rows.join(again, ["digest", "size"], "left").select("page_id", "key", "url", "payload", F.col("of.page_id").alias("of"), F.col("of.key").alias("of_key"))

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer, done = None, []
        for part in parts:
            for page_id, key, url, body, of, of_key in zip(*(part[c] for c in ("page_id", "key", "url", "payload", "of", "of_key"))):
                page_id, of = (None if pd.isna(x) else int(x) for x in (page_id, of))
                writer = writer or ArchiveWriter(folder, made.value)
                revisit = (of, of_key) if of is not None and page_id != of else ()
                writer.add(record(page_id, key, url, bytes(body), date, *revisit))
                if writer.bytes >= ARCHIVE_BYTES:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        yield pd.DataFrame(done, columns=["archive", "records", "bytes"])

    # nullable integers would become doubles in pandas and lose digits
    text = rows.select(F.col("page_id").cast("string").alias("page_id"), "key", "url", "payload", F.col("of").cast("string").alias("of"), "of_key")
    return materialize(text.mapInPandas(write, MANIFEST), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """RECORD rows of the archives of a manifest; payload is null unless asked for."""
    prepare(manifest.sparkSession)

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in RECORD.split(", ")]
        for part in parts:
            for archive in part["archive"]:
                rows, size = [], 0
                for data in read_archive(archive):
                    x = parse(data)
                    rows.append(x if payloads else (*x[:-1], None))
                    size += len(x[-1]) if payloads else 0
                    if len(rows) >= 5000 or size >= 16 << 20:
                        yield _frame(rows, columns)
                        rows, size = [], 0
                yield _frame(rows, columns)

    return manifest.select("archive").repartition(max(1, manifest.count())).mapInPandas(read, RECORD)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns, dtype=object)
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def op4_result(pages: DataFrame) -> DataFrame:
    manifest = write_archives(pages, scratch(pages.sparkSession, "warc"))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
