"""Streams of text: regions, variants and sequences as their lines come in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from locusflow.operators import variants

C = F.col


def _lines(spark: SparkSession, path: str, files_per_batch: int | None) -> DataFrame:
    reader = spark.readStream if files_per_batch is None else spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path)


def bed(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A streaming (chr, start, end, rest) of the BED files that come into a folder.
    Comments, browser and track lines and blank ones are skipped, and lines without two numbers."""
    x = _lines(spark, path, files_per_batch).filter(~C("value").rlike(r"^(browser|track|#|\s*$)")).withColumn("f", F.split("value", "\t", -1))
    field = lambda i: F.get("f", F.lit(i))
    rest = F.when(F.size("f") > 3, F.array_join(F.slice("f", 4, F.size("f")), "\t"))
    x = x.select(field(0).alias("chr"), field(1).try_cast("long").alias("start"), field(2).try_cast("long").alias("end"), rest.alias("rest"))
    return x.filter("start is not null and end is not null")


def vcf(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A streaming (chr, start, name, ref, alt) of VCF files, a row for each ALT that spells bases."""
    x = _lines(spark, path, files_per_batch).filter(~C("value").rlike(r"^(#|\s*$)")).withColumn("f", F.split("value", "\t", 6))
    field = lambda i: F.get("f", F.lit(i))
    pos = field(1).try_cast("long")
    x = x.filter((F.size("f") >= 5) & (pos >= 1)).select(field(0).alias("chr"), (pos - 1).alias("start"), field(2).alias("name"), F.upper(field(3)).alias("ref"), F.explode(F.split(F.upper(field(4)), ",")).alias("alt"))
    return x.filter(~C("alt").startswith("<") & ~C("alt").isin("*", ".", ""))


def identified(stream: DataFrame, pieces: DataFrame, accessions: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mismatch: str = "null") -> StreamingQuery:
    """Starts a query that gives sink the variants.identified() rows (chr, start, ref, alt
    and what it adds) of each batch of a vcf() stream, with the batch's number. A
    batch that is run again after a failure comes with the same number."""

    def step(batch: DataFrame, number: int) -> None:
        v = batch.select(C("chr").alias("name"), "start", "ref", "alt").distinct()
        v = v.withColumn("id", F.struct("name", "start", "ref", "alt"))  # equal rows are one variant
        found = variants.identified(v, pieces, accessions, mismatch)
        sink(found.select(C("id.name").alias("chr"), C("id.start").alias("start"), "id.ref", "id.alt", C("start").alias("from"), C("end").alias("to"), "allele", "vrs_id"), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_HASHED = "stream string, name string, description string, length long, sha512t24u string, md5 string"
_STATE = "head string, parts array<string>"


def _hashed(stream: str, head: str, parts: list[str]) -> tuple:
    import base64

    seq = "".join(parts).upper().encode()
    name, _, description = head.partition(" ")
    return stream, name, description.strip() or None, len(seq), base64.urlsafe_b64encode(hashlib.sha512(seq).digest()[:24]).decode(), hashlib.md5(seq).hexdigest()


def sequence_digests(lines: DataFrame) -> DataFrame:
    """Append-mode (stream, name, description, length, sha512t24u, md5) of a streaming
    (stream, ord, line) of FASTA lines: a record is given when the next begins, or
    at a row whose line is null, which ends the stream. Lines are taken by ord in
    a batch, and batches as they come. The state of a stream is its open record,
    as a digest in progress can't be stored. Raises on bases before a first record."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        head, parts = state.get if state.exists else (None, [])
        parts, out, ended = list(parts), [], False
        for line in pd.concat(list(frames)).sort_values("ord", kind="stable")["line"]:
            last = line is None or line != line
            if last or line.startswith(">"):
                if head is not None:
                    out.append(_hashed(key[0], head, parts))
                head, parts, ended = (None, [], True) if last else (line[1:].strip(), [], False)
            elif bases := "".join(line.split()):
                if head is None:
                    raise ValueError(f"{key[0]}: bases before the first record")
                parts.append(bases)
        if ended:
            state.remove()
        else:
            state.update((head, parts))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _HASHED.split(", ")])

    return lines.groupBy("stream").applyInPandasWithState(step, _HASHED, _STATE, "append", GroupStateTimeout.NoTimeout)
