"""Binary files read and written in ranges, by any path that pyarrow.fs knows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COPY_BYTES = 1 << 22


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; plain paths are local."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


@contextmanager
def written(path: str) -> Iterator[BinaryIO]:
    """A stream whose bytes appear at path when it ends well: a task that is run twice, or lost, leaves no half file."""
    system, inside = located(path)
    folder = inside.rpartition("/")[0]
    system.create_dir(folder, recursive=True)
    draft = f"{folder}/.{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(draft) as out:
            yield out
        system.move(draft, inside)
    except BaseException:
        if system.get_file_info(draft).type == fs.FileType.File:
            system.delete_file(draft)
        raise


def listed(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """(path, length) of the files at path, a folder or a glob; their bytes aren't read."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length")


def spread(rows: DataFrame, parts: int) -> DataFrame:
    """rows, a row a piece of work, over so many tasks; a number that is asked for isn't coalesced."""
    return rows.repartition(max(1, parts))


def combine(spark: SparkSession, folder: str, path: str) -> None:
    """The part files of a folder as one file, in the order of their names. One task
    copies the bytes in blocks; gzip parts stay one valid gzip file."""

    def copy(frames):
        for f in frames:
            for names in f["names"]:
                with written(path) as out:
                    for name in names:
                        system, inside = located(name)
                        with system.open_input_file(inside) as part:  # its bytes as they are, compressed or not
                            while block := part.read(COPY_BYTES):
                                out.write(block)
            yield f.assign(n=f["names"].map(len))[["n"]]

    names = listed(spark, folder, "part-*").agg(F.sort_array(F.collect_list("path")).alias("names"))  # one name a part file
    names.mapInPandas(copy, "n long").collect()
