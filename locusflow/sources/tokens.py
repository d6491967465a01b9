"""Token files: a mark, a byte for the width of a token, little-endian tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

#: Fixed values of the format.
MARK, NARROW, WIDE = b"GTOK", 1, 2


def encode(tokens: np.ndarray) -> bytes:
    narrow = not len(tokens) or int(tokens.max()) <= 0xFFFF
    return MARK + bytes([NARROW if narrow else WIDE]) + tokens.astype("<u2" if narrow else "<u4").tobytes()


def decode(data: bytes) -> np.ndarray:
    if data[:4] != MARK or len(data) < 5 or data[4] not in (NARROW, WIDE):
        raise ValueError("not a token file")
    return np.frombuffer(data, "<u2" if data[4] == NARROW else "<u4", offset=5).astype(np.int64)


def append(data: bytes, tokens: np.ndarray) -> bytes:
    """The file with more tokens, which must fit its width."""
    held = decode(data)
    if data[4] == NARROW and len(tokens) and int(tokens.max()) > 0xFFFF:
        raise ValueError("the file holds tokens of two bytes")
    return data[:5] + np.concatenate([held, tokens]).astype("<u2" if data[4] == NARROW else "<u4").tobytes()


@F.pandas_udf(BinaryType())
def encoded(tokens: pd.Series) -> pd.Series:
    """Arrays of tokens as the content of token files; null stays null."""
    return tokens.map(lambda t: None if t is None else encode(np.asarray(t, np.int64)))


@F.pandas_udf(ArrayType(LongType()))
def decoded(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else decode(bytes(c)).tolist())


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, tokens) of token files below a path or glob."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), decoded("content").alias("tokens"))
