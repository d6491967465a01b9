"""Quality by a factorisation machine.

Inputs of a document: its words, hashed (log counts, unit length); statistics of
its structure; its length as metadata, all standardised. The score is the
logistic of w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j, the pairs in
linear time as half of sum over factors (sum v x)^2 - sum (v x)^2. It is trained
on a bounded sample of labelled rows (SAMPLE_ROWS, a parameter) with AdaGrad.

Defined cases: a null text is empty and scored like any; labels null or not 0/1
teach nothing; without labels every score is 0.5, with labels of one kind their
smoothed share; rows with a null id are scored and not held out; repeated rows
are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm.common import prepare
from locusflow.llm.labelled import held_out, training_sample

SAMPLE_ROWS, EPOCHS, BATCH, RATE, PENALTY = 8000, 6, 128, 0.08, 1e-5
SLOTS, FACTORS = 1 << 15, 8
STATISTICS = 18
_UPPER, _DIGIT, _LETTER, _ODD = (re.compile(p) for p in (r"[A-ZÀ-ÖØ-Þ]", r"[0-9]", r"[^\W\d_]", r"[^\w\s.,;:'\"!?()-]"))


def statistics(text: str, counts: Counter) -> list[float]:
    """Of the characters, words and lines of a text."""
    n, words, lines = len(text), sum(counts.values()), [x for x in text.split("\n") if x.strip()]
    per, each = max(1, n), max(1, words)
    length = sum(len(w) * c for w, c in counts.items())
    heads = Counter(lines)
    return [
        np.log1p(n), np.log1p(words), np.log1p(len(lines)), length / each, len(counts) / each, max(counts.values(), default=0) / each,
        len(_UPPER.findall(text)) / per, len(_DIGIT.findall(text)) / per, len(_LETTER.findall(text)) / per, len(_ODD.findall(text)) / per,
        text.count("!") / each, text.count("|") / each, text.count(".") / each, text.count(",") / each, 1 - len(heads) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        sum(c for w, c in counts.items() if not w[-1].isalnum()) / each, sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / each,
    ]


def features(text: str) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Hashed word slots, their values (unit length), statistics."""
    counts = Counter(text.split())
    if not counts:
        return np.empty(0, np.int32), np.empty(0, np.float32), statistics(text, counts)
    crc = zlib.crc32
    slots = np.fromiter((crc(w.encode("utf-8", "surrogatepass")) for w in counts), np.int64, len(counts)) % SLOTS
    values = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
    slots, at = np.unique(slots, return_inverse=True)
    values = np.bincount(at, values)
    return slots.astype(np.int32), (values / np.sqrt(values @ values)).astype(np.float32), statistics(text, counts)


@dataclass
class Machine:
    """Slots of words come first, statistics after them."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def rows(self, slots: np.ndarray, values: np.ndarray, stats) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((np.asarray(stats) - self.mean) / self.scale, -5, 5) / np.sqrt(STATISTICS)
        return np.concatenate([slots, SLOTS + np.arange(STATISTICS)]), np.concatenate([values, z])

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[at] * x[:, None]
        total = vx.sum(axis=0)
        return float(self.w0 + self.w[at] @ x + 0.5 * (total @ total - (vx * vx).sum()))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(*self.rows(*features(text))), -35, 35))))


def train(sample: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 11) -> Machine:
    rng = np.random.default_rng(seed)
    size = SLOTS + STATISTICS
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)), np.zeros(STATISTICS), np.ones(STATISTICS))
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    m.w0 = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        m.v[:] = 0
        return m
    stats = np.array([s[2] for s in sample])
    m.mean, m.scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6)
    rows = [m.rows(*s) for s in sample]
    g0, gw, gv = 1e-8, np.full(size, 1e-8), np.full((size, FACTORS), 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), BATCH):
            part = order[start : start + BATCH]
            at, x = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            lengths = np.array([len(rows[i][0]) for i in part])
            first, doc = np.concatenate([[0], np.cumsum(lengths)[:-1]]), np.repeat(np.arange(len(part)), lengths)
            vx = m.v[at] * x[:, None]
            total = np.add.reduceat(vx, first)
            raw = m.w0 + np.add.reduceat(m.w[at] * x, first) + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), first))
            error = (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - y[part]) / len(part)
            ex = error[doc] * x
            slots, to = np.unique(at, return_inverse=True)
            dw = np.bincount(to, ex) + PENALTY * m.w[slots]
            step = ex[:, None] * (total[doc] - vx)
            dv = np.stack([np.bincount(to, step[:, f]) for f in range(FACTORS)], axis=1) + PENALTY * m.v[slots]
            g0 += error.sum() ** 2
            gw[slots] += dw**2
            gv[slots] += dv**2
            m.w0 -= RATE * error.sum() / np.sqrt(g0)
            m.w[slots] -= RATE * dw / np.sqrt(gw[slots])
            m.v[slots] -= RATE * dv / np.sqrt(gv[slots])
    return m


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, parts: int = 3, out: int = 1) -> Machine:
    """Features are made on the executors; the driver gets those of the bounded sample."""
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [features(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "slots": [a.tobytes() for a, _, _ in made], "values": [v.tobytes() for _, v, _ in made], "stats": [s for _, _, s in made]})

    sample = training_sample(docs, labels, "quality", parts, out, rows)
    got = sample.mapInPandas(make, "doc_id long, y int, slots binary, values binary, stats array<double>").toPandas().sort_values(["doc_id", "slots"])
    made = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32), np.asarray(s)) for a, v, s in zip(got["slots"], got["values"], got["stats"])]
    return train(made, got["y"].to_numpy(np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(fit(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, rows))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = shared.value
        for texts in batches:
            yield pd.Series([machine.score(t or "") for t in texts], dtype="float64")

    out = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, 3, 1).alias("held_out"), score(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
