"""Quality classifier: a factorisation machine over hashed words, token shapes and structure statistics (operator 1).

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise interactions of
the features in time linear in their number.  Features of a whole text: its words hashed, the shapes of its words
hashed (letters, digits and case folded to classes), and statistics of its structure (length, lines, repeated lines
and words, shares of upper case, digits and symbols).  Nothing but the text is an input.

The model is fitted on at most `sample` labelled rows, those with the smallest hash of their id; every document is
scored.  The fit runs on the driver over that bounded sample, and the weights (BINS x (1 + RANK) floats, 2.4 MB
whatever the corpus) travel to the tasks.

Edge cases: a null text scores as an empty one; empty texts get a score; a label that is null is not learnt from; if
there is no label to learn from, every score is 0.5; repeated rows give repeated rows; an empty table gives an empty
table; other columns are carried or ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunkcache import ChunkCache

WORDS, SHAPES, RANK = 1 << 15, 1 << 12, 8
STATISTICS = 10
BINS = WORDS + SHAPES + STATISTICS
_RUNS = re.compile(r"(.)\1+")
_PACK = struct.Struct("<6i").pack


def _token(token: str) -> bytes:
    shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token)
    upper, digit, letters = shape.count("A"), shape.count("0"), shape.count("A") + shape.count("a")
    shape = _RUNS.sub(r"\1", shape)
    return _PACK(zlib.crc32(token.lower().encode("utf-8", "replace")) % WORDS, WORDS + zlib.crc32(shape.encode("utf-8", "replace")) % SHAPES, upper, digit, len(token) - letters - digit, len(token))


@lru_cache(maxsize=1)
def _tokens() -> ChunkCache:
    return ChunkCache(lambda tokens: list(map(_token, tokens)), 250_000)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (distinct) and their values."""
    text = text or ""
    tokens = text.split()
    n = len(tokens)
    rows = np.frombuffer(b"".join(_tokens().get(tokens)), "<i4").reshape(-1, 6)
    parts, values = [], []
    repeated = 0.0
    for k in (0, 1):
        found, counts = np.unique(rows[:, k], return_counts=True)
        if n:
            norm = np.sqrt(counts / n)
            values.append(norm / np.sqrt(len(found)) if k == 0 else norm)
        parts.append(found)
        if k == 0 and n:
            repeated = 1 - len(found) / n
    upper, digit, other, chars = (float(x) for x in rows[:, 2:].sum(0))
    lines = text.split("\n")
    chars = max(chars, 1.0)
    stats = np.array([np.log1p(len(text)) / 10, np.log1p(len(lines)) / 5, 1 - len(set(lines)) / len(lines), repeated, upper / chars, digit / chars, other / chars, chars / max(n, 1) / 10, float(n == 0), float(n < 8)])
    return np.concatenate([*parts, np.arange(WORDS + SHAPES, BINS)]).astype(np.int64), np.concatenate([*values, stats])


class FactorisationMachine:
    def __init__(self) -> None:
        self.w0, self.w, self.v = 0.0, np.zeros(BINS), np.zeros((BINS, RANK))

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.v[at] * x[:, None]
        s = v.sum(0)
        return float(self.w0 + self.w[at] @ x + 0.5 * (s @ s - np.square(v).sum()))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(*features(text)), -30, 30))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.08, decay: float = 2e-5, seed: int = 7) -> FactorisationMachine:
        """AdaGrad on the logistic loss, one row at a time in an order fixed by the seed."""
        if not len(rows):
            return self
        rng = np.random.default_rng(seed)
        self.v = rng.normal(0, 0.02, (BINS, RANK))
        p = np.clip(labels.mean(), 0.02, 0.98)
        self.w0 = float(np.log(p / (1 - p)))
        g0, gw, gv = 1.0, np.full(BINS, 0.1), np.full((BINS, RANK), 0.1)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                at, x = rows[i]
                vx = self.v[at] * x[:, None]
                s = vx.sum(0)
                raw = self.w0 + self.w[at] @ x + 0.5 * (s @ s - np.square(vx).sum())
                d = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[i]
                if abs(d) < 1e-3:
                    continue
                dw = d * x + decay * self.w[at]
                dv = d * x[:, None] * (s - vx) + decay * self.v[at]
                gw[at] += dw * dw
                gv[at] += dv * dv
                g0 += d * d
                self.w[at] -= rate * dw / np.sqrt(gw[at])
                self.v[at] -= rate * 0.5 * dv / np.sqrt(gv[at])
                self.w0 -= rate * d / np.sqrt(g0)
        return self


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> FactorisationMachine:
    """A machine fitted on at most `sample` labelled rows whose id is not held out."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `sample` ids at most are broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality").cast(pa.int32()), pa.array([a.astype("<i4").tobytes() for a, _ in got], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in got], pa.binary())], names=["doc_id", "quality", "at", "x"])

    rows = texts.mapInArrow(run, "doc_id long, quality int, at binary, x binary").dropDuplicates(["doc_id"]).collect()  # `sample` rows at most
    rows.sort(key=lambda r: r.doc_id)
    got = [(np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["x"], "<f4").astype(np.float64)) for r in rows]
    if not rows:
        return FactorisationMachine()
    return FactorisationMachine().fit(got, np.array([float(r["quality"] > 0) for r in rows]))


def score(docs: DataFrame, machine: FactorisationMachine, threshold: float = 0.3, text: str = "text", out: tuple[str, str] = ("quality_score", "quality_pred")) -> DataFrame:
    """docs with a score (0 to 1) and a prediction (1 if the score reaches the threshold), named by `out`."""
    model = (machine.w0, machine.w.astype(np.float32), machine.v.astype(np.float32))
    at = docs.columns.index(text)
    schema = docs.select("*", F.lit(0.0).alias(out[0]), F.lit(0).alias(out[1])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = FactorisationMachine()
        m.w0, m.w, m.v = model[0], model[1].astype(np.float64), model[2].astype(np.float64)
        for b in batches:
            scores = [m.score(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=schema.names)

    return docs.mapInArrow(run, schema)


def op1_quality_fm(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole document."""
    from .common import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fit(docs, read(spark, sf_dir, "labels"))
    scored = score(docs, machine)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_pred").alias("predicted"))
