"""Operator 3, quality classifier: ordinal cumulative-link regression on graded ratings.

One vector of weights over hashed words is shared by all grades; ordered thresholds cut its score: P(grade >= k) = sigmoid(score - threshold_k). It is
fitted by full-gradient descent (Adam) in numpy on the driver, over a bounded sample of rated rows: the ``sample_rows`` with the smallest hashes of ids. A word counts once for a text, so a single
word can decide about a long text, and only buckets have a weight whose texts are graded differently from the rest beyond chance.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, only, spread

_MARKS = re.compile(rb"[!-/:-@\[-`{-~]{2,}|[|$%&*#]")


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = b = zlib.crc32(word)
        return b


_seen = _Buckets()


def features(text: bytes, buckets: int) -> np.ndarray:
    """Sorted hash buckets of a text: its words, its runs of marks, and in steps how much of it is in capitals or marks, how long it is and how often a word repeats the one before."""
    letters = text.translate(None, bytes(set(range(128)) - set(range(65, 91)) - set(range(97, 123))))
    upper = len(letters.translate(None, bytes(range(97, 123)) + bytes(range(128, 256))))
    marks = _MARKS.findall(text)
    n, run = max(1, len(text)), text.translate(LOWER).translate(_WORD).split()
    again = sum(map(eq, run, run[1:])) / max(1, len(run))
    shape = [b"\0c%d" % int(10 * upper / max(1, len(letters))), b"\0m%d" % int(np.log2(1 + 1000 * len(marks) / n)), b"\0l%d" % n.bit_length(), b"\0r%d" % int(np.log2(1 + 100 * again))]
    words = {*run, *marks, *shape}
    return np.unique(np.fromiter(map(_seen.__getitem__, words), np.int64, len(words)) & (buckets - 1))


_WORD = bytes(c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def tails(self, at: list[np.ndarray]) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... for each text's buckets."""
        score = np.array([self.weights[a].sum() for a in at], np.float64).reshape(-1, 1)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score, -50, 50)))


def fit(at: list[np.ndarray], grades: np.ndarray, n_grades: int, buckets: int, steps: int = 300, rate: float = 0.05, ridge: float = 2e-4, least_rows: int = 5, least_z: float = 4.5) -> OrdinalModel:
    """Without rated rows all weights are 0 and every grade is as likely as the next."""
    cuts = np.arange(n_grades - 1, dtype=np.float64) - (n_grades - 2) / 2
    weights = np.zeros(buckets, np.float64)
    if not at:
        return OrdinalModel(weights.astype(np.float32), cuts)
    # only buckets whose texts' grades differ from the others' beyond chance, of words that enough texts share
    many = np.bincount(np.concatenate(at), minlength=buckets)
    away = np.repeat(grades - grades.mean(), [len(a) for a in at])
    z = np.abs(np.bincount(np.concatenate(at), away, buckets)) / (np.sqrt(np.maximum(many * (1 - many / len(at)), 1e-9)) * max(float(grades.std()), 1e-9))
    used = np.flatnonzero((many >= least_rows) & (z >= least_z))
    number = np.full(buckets, -1, np.int64)
    number[used] = np.arange(len(used))
    cols = [number[a][number[a] >= 0] for a in at]
    row = np.repeat(np.arange(len(at)), [len(c) for c in cols])
    col = np.concatenate(cols)
    above = (grades[:, None] >= np.arange(1, n_grades)[None, :]).astype(np.float64)
    # thresholds as a first one and positive steps, so that they stay in order
    free = np.concatenate([np.zeros(len(used)), [cuts[0]], np.zeros(n_grades - 2)])
    m, v = np.zeros_like(free), np.zeros_like(free)
    for t in range(1, steps + 1):
        w, first, gaps = free[: len(used)], free[len(used)], np.exp(free[len(used) + 1 :])
        limit = first + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(row, w[col], len(at)) if len(col) else np.zeros(len(at))
        off = 1 / (1 + np.exp(np.clip(limit[None, :] - score[:, None], -50, 50))) - above  # of each cumulative logit
        gw = np.bincount(col, off.sum(1)[row], len(used)) / len(at) + ridge * w
        gl = -off.mean(0)
        g = np.concatenate([gw, [gl.sum()], np.cumsum(gl[::-1])[::-1][1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        free = free - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights[used] = free[: len(used)]
    limit = free[len(used)] + np.concatenate([[0], np.cumsum(np.exp(free[len(used) + 1 :]))])
    return OrdinalModel(weights.astype(np.float32), limit)


def fit_quality_model(docs: DataFrame, ratings: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample_rows: int = 8000, buckets: int = 1 << 20) -> OrdinalModel:
    """Learns from documents with a text and a grade from 0 to ``n_grades`` - 1; others take no part.

    ``sample_rows`` bounds the ratings that are used, those with the smallest hashes of their ids: so many go to the documents by broadcast, and what comes back to the driver is as many texts' buckets.
    """
    rated = only(ratings, id=id_col, grade=grade_col).where(F.col("id").isNotNull() & F.col("grade").between(0, n_grades - 1)).distinct()
    sample = rated.orderBy(F.xxhash64("id"), "id", "grade").limit(sample_rows)
    d = only(docs, of=id_col, text=text_col).where(F.col("text").isNotNull()).join(F.broadcast(sample), F.col("of") == F.col("id"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([features(t.as_py(), buckets).astype("<i4").tobytes() for t in batch.column(0).cast(pa.binary())], pa.binary())], names=["grade", "at"])

    found = d.select("text", F.col("grade").cast("int")).mapInArrow(find, "grade int, at binary").distinct().toArrow()
    found = found.sort_by([("grade", "ascending"), ("at", "ascending")])
    return fit([np.frombuffer(a, "<i4").astype(np.int64) for a in found["at"].to_pylist()], found["grade"].to_numpy(), n_grades, buckets)


def grade_documents(docs: DataFrame, model: OrdinalModel, select_from: int, least_tail: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail_prob (of ``select_from`` or a higher grade) and kept (tail_prob at least ``least_tail``) of each row, from its whole text.

    A null or empty text has no words and gets what the thresholds and its length give. A null id stays null, repeated rows get equal answers, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            at = [features(t.as_py() or b"", len(m.weights)) for t in batch.column(1).cast(pa.binary())]
            tails = m.tails(at)
            tail = tails[:, select_from - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(1)), pa.array(tail.copy()), pa.array(tail >= least_tail)], names=["doc_id", "expected_grade", "tail_prob", "kept"])

    return spread(only(docs, doc_id=id_col, text=text_col)).mapInArrow(grade, "doc_id long, expected_grade double, tail_prob double, kept boolean")
