"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= j) = sigmoid(threshold_j - score): one score, a sum of hashed-text weights shared by all grades, and
ordered thresholds. The score gives the expected grade and the probability of reaching a grade, by which documents
are selected. Features are the words of a text and their shapes (letters by case, digits, symbols), hashed, and the
repetition of a word right after itself; each counts by its share of the text's words, so length plays no part.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.llm.shared import free_name, text_of

DIMS = 1 << 15
#: Rated documents that a fit uses at most, those with the smallest hash of the id.
SAMPLE = 6000
SCALE = 8.0
#: Words whose features a task remembers.
KNOWN = 1 << 16
_SHAPES = [(re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0")]


def slots(word: bytes) -> tuple[int, int]:
    """The two features of a word: itself in lower case, and its shape with runs of a class as one."""
    shape = word
    for pattern, sign in _SHAPES:
        shape = pattern.sub(sign, shape)
    return xxhash.xxh64_intdigest(word.lower(), 1) % DIMS, xxhash.xxh64_intdigest(shape[:12], 2) % DIMS


#: The feature of a word that repeats the one before it.
REPEAT = xxhash.xxh64_intdigest(b"the word before", 3) % DIMS


def repeats(words: list[bytes]) -> int:
    return sum(map(operator.eq, words, words[1:]))


class _Slots(dict):
    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = found = slots(word)
        return found


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2 ..., a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))

    def scorer(self) -> callable:
        weights = self.weights

        class Weighed(dict):
            def __missing__(self, word: bytes) -> float:
                if len(self) >= KNOWN:
                    self.clear()
                a, b = slots(word)
                self[word] = found = float(weights[a] + weights[b])
                return found

        table = Weighed()

        def score(text: str | None) -> float:
            words = (text or "").encode().split()
            if not words:
                return 0.0
            return SCALE * (sum(map(table.__getitem__, words)) + weights[REPEAT] * repeats(words)) / len(words)

        return score


def fit_ordinal(
    doc: np.ndarray, slot: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, steps: int = 250, decay: float = 1e-4
) -> OrdinalModel:
    """Adam on the mean log likelihood. (doc, slot, value): the sparse features; grade: 0 ... grades - 1 per document.

    Thresholds are a first one and positive gaps, so they stay ordered. With one grade or no document, weights are 0
    and every document gets the middle of the scale.
    """
    n, w = len(grade), np.zeros(DIMS)
    cuts = np.zeros(grades - 1)
    if not n or len(np.unique(grade)) < 2:
        return OrdinalModel(w, np.arange(grades - 1, dtype=float))
    m, v = np.zeros(DIMS + grades - 1), np.zeros(DIMS + grades - 1)
    for t in range(1, steps + 1):
        _, by_w, by_cuts = loss_and_slopes(w, cuts, doc, slot, value, grade, decay)
        g = np.concatenate((by_w, by_cuts))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, cuts = w - step[:DIMS], cuts - step[DIMS:]
    return OrdinalModel(w, ordered(cuts))


def ordered(cuts: np.ndarray) -> np.ndarray:
    """Thresholds from the first one and the logarithms of the gaps."""
    return cuts[0] + np.concatenate(([0.0], np.cumsum(np.exp(cuts[1:]))))


def loss_and_slopes(
    w: np.ndarray, cuts: np.ndarray, doc: np.ndarray, slot: np.ndarray, value: np.ndarray, grade: np.ndarray, decay: float
) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean negative log likelihood with decay / 2 x |w|^2, and its slopes by the weights and by cuts."""
    n, grades, rows = len(grade), len(cuts) + 1, np.arange(len(grade))
    score = np.bincount(doc, weights=value * w[slot], minlength=n)
    below = 1 / (1 + np.exp(np.clip(score[:, None] - ordered(cuts)[None, :], -50, 50)))  # P(grade <= j)
    full = np.concatenate((np.zeros((n, 1)), below, np.ones((n, 1))), axis=1)
    slope = full * (1 - full)
    p = np.maximum(full[rows, grade + 1] - full[rows, grade], 1e-12)
    up, down = slope[rows, grade + 1] / p, slope[rows, grade] / p
    by_score = (up - down) / n  # the loss grows as the score passes the grade's interval
    by_theta = np.zeros(grades - 1)
    inner = grade < grades - 1
    by_theta += np.bincount(grade[inner], weights=-up[inner], minlength=grades - 1) / n
    inner = grade > 0
    by_theta += np.bincount(grade[inner] - 1, weights=down[inner], minlength=grades - 1) / n
    tails = np.cumsum(by_theta[::-1])[::-1]
    by_cuts = np.concatenate(([tails[0]], tails[1:] * np.exp(cuts[1:])))
    by_w = np.bincount(slot, weights=value * by_score[doc], minlength=len(w)) + decay * w
    return float(-np.log(p).mean() + decay / 2 * (w @ w)), by_w, by_cuts


def train(
    spark: SparkSession, docs: DataFrame, rated: DataFrame, grades: int, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"
) -> OrdinalModel:
    """A model from rated (id, grade), a bounded sample of them; their features are made on the executors.

    Null ids, null grades and grades beyond 0 ... grades - 1 are left out; of several grades of one id the lowest
    counts, of several texts of one id one that a hash picks, so at most `sample` rows come to the driver. Null and
    empty texts have no features; long ones count whole, by the shares of their words. Without rated rows, or with
    one grade only, the weights are 0. Other columns play no part.
    """
    chosen = (
        rated.filter(F.col("grade").between(0, grades - 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min("grade").cast("int").alias("grade"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )
    slim = docs.select(docs[id_col].alias("_doc"), text_of(docs, text_col).alias("text"))
    picked = slim.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select(
        "text", F.col("_id").cast("string").alias("id"), "grade", F.xxhash64("text").alias("mark")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Slots()
        for batch in batches:
            slot, value = [], []
            for text in batch.column(0).to_pylist():
                words = text.encode().split()
                found = [s for w in words for s in known[w]] + [REPEAT] * repeats(words)
                at, count = np.unique(np.array(found, dtype=np.int64), return_counts=True)
                slot.append(at.astype(np.int32))
                value.append((SCALE * count / max(len(words), 1)).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(slot, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))],
                names=["id", "grade", "mark", "slot", "value"],
            )

    features = picked.mapInArrow(run, "id string, grade int, mark long, slot array<int>, value array<float>")
    once = features.groupBy("id").agg(F.min_by(F.struct("grade", "slot", "value"), "mark").alias("f"))
    got = once.orderBy("id").select("f.*").toArrow().combine_chunks()  # at most `sample` rows
    column = lambda name: got.column(name).combine_chunks()
    sizes = pc.list_value_length(column("slot")).to_numpy(zero_copy_only=False)
    flat = lambda name: column(name).flatten().to_numpy(zero_copy_only=False)
    grade = column("grade").to_numpy(zero_copy_only=False).astype(np.int64)
    return fit_ordinal(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), flat("slot"), flat("value"), grade, grades)


def graded(docs: DataFrame, model: OrdinalModel, *, text_col: str = "text", name: str = "graded") -> DataFrame:
    """docs with a struct column (expected, tail): the expected grade and P(grade >= 1), from the text alone.

    Null and empty texts score 0. Where docs has a column of that name the new one's ends in an underscore. Repeated
    rows are graded alike; an empty table gives an empty one.
    """
    score = model.scorer()

    @F.pandas_udf("expected double, tail double")
    def marks(texts: pd.Series) -> pd.DataFrame:
        tails = model.tails(np.array([score(t) for t in texts], dtype=float))
        return pd.DataFrame({"expected": tails.sum(axis=1), "tail": tails[:, 0]})

    return docs.withColumn(free_name(docs, name)[0], marks(text_of(docs, text_col)))


def quality_grades(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Grades from the two ratings: 0 poor, 1 good but toxic, 2 good. A missing toxic rating counts as not toxic."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.filter("quality is not null").select(id_col, grade.alias("grade"))
