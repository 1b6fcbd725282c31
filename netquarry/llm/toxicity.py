"""Toxicity by compression distance: windows are compressed with a toxic and an ordinary zstandard dictionary.

The ordinary dictionary is trained on windows of ordinary texts. The toxic one holds every token of toxic texts that
stands out against ordinary ones (training would leave out rare ones; beyond TOXIC_BYTES those in the fewest texts go),
and continues the ordinary dictionary, so that common wording is compressed alike by both and a window's gain (ordinary
length minus toxic length) comes from toxic wording alone. A text's gains are summed up by their largest, their mean, the mean of the three largest and the share of large ones;
a logistic curve fitted on other rated texts than the dictionaries turns these into a probability, and the threshold
is a point on that calibrated scale.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.llm.shared import free_name, text_of

WINDOW_WORDS = 20
THRESHOLD = 0.3
#: Rated texts of each class that a fit reads at most, those with the smallest hash of the id, and their bytes together.
TOXIC_SAMPLE, ORDINARY_SAMPLE, SAMPLE_BYTES = 1200, 2400, 48_000_000
ORDINARY_BYTES, TOXIC_BYTES = 32768, 32768
#: Windows that the ordinary dictionary is trained on, about: every so many of those of the sampled texts.
TRAINED_WINDOWS = 60_000
GRAM = 5
#: A word or a piece of one stands out if so many toxic texts have it, so many times more often than ordinary texts, and
#: if chance would deal as many of its texts to the toxic ones with this probability at most. No share of the toxic
#: texts is asked for: wording of a language with few of them would never reach it.
LEAST_TEXTS, CONTRAST, CHANCE = 4, 8, 1e-4
LARGE_GAIN = 4
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def windows(text: str) -> list[bytes]:
    words = text.encode().lower().split()
    return [b" " + b" ".join(words[i : i + WINDOW_WORDS]) + b" " for i in range(0, len(words), WINDOW_WORDS)]


def _fragments(token: bytes) -> list[bytes]:
    """A token's words, between spaces, and the pieces of GRAM bytes of the token, which may hold one space."""
    padded = b" " + token + b" "
    return [b" " + w + b" " for w in _WORDS.findall(token)] + [padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1)]


def _shares(texts: list[str], known: dict) -> Counter:
    """How many of the distinct texts hold each fragment."""
    out: Counter = Counter()
    for text in dict.fromkeys(texts):
        found: set[bytes] = set()
        for token in set(text.encode().lower().split()):
            if token not in known:
                known[token] = _fragments(token)
            found.update(known[token])
        out.update(found)
    return out


def _segments(text: str, marked: set[bytes]) -> Iterator[bytes]:
    """The stretches of marked tokens in a text."""
    run: list[bytes] = []
    for token in [*text.encode().lower().split(), b""]:
        if token in marked:
            run.append(token)
        elif run:
            yield b" " + b" ".join(run) + b" "
            run = []


def _tail(least: int, n: int, p: float) -> float:
    """The probability of `least` or more hits among n, each with the probability p, 0 < p < 1."""
    ways = (lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(least, n + 1))
    return sum(map(exp, ways))


def _trained(samples: list[bytes], size: int, k: int) -> bytes:
    """A dictionary trained on samples; where there are too few of them for that, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, level=6, k=k, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(reversed(samples)))[:size]


@dataclass(frozen=True)
class ToxicModel:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray

    def measurer(self) -> callable:
        def compressor(content: bytes) -> callable:
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters.from_level(
                6, min_match=4, write_checksum=0, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
            )
            return zstandard.ZstdCompressor(dict_data=data, compression_params=settings).compress

        plain, toxic = compressor(self.ordinary), compressor(self.toxic + self.ordinary)

        def measure(text: str | None) -> list[float]:
            gains = sorted((len(plain(w)) - len(toxic(w)) for w in windows(text or "")), reverse=True)
            n = len(gains)
            if not n:
                return [1.0, 0.0, 0.0, 0.0, 0.0]
            large = sum(g >= LARGE_GAIN for g in gains)
            return [1.0, gains[0], sum(gains) / n, sum(gains[:3]) / min(n, 3), large / n]

        return measure

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights, -30, 30)))


def dictionaries(toxic: list[str], ordinary: list[str]) -> ToxicModel:
    """The two dictionaries, without a calibration."""
    known: dict = {}
    held, against = _shares(toxic, known), _shares(ordinary, known)
    n_toxic, n_plain = len(set(toxic)), len(set(ordinary))
    chance = cache(lambda c, a: _tail(c, c + a, n_toxic / (n_toxic + n_plain)))
    marks = {
        g
        for g, c in held.items()
        if c >= LEAST_TEXTS
        and CONTRAST * (against[g] + 1) / (n_plain + 1) < c / n_toxic
        and (not n_plain or chance(c, against[g]) <= CHANCE)
    }
    marked = {token for token, pieces in known.items() if not marks.isdisjoint(pieces)}
    plain = [w for text in ordinary for w in windows(text)]
    standing_out = Counter(w for text in dict.fromkeys(toxic) for w in {w for s in _segments(text, marked) for w in s.split()})
    ordered = b" ".join(sorted(standing_out, key=lambda w: (standing_out[w], w)))
    return ToxicModel(
        _trained(plain[:: max(1, len(plain) // TRAINED_WINDOWS)], ORDINARY_BYTES, 64) if plain else b"",
        b" %b " % ordered[-TOXIC_BYTES:] if ordered else b"",
        np.array([-30.0, 0, 0, 0, 0]),
    )


def fit(toxic: list[str], ordinary: list[str], odds: float | None = None) -> ToxicModel:
    """Dictionaries from all texts; the calibration from each half measured by the other half's dictionaries.

    odds: ordinary texts for each toxic one where the scores are to hold; None: as among the texts. With a class
    absent every score is 0.
    """
    model = dictionaries(toxic, ordinary)
    if len(toxic) < 2 or len(ordinary) < 2:
        return model
    x, y = [], []
    for k in (0, 1):
        measure = dictionaries(toxic[k::2], ordinary[k::2]).measurer()
        for texts, label in ((toxic[1 - k :: 2], 1.0), (ordinary[1 - k :: 2], 0.0)):
            x += [measure(text) for text in texts]
            y += [label] * len(texts)
    odds = len(ordinary) / len(toxic) if odds is None else odds
    return ToxicModel(model.ordinary, model.toxic, _logistic(np.array(x), np.array(y), odds))


def _logistic(x: np.ndarray, y: np.ndarray, odds: float) -> np.ndarray:
    # the classes are sampled apart: a weight brings back their balance
    balance = np.where(y == 1, 1.0, odds * y.sum() / max(len(y) - y.sum(), 1))
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[0.05] * (x.shape[1] - 1)])
    for _ in range(40):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (balance * (y - p)) - ridge @ w
        curve = (x * (balance * p * (1 - p))[:, None]).T @ x + ridge
        w = w + np.linalg.solve(curve, slope)
    return w


def _sample(rows: Iterable, most: int) -> list[str]:
    out, size = [], 0
    for row in rows:
        size += len(row["text"].encode())
        if len(out) >= most or size > SAMPLE_BYTES:
            break
        out.append(row["text"])
    return out


def train(spark: SparkSession, docs: DataFrame, rated: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """A model from rated (id, toxic 0 or 1): whole texts of a bounded sample of each class.

    The classes' balance is that of all rated ids. Null ids and ratings are left out; repeated ratings count once, and
    an id rated both ways is in both classes. Null and empty texts add nothing. Rows with the same id are all read,
    within the sample's bound. Without rated rows every score is 0. Other columns play no part.
    """
    slim = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    known = rated.filter(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("rated"), "toxic").distinct()
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    found = {}
    for toxic, most in ((1, TOXIC_SAMPLE), (0, ORDINARY_SAMPLE)):
        chosen = known.filter(F.col("toxic") == toxic).select("rated").orderBy(F.xxhash64("rated"), "rated").limit(most)
        rows = slim.join(F.broadcast(chosen), F.col("id") == F.col("rated")).select("id", "text")
        found[toxic] = _sample(rows.orderBy(F.xxhash64("id"), "id", "text").toLocalIterator(), most)
    return fit(found[1], found[0], sizes.get(0, 0) / sizes[1] if 1 in sizes else None)


def scored(docs: DataFrame, model: ToxicModel, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the probability of being toxic, from the text alone; null and empty texts get the curve's base.

    Whole texts are measured, window by window. Where docs has a column of that name the new one's ends in an
    underscore. Repeated rows score alike; an empty table gives an empty one.
    """
    measure = model.measurer

    @F.pandas_udf("double")
    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready = measure()
        for texts in parts:
            x = np.array([ready(t) for t in texts], dtype=float).reshape(len(texts), 5)
            yield pd.Series(model.probability(x))

    return docs.withColumn(free_name(docs, name)[0], probability(text_of(docs, text_col)))


def held_out(id_: Column) -> Column:
    """Rows that no label may be learnt from: crc32 of the id as text leaves 2 modulo 4; a null id is one of them."""
    return F.coalesce(F.crc32(F.encode(id_.cast("string"), "UTF-8")) % 4 == 2, F.lit(True))
