"""Substring dedup with repeated-phrase automata: words of passages that an earlier document has are removed.

A window of `window` words is represented by the smallest-hashed of its phrases of `gram` words, so equal windows
share a phrase and long texts give few. Phrases that several documents have are candidates; their documents are put
together in blocks of bounded size. The candidates are confirmed by their words, and every block gets an Aho-Corasick
automaton of the confirmed phrases its documents can hold. All its documents stream through it, and every occurrence
is located. The windows that an occurrence represents are read off the text, and those whose words an earlier document
has are removed. Copies of a whole text are settled by a digest before that and need no windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.llm.shared import join_counted, text_of, with_likely, written

WINDOW, GRAM = 50, 8
#: Words of a block's documents, and so of what an automaton is for, on average.
BLOCK_WORDS = 400_000
LAST = (1 << 63) - 1
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_BASE = 0x9E3779B97F4A7C15
_FULL = (1 << 64) - 1


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, 5)
        return found


class Rolling:
    """Hashes of all runs of n words, by differences of a running sum: 64-bit wrapping arithmetic on powers of an odd base."""

    def __init__(self, base: int):
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate((self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))))
            self.down = np.concatenate((self.down, self.down * np.uint64(pow(self.back, k, 1 << 64))))

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        self._powers(len(hashes))
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * self.up[: len(hashes)])))

    def runs(self, sums: np.ndarray, n: int) -> np.ndarray:
        at = len(sums) - n
        return (sums[n:] - sums[:-n]) * self.down[:at] if at > 0 else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """The minimum of every k consecutive values, from minima towards both ends of blocks of k."""
    n = len(x)
    padded = np.concatenate((x, np.full(-n % k, _FULL, dtype=np.uint64))).reshape(-1, k)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - k + 1], ahead[k - 1 : n])


class Words:
    """The hashes of a text's phrases. One per worker: it keeps words' hashes."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram
        self.known, self.rolling = WordHash(), Rolling(_BASE)

    def phrases(self, words: list[bytes]) -> np.ndarray:
        hashes = np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))
        return mixed(self.rolling.runs(self.rolling.sums(hashes), self.gram))

    def chosen(self, phrases: np.ndarray) -> np.ndarray:
        """For each window the hash of the phrase that represents it."""
        return sliding_min(phrases, self.window - self.gram + 1)


def _marks(window: int, gram: int) -> callable:
    """(id, mark, text) to (id, mark, n_words, same, whole, phrases)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Words(window, gram)
        for batch in batches:
            n_words, same, whole, phrases = [], [], [], []
            for text in batch.column(2).to_pylist():
                words = text.encode().split()
                joined = hashlib.sha256(b" ".join(words))
                n_words.append(len(words))
                whole.append(joined.hexdigest())
                same.append(joined.digest()[:16])
                if len(words) < window:
                    phrases.append(None)
                else:
                    phrases.append(np.unique(tool.chosen(tool.phrases(words))).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(same, pa.binary()), pa.array(whole), pa.array(phrases, pa.list_(pa.int64()))],
                names=["id", "mark", "n_words", "same", "whole", "phrases"],
            )

    return run


def _spelled(window: int, gram: int) -> callable:
    """(block, id, text, hits) to (block, id, phrase): the words of every candidate phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Words(window, gram)
        for batch in batches:
            blocks, ids, spelled = [], [], []
            for block, id_, text, hits in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = text.encode().split()
                phrases = tool.phrases(words)
                at = np.flatnonzero(np.isin(phrases, np.array(hits, dtype=np.int64).view(np.uint64)))
                found = {b" ".join(words[i : i + gram]).decode() for i in at}
                spelled += found
                blocks += [block] * len(found)
                ids += [id_] * len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), pa.array(ids, pa.int64()), pa.array(spelled, pa.string())], names=["block", "id", "phrase"]
            )

    return run


_WINDOWS = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("start", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])


def _located(window: int, gram: int) -> callable:
    """A block's documents and its confirmed phrases, to (id, mark, start, h1, h2): the windows that occurrences represent."""

    def run(docs: pa.Table, confirmed: pa.Table) -> pa.Table:
        tool, automaton = Words(window, gram), ahocorasick.Automaton()
        for phrase in confirmed.column("phrase").to_pylist():
            phrase = f" {phrase} ".encode().decode("latin-1")  # a character for each byte, in texts too
            automaton.add_word(phrase, len(phrase))
        if not len(automaton) or not docs.num_rows:
            return _WINDOWS.empty_table()
        automaton.make_automaton()
        parts = []
        for id_, mark, text in zip(*(docs.column(c).to_pylist() for c in ("id", "mark", "text")), strict=True):
            starts, names = _windows(tool, automaton, text.encode().split())
            columns = (np.full(len(starts), id_), np.full(len(starts), mark), starts, names[:, 0], names[:, 1])
            parts.append(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _WINDOWS, strict=True)], schema=_WINDOWS))
        return pa.concat_tables(parts)

    return run


def _windows(tool: Words, automaton: ahocorasick.Automaton, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows start whose representing phrase the automaton finds, and 128 bits of each one's words."""
    joined = b" ".join([b"", *words, b""])
    hits = np.array([last + 1 - length for last, length in automaton.iter(joined.decode("latin-1"))], dtype=np.int64)
    if not len(hits):
        return np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))  # of the space before each word, and of the last one
    phrases = tool.phrases(words)
    found = phrases[np.searchsorted(begins, hits)]
    starts = np.flatnonzero(np.isin(tool.chosen(phrases), found))
    digest = xxhash.xxh3_128_digest
    ends = begins[starts + tool.window]
    names = b"".join([digest(joined[a:b]) for a, b in zip(begins[starts].tolist(), ends.tolist(), strict=True)])
    return starts, np.frombuffer(names, dtype=np.int64).reshape(-1, 2)


def _without(window: int) -> callable:
    """(id, mark, text, starts) to (id, mark, n_removed, kept): the text without the windows that start there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, starts in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                words = text.encode().split()
                cover, at = np.zeros(len(words) + 1, dtype=np.int64), starts.values.to_numpy()
                cover[at] += 1  # starts are distinct
                cover[at + window] -= 1
                drop = np.cumsum(cover)[:-1] > 0
                removed.append(int(drop.sum()))
                rest = b" ".join(w for w, gone in zip(words, drop.tolist(), strict=True) if not gone)
                kept.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "mark", "n_removed", "kept"]
            )

    return run


def _once(spark: SparkSession, slim: DataFrame, marks: DataFrame) -> DataFrame:
    """slim (id, mark, text) with one row of those whose id and text are the same; the others stay where they are."""
    key = F.xxhash64("id", "mark")
    repeated = marks.groupBy(key.alias("key")).count().filter("count > 1").select("key")
    repeated = written(spark, repeated, "phrase-repeated")
    if repeated.isEmpty():
        return slim
    flagged = with_likely(slim.withColumn("key", key), "key", repeated, "doubtful")
    rows = flagged.filter(~F.col("doubtful")).select(*slim.columns)
    return rows.unionByName(flagged.filter("doubtful").groupBy("id", "mark").agg(F.first("text").alias("text")))


def remove_repeats(
    spark: SparkSession,
    docs: DataFrame,
    *,
    window: int = WINDOW,
    gram: int = GRAM,
    block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row (id, n_words, n_removed, kept_sha256) for each row of docs.

    Words end at ASCII white space and are taken unchanged; null and empty texts have none. A word goes if a window
    that covers it also starts in a document with a smaller id; windows are judged on the input. Rows that share an id
    don't remove each other's words. A null id counts as greater than all. Repeated rows give repeated results. An
    empty table gives an empty one; other columns play no part. Windows are told apart by a 128-bit hash of their words.
    """
    slim = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"),
        F.xxhash64(text_of(docs, text_col)).alias("mark"),
        text_of(docs, text_col).alias("text"),
    )
    marks = written(
        spark,
        slim.mapInArrow(_marks(window, gram), "id long, mark long, n_words long, same binary, whole string, phrases array<long>"),
        "phrase-marks",
    )
    firsts = marks.filter(F.col("n_words") >= window).groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    firsts = written(spark, firsts.filter("n > 1"), "phrase-firsts")
    rows = join_counted(marks, firsts, ["same"], "n").withColumn("copy", F.coalesce(F.col("first") < F.col("id"), F.lit(False)))
    # shorter texts have no entry among the firsts: they have no window
    each = rows.filter(~F.col("copy")).select("id", "mark", "n_words", F.explode("phrases").alias("p"))
    each = written(spark, each, "phrase-each")
    several = each.groupBy("p").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).filter("a < b")
    several = written(spark, several.select("p", "n"), "phrase-several")
    hits = join_counted(each, several, ["p"], "n", "inner").groupBy("id", "mark", "n_words").agg(F.collect_set("p").alias("hits"))
    hits = written(spark, hits, "phrase-hits")
    blocks = (hits.agg(F.sum("n_words")).first()[0] or 0) // block_words + 1
    texts = _once(spark, slim, marks).join(hits, ["id", "mark"]).select(
        F.pmod(F.xxhash64("id", "mark"), F.lit(blocks)).alias("block"), "id", "text", "hits", "mark"
    )
    texts = written(spark, texts, "phrase-texts")
    phrases = written(spark, texts.mapInArrow(_spelled(window, gram), "block long, id long, phrase string"), "phrase-found")
    confirmed = phrases.groupBy("phrase").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("phrase")
    here = written(spark, phrases.select("block", "phrase").distinct(), "phrase-blocks")
    confirmed = written(spark, confirmed.join(here.groupBy("phrase").agg(F.count("*").alias("n")), "phrase"), "phrase-confirmed")
    here = join_counted(here, confirmed, ["phrase"], "n", "inner").select("block", "phrase")
    located = (
        texts.select("block", "id", "mark", "text")
        .groupBy("block")
        .cogroup(here.groupBy("block"))
        .applyInArrow(_located(window, gram), "id long, mark long, start int, h1 long, h2 long")
    )
    located = written(spark, located, "phrase-windows")
    recurring = located.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("id").alias("b"), F.count("*").alias("n"))
    recurring = written(spark, recurring.filter("least < b").select("h1", "h2", "least", "n"), "phrase-recurring")
    gone = join_counted(located, recurring, ["h1", "h2"], "n", "inner").filter("least < id")
    gone = gone.groupBy("id", "mark").agg(F.collect_set("start").alias("starts"))
    removed = texts.select("id", "mark", "text").join(gone, ["id", "mark"]).select("id", "mark", "text", "starts")
    removed = removed.mapInArrow(_without(window), "id long, mark long, n_removed long, kept string")
    removed = written(spark, removed.distinct(), "phrase-removed")
    out = rows.select("id", "mark", "n_words", "whole", "copy").join(removed, ["id", "mark"], "left")
    return out.select(
        F.when(F.col("id") != LAST, F.col("id")).alias(id_col),
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"),
    )
