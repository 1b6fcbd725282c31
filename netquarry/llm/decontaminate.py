"""Benchmark decontamination: pigeonhole pieces find candidates, Myers' bit-parallel distance verifies them.

A test item of m characters may appear with k = floor(rate x m) edits. Split into k + 1 pieces, at least one of them
appears unchanged, at a known offset; so every exact piece hit gives a window of the text to verify, and no item
within its budget is missed. Split into 2(k + 1) halves, at least k + 2 of them stay unchanged: windows that hold
fewer are passed over before the distance is computed, which loses none either. Texts and items are compared in lower case with white space collapsed to single spaces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.llm.shared import text_of, written

#: Edits allowed for each character of an item.
RATE = 0.1
#: Characters of items in one automaton, and so in one broadcast (and one item more at most); a larger benchmark is
#: searched for in several passes over the documents.
BLOCK_CHARS = 4_000_000


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item in budget + 1 pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """One item for Myers' algorithm: the shortest edit distance to any substring of a text."""

    def __init__(self, item: str):
        self.item, self.m = item, len(item)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def search(self, text: str) -> tuple[int, int]:
        """(distance, end) of the nearest substring, the first such end."""
        at = text.find(self.item)
        if at >= 0:
            return 0, at + self.m
        full, top = (1 << self.m) - 1, 1 << self.m - 1
        up, down, score, best, end = full, 0, self.m, self.m, 0
        masks = self.masks
        for i, c in enumerate(text, 1):
            eq = masks.get(c, 0)
            vertical = eq | down
            horizontal = (((eq & up) + up) ^ up) | eq
            plus = down | (full & ~(horizontal | up))
            minus = up & horizontal
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
                if score < best:
                    best, end = score, i
            plus, minus = plus << 1 & full, minus << 1 & full
            up = minus | (full & ~(vertical | plus))
            down = plus & vertical
        return best, end


def _enough(halves: list[str], window: str, budget: int) -> bool:
    missing = 0
    for half in halves:
        if half not in window:
            missing += 1
            if missing > budget:
                return False
    return True


class Matcher:
    """Items (id, text) ready to be looked for."""

    def __init__(self, items: Iterable[tuple[int, str]], rate: float = RATE):
        self.items, by_piece = [], {}
        for number, text in items:
            item = plain(text)
            if item:
                budget = int(rate * len(item))
                for offset, piece in pieces(item, budget):
                    by_piece.setdefault(piece, []).append((len(self.items), offset))
                halves = [half for _, half in pieces(item, 2 * budget + 1)]
                self.items.append((number, budget, halves, Pattern(item), Pattern(item[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, where in by_piece.items():
            self.automaton.add_word(piece, (len(piece), where))
        if by_piece:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of the best match of every item that is within its budget."""
        doc = plain(text)
        if not self.items or not doc:
            return []
        starts: dict[int, list[int]] = {}
        for last, (length, where) in self.automaton.iter(doc):
            for k, offset in where:
                starts.setdefault(k, []).append(last + 1 - length - offset)
        out = []
        for k, found in starts.items():
            number, budget, halves, forward, backward = self.items[k]
            best = None
            found.sort()
            low = found[0]
            for i, start in enumerate(found):
                if i + 1 < len(found) and found[i + 1] - start <= budget:
                    continue  # hits on neighbouring diagonals are verified together
                begin, stop = max(0, low - budget), start + forward.m + budget
                window = doc[begin:stop]
                if _enough(halves, window, budget):
                    d, end = forward.search(window)
                    if d <= budget and (best is None or d < best[0]):
                        back = backward.search(window[:end][::-1])[1]
                        best = (d, begin + end - back, begin + end)
                low = found[i + 1] if i + 1 < len(found) else 0
            if best:
                out.append((number, *best))
        return sorted(out)


def matches(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    *,
    rate: float = RATE,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Rows (id, item_id, distance, match_start, match_end): each document and each item it contains, at its best place.

    Places are code points of the document in lower case with collapsed white space. Items are read in blocks of
    block_chars characters, each block one pass over the documents, so no automaton grows with the benchmark. Null and
    empty items are ignored; null and empty texts match nothing. Repeated documents and repeated items each give their
    own rows. Empty tables give an empty one; other columns play no part.
    """
    slim = docs.select(F.col(id_col).alias("id"), text_of(docs, text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    found = None
    for block in _blocks(items, block_chars):
        part = slim.mapInArrow(_search(spark.sparkContext.broadcast(block), rate), f"id {kind}, item_id long, distance int, match_start int, match_end int")
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("id", id_col)


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    block, held, any_ = [], 0, False
    rows = items.select("item_id", "text").filter("text is not null").orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1])
        if held >= block_chars:
            yield block
            block, held, any_ = [], 0, True  # one block at a time is on the driver
    if block or not any_:
        yield block


def _search(block: Broadcast, rate: float) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block.value, rate)
        for batch in batches:
            rows = [(i, *hit) for i, t in zip(batch.column(0), batch.column(1), strict=True) for hit in matcher.find(t.as_py())]
            ids = pa.array([r[0].as_py() for r in rows], batch.schema.field(0).type)
            rest = [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()), (4, pa.int32()))]
            yield pa.RecordBatch.from_arrays([ids, *rest], names=["id", "item_id", "distance", "match_start", "match_end"])

    return run


def without_leaks(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    *,
    rate: float = RATE,
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """docs without the rows whose text contains an item. Only the text goes to Python; nothing is shuffled.

    Null and empty items are ignored; null and empty texts stay. Repeated rows stay or go together. Columns keep their
    names and order, whatever they are called; an empty table on either side gives docs as it is. With items of more
    than block_chars characters the rows left by each block are written before the next one's automaton is built.
    """
    out, first = docs, True
    for block in _blocks(items, block_chars):
        out = out if first else written(spark, out, "unleaked")
        out, first = out.filter(~_holds(spark.sparkContext.broadcast(block), rate)(text_of(out, text_col))), False
    return out


def _holds(block: Broadcast, rate: float) -> callable:
    @F.pandas_udf("boolean")
    def holds(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(block.value, rate)
        for texts in parts:
            yield pd.Series([bool(matcher.find(t)) for t in texts], dtype=bool)

    return holds
