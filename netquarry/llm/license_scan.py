"""License scans: exact phrases, and short notices found with a bounded number of edits.

A notice of m characters may appear with k = m // EDIT_EVERY edits. It is split into k + 1 pieces, of which at least
one appears unchanged (pigeonhole); the pieces of all notices are looked for together, and in a window of bounded
length around each hit the regex library's bounded-error matching verifies the notice and reports its span and edits. Texts are searched as their words (ASCII
letters in lower case, digits, all non-ASCII characters) joined by single spaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.decontaminate import Pattern
from netquarry.llm.shared import text_of

#: Phrases whose every place counts, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Short notices searched for with edits, their labels, and the words that tell a licence from others: these stand unedited.
NOTICES = (
    ("all rights reserved", "reserved", ("reserved",)),
    ("general public license", "gpl", ()),
    ("released under the mit license", "mit", ("mit",)),
    ("released under the bsd license", "bsd", ("bsd",)),
    ("released under the isc license", "isc", ("isc",)),
    ("licensed under the apache license", "apache", ("apache",)),
    ("permission is hereby granted free of charge", "mit", ()),
    ("redistribution and use in source and binary forms", "bsd", ()),
    ("this work is licensed under the creative commons", "cc", ()),
    ("licensed under cc by", "cc-by", ("cc", "by")),
    ("mozilla public license", "mpl", ("mozilla",)),
)
#: Words right after a notice of a label that make it another one: parts of a Creative Commons licence, one after the other.
CC_PARTS = {
    "nc": "nc", "sa": "sa", "nd": "nd", "attribution": "by", "noncommercial": "nc", "non commercial": "nc", "sharealike": "sa", "share alike": "sa",
    "noderivatives": "nd", "noderivs": "nd", "no derivatives": "nd",
}
AFTER = {"mit": (("to any person or organization", "bsl"),)}
BEFORE = {"gpl": (("lesser", "lgpl"), ("affero", "agpl"))}
EDIT_EVERY = 8
#: Byte by byte: A-Z to lower case, digits, a-z and the bytes of non-ASCII characters as they are, the rest to space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


class NoticeSearch:
    """The notices with their pieces in one automaton and a pattern for each number of edits."""

    def __init__(self, notices=NOTICES, edit_every: int = EDIT_EVERY):
        if edit_every < 7:
            raise ValueError("edit_every must be 7 or more: a window holds one match then")
        self.notices, by_piece = [], {}
        for phrase, label, *telling in notices:
            edits = len(phrase) // edit_every
            for offset, piece in _pieces(phrase, edits + 1):
                by_piece.setdefault(piece, []).append((len(self.notices), offset))
            halves = [half for _, half in _pieces(phrase, 2 * edits + 2)]
            patterns = [regex.compile(f"(?:{regex.escape(phrase)}){{e<={e}}}") for e in range(edits + 1)]
            self.notices.append((phrase, label, edits, halves, Pattern(phrase), patterns, tuple(*telling)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in by_piece.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, joined: str) -> list[tuple[str, int, int, int, str, float]]:
        """(label, first word, words, edits, matched text, closeness) of the notices found in the joined words.

        Hits of one notice's pieces on diagonals near each other make a window of bounded length, in which the closest
        match is taken. The windows go from left to right and begin behind the last match, so matches of a notice
        don't overlap, and any stretch within the budget overlaps a match. A match that lacks one of the notice's telling
        words, unedited and whole, is none. Places and edits are in characters.
        """
        diagonals: dict[int, list[int]] = {}
        for last, (length, where) in self.automaton.iter(joined):
            for k, offset in where:
                diagonals.setdefault(k, []).append(last + 1 - length - offset)
        out = []
        for k, starts in diagonals.items():
            phrase, label, most, halves, nearest, patterns, telling = self.notices[k]
            behind = counted = before = 0
            for low, high in _runs(sorted(starts), most):
                begin, end = max(behind, low - most, 0), high + len(phrase) + most
                window = joined[begin:end]
                if len(window) < len(phrase) - most or any(w not in window for w in telling) or not _enough(halves, window, most):
                    continue
                # the least distance first: with a larger bound the pattern tries far more ways, and may take a worse one
                distance = nearest.search(window)[0]
                m = patterns[distance].search(joined, begin, end) if distance <= most else None
                if m:
                    behind = m.end()
                    low_end, high_end = joined.rfind(" ", 0, m.start() + 1) + 1, joined.find(" ", m.end() - (m[0][-1] == " "))
                    if not set(telling) <= set(joined[low_end:high_end].split()):
                        continue
                    first = m.start() + (m[0][0] == " ")
                    before += joined.count(" ", counted, first)  # of spaces before a word, one is the text's first
                    counted = first
                    matched, edits = m[0].strip(), sum(m.fuzzy_counts)
                    if matched != m[0]:
                        edits = min(edits, nearest.search(matched)[0])
                    told = refined(label, joined, low_end, high_end)
                    out.append((told, max(before - 1, 0), len(matched.split()), edits, matched, 1 - edits / len(phrase)))
        return out


def refined(label: str, joined: str, low: int, high: int) -> str:
    """The label of a notice at [low, high) of the joined words, by the words around it."""
    for word, other in BEFORE.get(label, ()):
        if joined.endswith(f" {word} ", 0, low):
            return other
    for words, other in AFTER.get(label, ()):
        if joined.startswith(f" {words} ", high):
            return other
    if label not in ("cc", "cc-by"):
        return label
    parts = ["by"] if label == "cc-by" else []
    while found := next((w for w in CC_PARTS if joined.startswith(f" {w} ", high)), None):
        parts.append(CC_PARTS[found])
        high += 1 + len(found)
    return "-".join(["cc", *dict.fromkeys(parts)])


def _pieces(phrase: str, n: int) -> list[tuple[int, str]]:
    cuts = [len(phrase) * i // n for i in range(n + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _runs(starts: list[int], most: int) -> Iterator[tuple[int, int]]:
    """The first and last of the diagonals that lie within 2 x most of their first."""
    low = high = starts[0]
    for start in starts:
        if start > low + 2 * most:
            yield low, high
            low = start
        high = start
    yield low, high


def _enough(halves: list[str], window: str, most: int) -> bool:
    """Of 2 x (most + 1) pieces, an edit spoils one at most; without most + 2 of them there is no match."""
    missing = 0
    for half in halves:
        if half not in window:
            missing += 1
            if missing > most:
                return False
    return True


def scan_text(text: str | None, search: NoticeSearch, base=BASE) -> dict:
    words = (text or "").encode().translate(WORD_BYTES).split()
    joined = b" ".join([b"", *words, b""]).decode() if words else ""
    places, labels = [], set()
    for phrase, label in base:
        wanted = f" {phrase} "
        at, before, passed = joined.find(wanted), 0, 0
        while at >= 0:
            passed += joined.count(" ", before, at)  # spaces before a word are as many as the words before it
            before = at
            places.append(passed)
            labels.add(label)
            at = joined.find(wanted, at + 1)
    fuzzy = search.find(joined) if joined else []
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(labels)),
        "labels": ",".join(sorted(labels | {f[0] for f in fuzzy})),
        "score": 1.0 if places else max((f[5] for f in fuzzy), default=0.0),
        "notices": [dict(zip(("label", "first_word", "words", "edits", "matched"), f[:5], strict=True)) for f in fuzzy],
    }


_KIND = pa.struct(
    [("label", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("edits", pa.int64()), ("matched", pa.string())]
)
_FIELDS = [
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("notices", pa.list_(_KIND)),
]
_DDL = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "notices array<struct<label:string,first_word:long,words:long,edits:long,matched:string>>"
)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES, edit_every: int = EDIT_EVERY) -> DataFrame:
    """One row for each row of docs: id, word count, base places, labels, score and the notices found with edits.

    n_base, first_word, last_word and base_labels come from the exact phrases alone; labels has those of the notices
    too, where the words around a notice may tell a further kind (see refined). Of equally near places of a notice in one
    window the first counts; texts are read whole, however long. score is 1 with a base place, else the closeness of the best notice, else 0. Null and empty texts have no
    words and score 0. Rows are judged one by one, so repeated rows and null ids just give their rows; an empty table
    gives an empty one; other columns play no part. Spans count words from 0 and edits in characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = NoticeSearch(notices, edit_every)
        for batch in batches:
            found = [scan_text(t, search) for t in batch.column(1).to_pylist()]
            columns = [pa.array([f[name] for f in found], kind) for name, kind in _FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *(n for n, _ in _FIELDS)])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), text_of(docs, text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, {_DDL}")
