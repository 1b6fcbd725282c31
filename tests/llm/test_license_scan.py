import random
import re
import string
import time

from pyspark.sql import functions as F

from netquarry.llm import license_scan as lic
from tests.llm.conftest import prose

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in lic.BASE:
        parts = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_against_brute_force(spark, make_docs, odd_texts):
    rng = random.Random(1)
    bits = ["CC BY", "cc-by", "cc by cc by", "General Public License", "general  public\nlicense!", "All rights reserved.", "all rights", "ccby", "écc by", "cc byé", "9cc by 4"]
    texts = odd_texts + [" ".join(x for _ in range(6) for x in (prose(rng, 3), rng.choice(bits))) for _ in range(60)]
    docs = make_docs(texts).withColumn("labels", F.lit("clash")).withColumn("score", F.lit(1))
    rows = {r.doc_id: r for r in lic.scan(docs).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert lic.scan(docs.limit(0)).count() == 0


def test_notices_with_edits_are_found():
    rng = random.Random(2)
    search = lic.NoticeSearch()
    for phrase, label, telling in lic.NOTICES:
        free = [i for i in range(1, len(phrase) - 1) if phrase[i] != " " and not any(a <= i < a + len(w) for w in telling for a in [f" {phrase} ".index(f" {w} ")])]
        for _ in range(15):
            chars = list(phrase)
            for _ in range(rng.randint(0, len(phrase) // lic.EDIT_EVERY)):
                chars[rng.choice(free)] = "q"
            text = prose(rng, 8) + " " + "".join(chars) + " " + prose(rng, 8)
            found = lic.scan_text(text, search)
            assert label in found["labels"].split(","), (phrase, "".join(chars))
    assert lic.scan_text(prose(rng, 400), search)["labels"] == ""


def test_spans_count_words():
    found = lic.scan_text("one two All Rihgts Reserved here", lic.NoticeSearch())
    (notice,) = [n for n in found["notices"] if n["label"] == "reserved"]
    assert notice["first_word"] == 2 and notice["edits"] == 2 and found["n_base"] == 0 and found["score"] < 1


def test_less_exact_notices_before_a_closer_one_are_reported():
    search = lic.NoticeSearch()
    kept = lambda text: [(n["first_word"], n["words"], n["edits"]) for n in lic.scan_text(text, search)["notices"] if n["label"] == "reserved"]
    assert kept("all rihts reserved all rights reserved") == [(0, 3, 1), (3, 3, 0)]
    assert kept("All rihgts reserved. All rigts reserved. All rights reserved. All rihts reserved.") == [(0, 3, 2), (3, 3, 1), (6, 3, 0), (9, 3, 1)]


def nearest(phrase, text):
    """The least edit distance of the phrase to a substring of the text, by dynamic programming over code points."""
    before = list(range(len(phrase) + 1))
    best = before[-1]
    for c in text:
        now = [0]
        for i, d in enumerate(phrase, 1):
            now.append(min(before[i - 1] + (c != d), before[i] + 1, now[-1] + 1))
        before, best = now, min(best, now[-1])
    return best


def edited(rng, phrase, edits):
    chars = list(phrase)
    for _ in range(edits):
        at, new = rng.randrange(len(chars)), rng.choice("qz版é \U0001f600")
        kind = rng.choice("sdi")
        chars[at : at + (kind != "i")] = [] if kind == "d" else [new]
    return "".join(chars)


def test_matches_against_dynamic_programming():
    """Every span is as near as it says, and nothing within the budget is left beside the spans of a notice."""
    rng = random.Random(8)
    search = lic.NoticeSearch()
    for _ in range(60):
        parts = []
        for _ in range(5):
            phrase = rng.choice(lic.NOTICES)[0]
            parts += [edited(rng, phrase, rng.randint(0, len(phrase) // 8 + 1)), prose(rng, rng.randint(0, 3))]
        words = " ".join(parts).encode().translate(lic.WORD_BYTES).split()
        joined = b" ".join([b"", *words, b""]).decode()
        for phrase, label, _ in lic.NOTICES:
            alone = lic.NoticeSearch([(phrase, label)])
            most, rest = len(phrase) // lic.EDIT_EVERY, joined
            found = alone.find(joined)
            for _, first, n, edits, matched, _ in found:
                assert nearest(matched, phrase) <= edits == nearest(phrase, matched) <= most
                assert n == len(matched.split()) and matched.split()[0] in joined.split()[first]
                rest = rest.replace(matched, "\x00", 1)
            assert all(nearest(phrase, part) > most for part in rest.split("\x00")), (phrase, joined)
        assert sorted(search.find(joined)) == sorted(f for p in lic.NOTICES for f in lic.NoticeSearch([p]).find(joined))
        told = {p: w for p, _, w in lic.NOTICES}
        assert all(set(w) <= set(f[4].split()) | set(joined.split()) for p, w in told.items() for f in lic.NoticeSearch([(p, "x", w)]).find(joined))


def test_long_repetitive_texts_take_linear_time():
    search = lic.NoticeSearch()
    for phrase in ("all rights reserve ", "licensed under the apach license ", "right "):
        began = time.perf_counter()
        found = lic.scan_text(phrase * (1_000_000 // len(phrase)), search)
        assert time.perf_counter() - began < 10
        assert len(found["notices"]) in (0, 1_000_000 // len(phrase))
    crowded = lic.scan_text("all 版rights版 reserved al rights reserved all rights reserved", search)["notices"]
    assert [(n["first_word"], n["edits"]) for n in crowded] == [(0, 2), (3, 1), (6, 0)]


LICENCES = (
    ("Licensed under CC BY 4.0.", "cc-by"), ("licensed under cc by", "cc-by"), ("licenced under CC-BY-SA 3.0", "cc-by,cc-by-sa"), ("Licensed under CC BY-NC", "cc-by,cc-by-nc"),
    ("lisensed under cc by nd 4.0", "cc-by,cc-by-nd"), ("licensed under CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa"), ("licensed under CC BY NC ND", "cc-by,cc-by-nc-nd"),
    ("Released under the MIT License", "mit"), ("relesed under the mit licence", "mit"), ("released under the BSD license", "bsd"), ("released under the bsd licnse", "bsd"),
    ("Released under the ISC license.", "isc"), ("released under teh isc licence", "isc"), ("Licensed under the Apache License, Version 2.0", "apache"), ("licenced under the apache licence", "apache"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"), ("permission is herby granted free of charge to any person obtaining", "mit"),
    ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy", "bsl"), ("Redistribution and use in source and binary forms, with or without", "bsd"),
    ("redistribution and use in sources and binary form", "bsd"), ("This work is licensed under the Creative Commons Attribution 4.0 License", "cc-by"),
    ("this work is licensed under the creative commons attribution sharealike licence", "cc-by-sa"), ("This work is licenced under the Creative Commons Attribution-NonCommercial-NoDerivs 3.0", "cc-by-nc-nd"),
    ("this work is licensed under the creative commons zero waiver", "cc"), ("Mozilla Public License 2.0", "mpl"), ("mozilla public licence", "mpl"), ("General Public Licence", "gpl"),
    ("GNU Lesser General Public Licence", "lgpl"), ("gnu affero general public licence", "agpl"), ("All Rihgts Reserved", "reserved"), ("al rights reserved", "reserved"),
)
NO_LICENCES = (
    "all rights deserved", "all lights observed", "released under the gpl license", "released under the zlib license", "licensed under the eclipse license", "licensed under pc by",
    "licensed under cc0", "released under the mist license", "the general public likes it", "eclipse public license", "released under pressure", "permission is granted to nobody",
)


def test_licences_are_told_apart():
    """Each notice has exactly its label; what is no notice has none."""
    search, rng = lic.NoticeSearch(), random.Random(4)
    for text, labels in LICENCES:
        found = lic.scan_text(f"{prose(rng, 5)} {text} {prose(rng, 5)}", search)
        assert set(found["labels"].split(",")) == set(labels.split(",")), (text, found)
        assert all(n["matched"] == n["matched"].strip() for n in found["notices"])
    for text in NO_LICENCES:
        assert lic.scan_text(f"{prose(rng, 5)} {text} {prose(rng, 5)}", search)["labels"] == "", text
