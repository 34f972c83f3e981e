import random
import zlib
from collections import Counter, defaultdict

from loomgraph.llm import langid


def brute_grams(text):
    runs = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    if not runs:
        return Counter()
    padded = "\0" + "\0".join(runs) + "\0"
    key = lambda g: (len(g), [ord(c) for c in g])
    out = Counter(c for c in padded if c != "\0")
    out.update(padded[i : i + 2] for i in range(len(padded) - 1))
    out.update(padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != "\0")
    return Counter(dict(sorted(out.items(), key=lambda x: (-x[1], key(x[0])))))


def brute_identify(rows, size=langid.PROFILE):
    totals = defaultdict(Counter)
    for doc, text, lang in rows:
        if lang is not None and zlib.crc32(("" if doc is None else str(doc)).encode()) % 4 != 2:
            totals[lang].update(brute_grams(text))
    key = lambda g: (len(g), [ord(c) for c in g])
    profiles = {x: {g: i for i, g in enumerate(sorted(c, key=lambda g: (-c[g], key(g)))[:size])} for x, c in totals.items() if c}
    out = []
    for doc, text, _ in rows:
        mine = list(brute_grams(text))[:size]
        best = ("und", 0.0)
        if mine and profiles:
            far, name = min((sum(abs(i - p[g]) if g in p else size for i, g in enumerate(mine)), x) for x, p in profiles.items())
            best = (name, 1 - far / (size * len(mine)))
        out.append((doc, zlib.crc32(("" if doc is None else str(doc)).encode()) % 4 == 2, *best))
    return out


def test_matches_brute_force(spark):
    rnd = random.Random(4)
    syllables = {"en": ["the", "and", "ing"], "de": ["ung", "der", "ß"], "fr": ["é", "eau", "que"]}
    rows = []
    for i in range(300):
        lang = rnd.choice(list(syllables))
        rows.append((i, "".join(rnd.choice(syllables[lang]) + rnd.choice(["", " ", ", 1"]) for _ in range(rnd.randint(1, 80))), lang if i % 7 else None))
    rows += [(300, None, "en"), (301, "", "en"), (302, "123 !?", "de"), (303, "ÀÉ İx \U0001f600 \U00010400", None), (5, rows[5][1], rows[5][2]), (None, "the and", "en"), (304, "ung " * 20000, "de")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double").repartition(4)
    found = sorted((tuple(r) for r in langid.identify(docs).collect()), key=str)
    assert found == sorted(brute_identify(rows), key=str)
    right = [r[2] == lang for r, lang in [(r, dict((x[0], x[2]) for x in rows)[r[0]]) for r in found if r[1]] if lang and r[2] != "und"]
    assert sum(right) / len(right) > 0.9


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(0, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in langid.identify(docs).collect()] == [("und", 0.0)]
    assert langid.identify(docs.limit(0)).collect() == []
