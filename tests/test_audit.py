"""Grounding, set similarity and audits against plain computations."""

import itertools
import random
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from loomgraph.operators import audit, grounding, setsim


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAＡ \t\n①ﬁé　中", max_size=30))
def test_folded_text_keeps_its_places(text):
    bare, places = grounding.folded(text)
    assert bare == " ".join("".join(unicodedata.normalize("NFKC", c) for c in text).split())
    assert len(places) == len(bare) and places == sorted(places)
    for char, place in zip(bare, places):
        assert char == " " or char in unicodedata.normalize("NFKC", text[place])


def test_quotes_get_their_places_back(spark):
    text = "负责ＡＢ　测试\n与 部署。测试 与 部署，aaa ①"
    quotes = ["测试", "AB 测试 与", "aa", "与 部署", "部署。测试\n与", "1", "ＡB", "", None, "缺", "测试　与"]
    texts = spark.createDataFrame([(1, text, 9), (2, None, 9), (4, "测试", 9), (4, "测试", 9)], "doc long, text string, start int")
    asked = spark.createDataFrame([(1, q) for q in [*quotes, "缺"]] + [(2, "x"), (3, "y"), (None, "z"), (4, "测试")], "doc long, quote string")
    found = [(r.doc, r.quote, r.status, r.start, r.end, r.source) for r in grounding.ground(texts, asked).collect()]
    at = text.index
    wanted = [
        (1, "测试", "exact", at("测试"), at("测试") + 2, "测试"),
        (1, "测试", "exact", at("测试 "), at("测试 ") + 2, "测试"),
        (1, "aa", "exact", at("aaa"), at("aaa") + 2, "aa"),
        (1, "aa", "exact", at("aaa") + 1, at("aaa") + 3, "aa"),
        (1, "AB 测试 与", "normalized", 2, at("与") + 1, text[2 : at("与") + 1]),
        (1, "与 部署", "exact", at("与 部署"), at("与 部署") + 4, "与 部署"),
        (1, "与 部署", "exact", text.rindex("与 部署"), text.rindex("与 部署") + 4, "与 部署"),
        (1, "部署。测试\n与", "normalized", at("部署。"), at("部署。") + 7, text[at("部署。") : at("部署。") + 7]),
        (1, "1", "normalized", at("①"), at("①") + 1, "①"),
        (1, "ＡB", "normalized", 2, 4, "ＡＢ"),
        (1, "测试　与", "ambiguous", None, None, None),
        (1, "", "unlocated", None, None, None),
        (1, "缺", "unlocated", None, None, None),
        (2, "x", "unlocated", None, None, None),
        (3, "y", "unlocated", None, None, None),
        *[(4, "测试", "exact", 0, 2, "测试")] * 2,
    ]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)


def test_many_quotes_of_one_document_are_several_rows(spark, monkeypatch):
    monkeypatch.setattr(grounding, "TOGETHER", 3)
    texts = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(100)))], "doc long, text string")
    quotes = texts.select("doc", F.explode(F.split("text", " ")).alias("quote"))
    found = grounding.ground(texts, quotes)
    assert found.where("status <> 'exact'").count() == 0 and found.select("quote").distinct().count() == 100


def test_grounding_of_empty_tables(spark):
    texts, quotes = spark.createDataFrame([(1, "a")], "doc long, text string"), spark.createDataFrame([(1, "a")], "doc long, quote string")
    assert grounding.ground(texts, quotes.limit(0)).collect() == []
    assert [r.status for r in grounding.ground(texts.limit(0), quotes).collect()] == ["unlocated"]


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_every_similar_pair(spark, least):
    rnd = random.Random(int(least * 10))
    base = [rnd.sample(range(40), rnd.randint(1, 12)) for _ in range(40)]
    near = [[x for x in s if rnd.random() > 0.1] + [rnd.randint(0, 40)] for s in base for _ in range(2)]
    sets = {f"s{i:03}": set(s) for i, s in enumerate([*base, *near, base[0], [], range(40)])}
    frame = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "set_id string, items array<int>").repartition(4)
    found = {(r.a, r.b): round(r.similarity, 9) for r in setsim.similar_sets(frame, least=least).collect()}
    assert found == {(a, b): round(jaccard(sets[a], sets[b]), 9) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] | sets[b] and jaccard(sets[a], sets[b]) >= least - 1e-12}
    left, right = ({k: v for k, v in sets.items() if (int(k[1:]) % 3 == 0) == x} for x in (True, False))
    frames = [frame.where(F.col("set_id").isin(list(x))) for x in (left, right)]
    found = {(r.a, r.b) for r in setsim.similar_sets(*frames, least=least).collect()}
    assert found == {(a, b) for a in left for b in right if left[a] | right[b] and jaccard(left[a], right[b]) >= least - 1e-12}


def test_copies_of_a_set_are_one(spark):
    rows = spark.createDataFrame([(1, [2, 1]), (2, [1, 2, 2]), (3, None), (4, []), (5, [3]), (None, [3])], "doc long, x array<int>")
    sets, members = setsim.classes(rows, "doc", F.col("x"))
    assert sorted(r["items"] for r in sets.collect()) == [[1, 2], [3]]
    assert members.count() == 4 and members.select("set_id").distinct().count() == 2


def test_audit_by_hand(spark):
    """Two people: one with every fault, one of whom nothing is known."""
    people = spark.createDataFrame([("a", 2, "J"), ("b", 0, None)], "doc string, years long, job string")
    points = spark.createDataFrame(
        [("a", "p1", True, False, 0.9, 1, "c1"), ("a", "p2", True, None, 0.2, None, "c2"), ("a", "p3", True, True, 0.7, 2, "c3"), ("a", "p4", True, False, None, 5, "c4"), ("a", "p5", False, False, 0.8, None, "c5"), ("a", "p6", False, True, 0.1, 1, None)],
        "doc string, name string, listed boolean, told boolean, proficiency double, anchors int, category string",
    )
    experiences = spark.createDataFrame([("a", 12, "work"), ("a", 3, None), ("a", 30, "competition")], "doc string, months int, kind string")
    lines = spark.createDataFrame([("a", "准确率提升 62%"), ("a", "在测试集上提升 3 倍"), ("a", "负责推荐系统的设计与实现"), ("a", "论文 3 篇"), ("a", "论文5篇，专利 2 项"), ("a", None), ("a", "")], "doc string, text string")
    snippets = spark.createDataFrame([("J", "负责推荐系统的设计和实现"), ("K", "准确率提升 62%"), (None, "论文 3 篇")], "job string, text string")
    found = {r.doc: r for r in audit.audit(people, points, experiences, lines, snippets, ("设计与", "推荐")).collect()}
    a, b = found["a"], found["b"]
    assert (a.n_listed_only, a.n_overrated, a.months, a.n_unbacked, a.n_boilerplate, a.n_conflicts, a.n_categories, a.focus) == (3, 2, 15, 1, 2, 1, 5, 0.2)
    pairs = [{t[i : i + 2] for i in range(len(t) - 1)} for t in ("负责推荐系统的设计与实现", "负责推荐系统的设计和实现")]
    assert a.echo == pytest.approx(jaccard(*pairs)) and a.month_ratio == 0.625
    assert [a[f"{c}_level"] for c in audit.CHECKS] == ["risk", "watch", "watch", "watch", "watch", "watch", "watch"]
    assert (a.risk, a.watch, a.score) == (1, 6, 34)
    assert [b[f"{c}_level"] for c in audit.CHECKS] == ["pass"] * 7 and (b.echo, b.month_ratio, b.score) == (0.0, 1.0, 100)


def test_experience_links(spark):
    claims = spark.createDataFrame([("d", "x", "J", "s1", 0.5), ("d", "x", "J", "s1", 0.2), ("d", "x", "J", "s2", 1.0), ("d", "y", "J", "s3", 1.0), ("d", "z", "K", "s1", 1.0)], "doc string, experience string, job string, skill string, owned double")
    required = spark.createDataFrame([("J", "s1", 0.8), ("J", "s2", 0.1), ("J", "s3", 0.05), ("J", "s4", 0.05)], "job string, skill string, required double")
    found = {r.experience: (round(r.coverage, 9), [(h.skill, h.required, h.owned) for h in r.hits]) for r in audit.link_experiences(claims, required).collect()}
    assert found == {"x": (0.6, [("s1", 0.8, 0.5), ("s2", 0.1, 1.0)]), "y": (0.0, []), "z": (0.0, [])}


@pytest.mark.parametrize("known_bytes", [16 << 10, 0])
def test_only_texts_in_reach_of_a_snippet_become_sets(spark, monkeypatch, known_bytes):
    """A text in every person's lines, texts of which too little is known, too short and too long ones; with and without the filter the same result."""
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdef", k=5)) for _ in range(12)]
    said = [" ".join(rnd.choices(words, k=rnd.randint(1, 9))) for _ in range(60)] + [f"{k} 19{k}.0{k % 7} Order {k * 7919}" for k in range(40)] + ["everywhere", "a", "", None]
    lines = [(doc, text) for doc in range(20) for text in rnd.choices(said, k=12) + ["everywhere"]] + [(1, None), (None, words[0])]
    snippets = [(job, " ".join(rnd.choices(words, k=4))) for job in "xyz" for _ in range(15)] + [("x", ""), ("y", None)]
    people = [(doc, "xyzw"[doc % 4]) for doc in range(20)] + [(90, None)]
    grams = lambda t: {t.replace(" ", "")[i : i + 2] for i in range(len(t.replace(" ", "")) - 1)} if t else set()
    wanted = {}
    for doc, job in people:
        mine = [grams(t) for d, t in lines if d == doc]
        theirs = {frozenset(grams(t)) for j, t in snippets if j == job} - {frozenset()}
        near = [len(a & b) / len(a | b) for a in mine if a for b in theirs if len(a & b) / len(a | b) >= 0.5]
        if near:
            wanted[doc] = (round(max(near), 9), len(near))
    plain, sizes, reach = audit.similar_sets, [], audit.in_reach
    monkeypatch.setattr(audit, "similar_sets", lambda a, b, least: sizes.append(a.count()) or plain(a, b, least))
    monkeypatch.setattr(audit, "in_reach", lambda *args: reach(*args, known_bytes))
    found = audit.echoes(spark.createDataFrame(lines, "doc long, text string"), spark.createDataFrame(snippets, "job string, text string"), spark.createDataFrame(people, "doc long, job string"), 0.5)
    assert {r.doc: (round(r.echo, 9), r.n_lines) for r in found.collect()} == wanted and wanted
    every = {frozenset(grams(t)) for _, t in lines} - {frozenset()}
    asked = {frozenset(grams(t)) for _, t in snippets} - {frozenset()}
    known, low, high = set().union(*asked), min(map(len, asked)), max(map(len, asked))
    near = [x for x in every if 2 * len(x) >= low and 2 * high >= len(x) and 2 * len(x & known) >= len(x)]
    assert sizes == [len(near) if known_bytes else len(every)] and len(near) < len(every) - 20
