"""Mentions by an automaton against plain search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.automaton import Automaton, marked
from loomgraph.operators import mentions as M

EDGES = {"word": ("[a-z0-9]", "[a-z0-9]"), "any": ("(?!)", "(?!)")}


def brute(text, names, rule):
    """Every place of every name, tried one by one."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    hits = []
    for name in {n for n in names if n}:
        if name.isascii():
            before, after = EDGES.get(rule) or (("[a-z0-9_+.#-]",) * 2 if len(name) <= 2 else ("[a-z0-9_-]", "[a-z_-]"))
            pattern = f"(?<!{before})(?=({re.escape(name.lower())})(?!{after}))" if rule != "any" else f"(?=({re.escape(name.lower())}))"
            hits += [(name, m.start(), m.start() + len(name)) for m in re.finditer(pattern, low)]
        else:
            hits += [(name, i, i + len(name)) for i in range(len(text)) if text.startswith(name, i)]
    over = lambda h: any(o[1] <= h[1] and o[2] >= h[2] and o[2] - o[1] > h[2] - h[1] for o in hits)
    return sorted((*h, not over(h)) for h in hits)


@pytest.mark.parametrize("rule", ["any", "word", "tech"])
def test_automaton_finds_what_plain_search_finds(rule):
    rnd = random.Random(7)
    alphabet = "aabBc+#.- 1é中"
    for _ in range(150):
        names = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(0, 12))] + [""]
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))
        found = Automaton(names, rule).hits(text)
        assert found == sorted(found, key=lambda h: (h[1], -h[2], h[0]))
        assert sorted(marked(found)) == brute(text, names, rule)


def test_rule_is_checked():
    with pytest.raises(ValueError):
        Automaton(["a"], "words")


def test_names_of_technologies():
    """Short names stand free of `+`, `#` and `.`, versions may follow longer ones, hyphens join."""
    names = ["C", "C++", "Go", "MySQL", "React", "React-Native", "微信", "微信小程序"]
    text = "C++ and C#, Google; MySQL8, React-Native 微信小程序 c"
    assert [h[0] for h in marked(Automaton(names, "tech").hits(text)) if h[3]] == ["C++", "MySQL", "React-Native", "微信小程序", "C"]


@pytest.mark.parametrize("limit", [1 << 20, 20])
def test_mentions_of_a_table_of_names(spark, limit):
    """Nulls, repeated rows, clashing columns; one dictionary and several give the same."""
    rnd = random.Random(2)
    words = ["red", "blue", "ring", "Ring", "ring red", "é", "red ring blue", "b", "g r"]
    texts = [" ".join(rnd.choice(["red", "blue", "ring", "x", "éé", "Red"]) for _ in range(rnd.randint(0, 15))) for _ in range(30)] + [None, "", "red " * 20_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "red ring blue")]
    docs = spark.createDataFrame([(*r, "n", "h") for r in rows], "id long, body string, name string, hits string").repartition(3)
    names = spark.createDataFrame([(w,) for w in [*words, None, "", "red", "red"]], "name string")
    found = M.mentions(docs.select("id", "body", "name"), "id", "body", names, limit=limit).collect()
    wanted = [(doc, *h) for doc, t in rows for h in brute(t or "", words, "word")]
    assert sorted((tuple(r) for r in found), key=repr) == sorted(wanted, key=repr)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "red")], "id long, body string")
    names = spark.createDataFrame([("red",)], "name string")
    assert M.mentions(docs, "id", "body", names.limit(0)).collect() == []
    assert M.mentions(docs.limit(0), "id", "body", names).collect() == []
    assert M.listed_mentions(docs, "id", "body").collect() == []


def test_scan_takes_title_first_and_places_in_order(spark):
    df = spark.createDataFrame([("Spark", "Kafka first, then Hive"), ("none", "Hive then KAFKA then Sparkle"), (None, None)], "t string, b string")
    found = df.select(M.scan(F.col("t"), F.col("b"), {"A": ["Spark", "Flink"], "B": ["Kafka"], "C": ["Hive", "Kafka"]}).alias("f")).select("f.*").collect()
    assert [tuple(r) for r in found] == [(["A"], 1), (["C", "B"], 2), ([], 0)]


def test_first_points(spark):
    docs = spark.createDataFrame([(1, "python and Pandas, R"), (2, None)], "id long, t string")
    points = spark.createDataFrame([("S1", "pandas"), ("S1", "python"), ("S2", "python"), ("S3", "R"), ("S1", "python"), (None, "and")], "skill string, name string")
    assert sorted(tuple(r) for r in M.first_points(docs, "id", "t", points).collect()) == [(1, "S1", 0, 2), (1, "S2", 0, 1)]


def test_listed_items(spark):
    """Items in the resume are placed where they first stand; certificates list nothing; kinds by markers."""
    text = "张三\n专业技能：Python、深度学习；沟通能力强\nC++ | 咖啡\n\n技能证书: 英语\nPython again"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "no heading"), (4, "技能\n" + "x" * 81 + ", Go, Go")], "id long, t string")
    found = sorted(tuple(r) for r in M.listed_mentions(docs, "id", "t").collect())
    wanted = [(1, item, text.find(item), text.find(item) + len(item), kind) for item, kind in [("Python", "explicit_technical_skill"), ("深度学习", "explicit_technical_skill"), ("沟通能力强", "explicit_self_claim"), ("C++", "explicit_technical_skill"), ("咖啡", "explicit_unclassified_claim")]]
    assert found == sorted([*wanted, (4, "Go", 86, 88, "explicit_technical_skill")])


def test_context_words_go_until_none_is_left(spark):
    names = ["熟悉掌握提示词工程能力", "有经验的", "Python", None, "", "工作经验"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.t for r in df.select(M.without_context(F.col("n")).alias("t")).collect()] == ["提示词工程", "", "Python", None, "", ""]


def test_signals(spark):
    rows = [(1, "技能：Python、 Go ,Python；任务: 部署，Go;技术栈：Python"), (1, "技能：Go"), (2, None), (3, "技能：;任务"), (None, "任务：部署")]
    names = spark.createDataFrame([("技能", "Python"), ("技能", "Go"), ("技能", "Go"), ("任务", "部署"), ("任务", None), (None, "Go")], "kind string, name string")
    found = sorted((tuple(r) for r in M.signals(spark.createDataFrame(rows, "id long, t string"), "id", "t", names).collect()), key=str)
    assert found == sorted([(1, "技能", "Python", 0), (1, "技能", "Go", 1), (1, "技能", "Python", 2), (1, "任务", "部署", 1000), (1, "技能", "Go", 0), (None, "任务", "部署", 0)], key=str)


def test_mention_evidence_keeps_the_first_units(spark):
    units = [("d", 3, "go and java"), ("d", 1, "java only"), ("d", 0, "java only"), ("d", 2, "GO go"), ("d", 4, None), ("e", 0, "nothing"), ("e", 1, "gopher")]
    names = spark.createDataFrame([("L", "go"), ("L", "java"), ("J", "java"), (None, "go"), ("X", None)], "code string, name string")
    frame = spark.createDataFrame(units, "doc string, place int, unit string")
    found = {(r.doc, r.code): (r.units, r.confidence) for r in M.mention_evidence(frame, names, most=2).collect()}
    assert found == {("d", "L"): (["java only", "GO go"], "medium"), ("d", "J"): (["java only", "go and java"], "medium")}
    assert M.mention_evidence(frame.limit(0), names).collect() == []
