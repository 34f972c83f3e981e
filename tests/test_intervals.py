"""Overlapping intervals against all pairs; evidence policy and uncovered lines against hand-made texts."""

import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from loomgraph.functions import layout
from loomgraph.operators import intervals, policy


def brute(a, b, keyed):
    out = []
    for x in a:
        for y in b:
            if None in (x[1], x[2], y[1], y[2]) or x[2] <= x[1] or y[2] <= y[1] or (keyed and (x[0] is None or x[0] != y[0])):
                continue
            if x[1] < y[2] and y[1] < x[2]:
                out.append((x[3], y[3], min(x[2], y[2]) - max(x[1], y[1])))
    return sorted(out)


def rows_of(rnd, n):
    sizes = [0, 1, 2, 3, 8, 60, 1000]
    rows = []
    for i in range(n):
        start = rnd.randint(-500, 500)
        rows.append((rnd.choice(["p", "q", None]), start, start + rnd.choice(sizes) - rnd.randint(0, 1), i))
    return [*rows, ("p", -(10**6), 10**6, n), ("p", None, 5, n + 1), ("p", 5, None, n + 2), ("q", 7, 7, n + 3), ("q", 9, 3, n + 4), rows[0]]


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_overlapping_pairs_once(spark, keyed, seed):
    rnd = random.Random(seed)
    a, b = rows_of(rnd, 60), rows_of(rnd, 70)
    frames = [spark.createDataFrame(x, "k string, start long, end long, size long").repartition(3) for x in (a, b)]
    found = intervals.overlapping(*frames, ["k"] if keyed else []).selectExpr("a.size AS x", "b.size AS y", "overlap").collect()
    assert sorted(tuple(r) for r in found) == brute(a, b, keyed)


def test_short_intervals_dont_meet_under_a_long_one(spark):
    """One interval over everything on either side adds a pair for each other row, not all pairs of them as candidates."""
    rows = spark.range(3000).selectExpr("id * 10 AS start", "id * 10 + 3 AS end")
    everything = spark.createDataFrame([(0, 30_000)], "start long, end long")
    a, b = rows.unionByName(everything), rows.selectExpr("start + 5 AS start", "end + 5 AS end").unionByName(everything)
    pairs = intervals.overlapping(a, b)
    assert pairs.count() == 2 * 3000 + 1
    joined = pairs._jdf.queryExecution()
    assert "CartesianProduct" not in joined.toString() and "NestedLoop" not in joined.toString()


def test_empty_sides(spark):
    rows = spark.createDataFrame([(0, 5)], "start int, end int")
    assert intervals.overlapping(rows, rows.limit(0)).collect() == []
    assert intervals.overlapping(rows.limit(0), rows).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n\r\tH", max_size=40))
def test_lines_have_their_places(value):
    for bare, start in layout._lines(value):
        assert value[start : start + len(bare)] == bare


TEXT = "自我介绍，负责算法开发\n工作经历\n负责搭建推荐系统和数据库\n  1. 负责搭建推荐系统和数据库\n参与测试\n负责测试数据接口并优化模型\n期刊论文\n发表论文三篇\n校园经历\n组织活动与班级年会\n班级网站代码开发"


def frames(spark):
    texts = spark.createDataFrame([("r", TEXT), ("n", None), ("e", "")], "doc string, text string")
    at = lambda s, n=0: TEXT.index(s, n)
    told = [("x", "负责搭建推荐系统和数据库"), ("x", "发表论文三篇"), ("y", "组织活动与班级年会"), ("z", "班级网站代码开发"), ("w", "发表论文三篇")]
    rows = [("r", a, t, at(t), at(t) + len(t)) for a, t in told] + [("r", "u", "无处", None, None), ("r", "v", "x", 10_000, 10_001), (None, "q", "x", 1, 2)]
    return texts, spark.createDataFrame([*rows, rows[0]], "doc string, ability string, text string, start int, end int")


def test_direct_evidence(spark):
    """Papers and campus administration aren't direct evidence; an ability that had nothing else goes."""
    found = {(r.ability, r.text): (r.section, r.kept, r.dropped) for r in policy.direct_evidence(*frames(spark)).collect()}
    assert found == {
        ("x", "负责搭建推荐系统和数据库"): ("工作经历", True, False),
        ("x", "发表论文三篇"): ("期刊论文", False, False),
        ("y", "组织活动与班级年会"): ("校园经历", False, True),
        ("z", "班级网站代码开发"): ("校园经历", True, False),
        ("w", "发表论文三篇"): ("期刊论文", False, True),
        ("u", "无处"): (None, True, False),
        ("v", "x"): ("未知", True, False),
        ("q", "x"): (None, True, False),
    }


def test_repeated_evidence_is_there_again(spark):
    assert policy.direct_evidence(*frames(spark)).where("ability = 'x'").count() == 3


def test_uncovered_lines(spark):
    texts, evidence = frames(spark)
    found = [(r.section, r["rank"], r.text, r.covered) for r in policy.uncovered_lines(texts, evidence).orderBy("section", "rank").collect()]
    # the first work line is covered; its copy with a leading mark isn't, and neither is the one on interfaces
    assert found == [("工作经历", 1, "负责测试数据接口并优化模型", 0.0), ("工作经历", 2, "1. 负责搭建推荐系统和数据库", 0.0), ("简介/优势", 1, "自我介绍，负责算法开发", 0.0)]
    assert policy.uncovered_lines(texts.limit(0), evidence).collect() == []
    assert len(policy.uncovered_lines(texts, evidence.limit(0)).collect()) == 3


HEADS = {"工作经历": ("work", 2), "项目经历": ("project", 1), "研究": ("research", None), "技能": (None, None)}


def told(text):
    return [(k, n, text[a:b]) for k, n, a, b in layout.entries(text, HEADS, re.compile(layout.DATE_LINE))]


def test_segments_take_the_lines_above_their_dates():
    """Company and role stand above a date in work, a title in projects; other sections are one segment."""
    text = "张三\n2020-2021\n工作经历\n\n甲公司\n工程师\n2019.03 - 至今\n负责开发\n\n乙公司\n 测试 \n2017-2019\n负责测试\n项目经历\n前言\n平台\n2018.1~2019.2\n经理\n搭建\n研究\n 论文 \n\n技能\nPython\n2020-2021\n工作经历\n没有日期\n研究\n"
    assert told(text) == [
        ("work", 1, "甲公司\n工程师\n2019.03 - 至今\n负责开发"),
        ("work", 2, "乙公司\n 测试 \n2017-2019\n负责测试"),
        ("project", 1, "平台\n2018.1~2019.2\n经理\n搭建"),
        ("research", 1, "论文"),
        ("work", 3, "没有日期"),
    ]
    assert told("工作经历\n2019-2020\n2020-至今\nx") == [("work", 1, "2019-2020"), ("work", 2, "2020-至今\nx")]
    assert told("") == told("工作经历") == told("no heading\n2019-2020") == []


def test_segments_of_rows(spark):
    docs = spark.createDataFrame([(1, "工作经历\r\n甲\r\n2019-2020\r\nx"), (2, None)], "id long, t string")
    found = docs.select("id", layout.segments(docs.t, HEADS).alias("s")).orderBy("id").collect()
    assert [(x.kind, x.number, x.start, x.end) for x in found[0].s] == [("work", 1, 6, 21)] and found[1].s == []
