"""Strengths at window ends against a plain recomputation of each window; signal series."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import asof

DAY = datetime.date
SCHEMA = "entity string, date date, source string, tier string, confidence string, n int, end_date string"


def contribution(date, source, tier, confidence, end):
    weight, half = (1.0, 365) if source == "jd" else ({"S": 1.0, "A": 0.7, "B": 0.5, "C": 0.3}.get(tier, 0.2), 730) if tier else (0.4, 180)
    return weight * {"high": 1.0, "medium": 0.6}.get(confidence, 0.3) * (0.5 if date is None else 0.5 ** ((end - date).days / half))


def plain(rows, ends):
    out = {}
    for end in ends:
        for entity in {r[0] for r in rows}:
            known = [r for r in rows if r[0] == entity and (r[1] is None or r[1] <= end)]
            if known:
                left, cs, dates = 1.0, [contribution(*r[1:], end) for r in known], [r[1] for r in known if r[1]]
                for c in cs:
                    left *= 1 - c
                out[entity, end] = (len(known), 1 - left, max(cs), min(dates, default=None), max(dates, default=None))
    return out


def test_every_window_is_as_recomputed_alone(spark):
    rnd = random.Random(4)
    days = [DAY(2024, 1, 1) + datetime.timedelta(d) for d in range(0, 400, 13)] + [None]
    rows = [(rnd.choice(["a", "b", None]), rnd.choice(days), rnd.choice(["jd", "papers", "news"]), rnd.choice(["", None, "S", "C", "?"]), rnd.choice(["high", "medium", "low", None])) for _ in range(120)]
    rows += [("hot", DAY(2024, 3, 3), "news", "", "low")] * 50 + [("sure", DAY(2024, 5, 31), "jd", "", "high")] + [("none", DAY(2030, 1, 1), "jd", "", "high")]
    ends = [DAY(2024, m, 28) for m in range(1, 12)] + [DAY(2024, 5, 31)]
    evidence = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    windows = spark.createDataFrame([(e,) for e in [*ends, ends[0], None]], "end_date date")
    found = {(r.entity, r.end_date): (r.n, r.strength, r.max_contrib, r.first_seen, r.last_seen) for r in asof.strengths_at(evidence.drop("n", "end_date"), windows, ["entity"], digits=None).collect()}
    wanted = plain(rows, ends)
    assert set(found) == set(wanted)
    for key, told in wanted.items():
        assert (found[key][0], *found[key][3:]) == (told[0], *told[3:])
        assert found[key][1:3] == pytest.approx(told[1:3], abs=1e-12)
    assert found["sure", DAY(2024, 5, 31)][1] == 1.0 and ("none", ends[0]) not in found


def test_hand_computed_strength(spark):
    """A paper of 21 days and a news item of 41 days before the window's end."""
    rows = [("e", DAY(2026, 5, 10), "papers", "S", "high"), ("e", DAY(2026, 4, 20), "news", "", "high"), ("e", DAY(2026, 6, 1), "news", "", "high")]
    evidence = spark.createDataFrame(rows, "entity string, date date, source string, tier string, confidence string")
    windows = spark.createDataFrame([(DAY(2026, 5, 31),)], "end_date date")
    assert asof.strengths_at(evidence, windows, ["entity"]).first().strength == round(1 - (1 - 0.5 ** (21 / 730)) * (1 - 0.4 * 0.5 ** (41 / 180)), 4)


def test_empty_tables(spark):
    evidence = spark.createDataFrame([("a", None, "jd", "", "low")], "entity string, date date, source string, tier string, confidence string")
    windows = spark.createDataFrame([(DAY(2024, 1, 1),)], "end_date date")
    assert asof.strengths_at(evidence, windows.limit(0), ["entity"]).collect() == []
    assert asof.strengths_at(evidence.limit(0), windows, ["entity"]).collect() == []


def test_signal_series(spark):
    one, two = DAY(2024, 1, 31), DAY(2024, 2, 29)
    strengths = spark.createDataFrame([("a", "L", one, "papers", 0.5), ("a", "L", one, "papers", 0.9), ("a", "L", one, "news", 0.2), ("a", "L", two, "jd", 0.4)], "entity string, layer string, end_date date, source string, strength double")
    demand = spark.createDataFrame([("a", "L", one, 0.1), ("b", "L", two, 0.4), ("c", "M", two, 0.0)], "entity string, layer string, end_date date, value double")
    series = asof.signal_series(strengths, demand)
    found = {(r.entity, r.end_date): tuple(round(x, 9) for x in (r.paper, r.news, r.jd, r.gap)) for r in series.collect()}
    assert found == {("a", one): (0.9, 0.2, 0.25, 0.44), ("a", two): (0, 0, 0, 0), ("b", two): (0, 0, 1, 0), ("c", two): (0, 0, 0, 0)}
    assert {r.entity: r.freshness for r in asof.freshness(series).collect()} == {"a": 0.0, "b": None, "c": None}


def test_latest_window(spark):
    rows = lambda *d: spark.createDataFrame([(x,) for x in d], "date date")
    today = F.lit("2026-02-03").cast("date")
    assert asof.latest_window(rows(DAY(2024, 5, 1), None), rows(DAY(2025, 1, 1))).first().window == "2024-05"
    assert asof.latest_window(rows(), rows(DAY(2025, 1, 1))).first().window == "2025-01"
    assert asof.latest_window(rows(), rows(), today=today).first().window == "2026-02"


def test_no_row_for_each_entity_and_end_is_shuffled(spark):
    """Above the rows made for the ends nothing is dealt anew, neither for the strengths nor for the series."""
    evidence = spark.createDataFrame([("a", "L", DAY(2024, 1, 3), "papers", "B", "high"), ("b", "L", None, "news", "", "low")] * 3, "entity string, layer string, date date, source string, tier string, confidence string")
    windows = spark.createDataFrame([(DAY(2024, 1, 31),), (DAY(2024, 2, 29),)], "end_date date")
    demand = spark.createDataFrame([("a", "L", DAY(2024, 1, 31), 0.1)], "entity string, layer string, end_date date, value double")
    strengths = asof.strengths_at(evidence, windows, ["entity", "layer", "source"], parts=3)
    series = asof.signal_series(strengths, demand, parts=3)
    for rows in (asof.strengths_at(evidence, windows, ["entity"]), asof.freshness(series)):
        plan = rows._jdf.queryExecution().executedPlan().toString().split("Generate explode")
        assert len(plan) == 2 and "Exchange" not in plan[0]
    assert {(r.entity, r.end_date.month): r.n for r in strengths.collect()} == {("a", 1): 3, ("a", 2): 3, ("b", 1): 3, ("b", 2): 3}
