"""Trees against walking up, JSON spans against Python's parser."""

import json
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import loose_json
from loomgraph.operators import tree

NODES = "code string, name string, parents array<string>, retained boolean"


def walk(nodes):
    """(code, path, depth, retained, parent, state) by walking up from each node."""
    by = {}
    for code, name, parents, retained in nodes:
        if code is not None:
            row = (name, parents[0] if parents else None, bool(retained))
            if code not in by or (row[0], row[1] or "", row[2]) < (by[code][0], by[code][1] or "", by[code][2]):
                by[code] = row
    out = []
    for code, (name, up, retained) in by.items():
        path, seen, nearest, orphan = [name], {code}, None, False
        while up is not None:
            if up not in by:
                orphan = True
                break
            if up in seen:
                path = None
                break
            seen.add(up)
            path.append(by[up][0])
            if nearest is None and by[up][2]:
                nearest = up
            up = by[up][1]
        if path is None:
            out.append((code, None, None, retained, tree.ROOT, "cycle"))
        else:
            out.append((code, path[::-1], len(path) - 1, retained, nearest or tree.ROOT, "orphan" if orphan else "ok"))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_nearest_retained_ancestor(spark, seed):
    rnd = random.Random(seed)
    nodes = [(f"n{i}", f"name{i}", [f"n{rnd.randint(0, 44)}", "n1"] if rnd.random() < 0.3 else [f"n{rnd.randint(max(0, i - 4), i - 1)}"] if i else None, rnd.choice([True, False, None])) for i in range(40)]
    nodes += [(None, "x", None, True), nodes[3], ("top", "t", [], True), ("self", "s", ["self"], True), *[(f"d{i}", f"e{i}", [f"d{i - 1}"] if i else ["top"], i % 7 == 0) for i in range(37)]]
    frame = spark.createDataFrame(nodes, NODES).repartition(3)
    assert sorted(tuple(r) for r in tree.ancestry(frame).collect()) == walk(nodes)


def test_retained_tree(spark):
    nodes = spark.createDataFrame([("a", "A", None, True), ("b", "B", ["a"], False), ("c", "C", ["b", "z"], True), ("d", "D", ["b"], False), ("e", "E", ["c"], True), ("f", "F", ["gone"], True)], NODES)
    assert sorted(tuple(r) for r in tree.retained_tree(nodes).collect()) == [("__ROOT__", "a", 2), ("__ROOT__", "f", 0), ("a", "c", 0), ("c", "e", 0)]
    assert tree.ancestry(nodes.limit(0)).collect() == []


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.text(alphabet='ab"\\[]{}', max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(alphabet="ab]", max_size=3), x, max_size=3), max_leaves=6)


@settings(max_examples=200, deadline=None)
@given(st.lists(VALUES, max_size=3), st.text(alphabet="ab ]\n`", max_size=5), st.text(alphabet='ab []{}"', max_size=8))
def test_a_list_is_found_whatever_surrounds_it(value, before, after):
    body, reason = loose_json.span(before + json.dumps(value) + after, "array")
    assert reason is None and json.loads(body) == value


@pytest.mark.parametrize(
    "text,kind,told",
    [(None, "array", (None, "empty")), (" \n", "array", (None, "empty")), ("no", "array", (None, "absent")), ("[1, 2", "array", (None, "unclosed")), ('["]', "array", (None, "unclosed")), ("[1,]", "array", (None, "invalid")), ("[NaN]", "array", (None, "invalid")),
     ('{"a": 1, "a": 2}', "object", (None, "repeated field: a")), ('[{"b": {"a": 1, "a": 1}}]', "array", (None, "repeated field: a")), ('x {"a": "}"} y', "object", ('{"a": "}"}', None))],
)
def test_reasons(text, kind, told):
    assert loose_json.span(text, kind) == told


def test_values_as_variants(spark):
    rows = ['```json\n[{"id": 7, "kind": "a"}, 3]\n```', "[]", None, "[1", '{"id": 1, "extra": 2}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    lists = df.select("i", loose_json.found(F.col("t")).alias("f")).orderBy("i").select("f.reason", F.try_variant_get("f.value", "$[0].id", "int").alias("id"), F.size(F.try_variant_get("f.value", "$", "array<variant>")).alias("n")).collect()
    assert [tuple(r) for r in lists] == [(None, 7, 2), (None, None, 0), ("empty", None, None), ("unclosed", None, None), ("absent", None, None)]
    objects = df.select("i", loose_json.found(F.col("t"), "object").alias("f")).orderBy("i").select(loose_json.field_faults(F.col("f.value"), ["kind", "id"]).alias("x")).collect()
    assert [r.x for r in objects] == [None, "not an object", "not an object", "not an object", "missing: kind; unknown: extra"]
    with pytest.raises(ValueError):
        loose_json.found(F.col("t"), "text")
