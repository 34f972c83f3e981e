"""Decisions, versions, operations and rounds against plain Python; resuming and replaying."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import resume, store

CANDIDATE = "cand long, kind string, name string, status string, map_to string, merge_into string, note string"


def test_decisions_by_hand(spark):
    rows = [
        (1, "new_skill", "Graph RAG", "reject", "T-01", None),
        (2, "new_skill", "Graph RAG", None, "T-01", "E1"),
        (3, "new_skill", "graph-rag", "ok", "T-99", "E1"),
        (4, "new_skill", "GraphRAG", "ok", None, "E404"),
        (5, "capability_gap", "Edge AI", "ok", None, None),
        (6, "new_skill", "edge  ai", "ok", None, None),
        (6, "new_skill", "edge  ai", "ok", None, None),
        (7, "new_job", "Edge AI", "ok", None, None),
        (8, "rumour", "Edge AI", "ok", None, None),
        (9, "new_job", " · ", "ok", None, None),
        (10, "new_job", None, "ok", None, None),
        (11, None, "x", "ok", "T-02", None),
        (0, "new_skill", "Edge AI", "reject", None, None),
    ]
    candidates = spark.createDataFrame([(*r, "n") for r in rows], CANDIDATE).repartition(3)
    taxonomy = spark.createDataFrame([("T-01", "a"), ("T-02", "b"), ("T-01", "a"), (None, "c")], "code string, name string")
    entries = spark.createDataFrame([("E2", "new_skills", "graph rag"), ("E1", "new_skills", "GRAPH RAG"), ("E3", "new_jobs", "graph rag"), (None, "new_jobs", None)], "id string, array string, name string")
    found = sorted((r.cand, r.decision, r.target) for r in store.decide(candidates, taxonomy, entries).collect())
    assert found == sorted([
        (0, "reject", None), (1, "reject", None), (2, "strengthen", "T-01"), (3, "merge", "E1"), (4, "merge", "E1"), (5, "new", None), (6, "merge", None), (6, "merge", None),
        (7, "new", None), (8, "skip", None), (9, "skip", None), (10, "skip", None), (11, "strengthen", "T-02"),
    ])
    assert store.decide(candidates.limit(0), taxonomy, entries).collect() == []
    assert {r.decision for r in store.decide(candidates, taxonomy.limit(0), entries.limit(0)).collect()} == {"reject", "new", "merge", "skip"}


def plain_mutate(state, operations):
    """One batch, operation by operation."""
    state = {c: [n, d] for c, n, d in state}
    before = dict(state)
    for seq, op, code, other, name, definition in sorted(operations):
        if op == "modify" and code in state:
            state[code] = [name if name is not None else state[code][0], definition if definition is not None else state[code][1]]
    asked = {}
    for seq, op, code, other, name, definition in sorted(operations):
        if op == "merge" and code != other and code in state and other in state:
            asked.setdefault(other, (seq, code))
    texts = {c: d for c, (_, d) in state.items()}
    for other, (seq, code) in sorted(asked.items(), key=lambda x: (x[1][0], x[0])):
        if code not in asked:
            if texts[other]:
                state[code][1] = "；".join(x for x in (state[code][1], texts[other]) if x)
            state[other] = None
    state = {c: v for c, v in state.items() if v}
    number = max([int(c[2:]) for c in before] or [0])
    names = {n for n, _ in state.values()}
    for seq, op, code, other, name, definition in sorted(operations):
        if op == "add" and name is not None and name not in names:
            number += 1
            names.add(name)
            state[f"T-{number:02d}"] = [name, definition]
    return sorted((c, *v) for c, v in state.items())


@pytest.mark.parametrize("seed", range(4))
def test_versions_of_a_taxonomy(spark, tmp_path, seed):
    rnd = random.Random(seed)
    state = [(f"T-{i:02d}", f"n{i}", rnd.choice(["d", "", None]) and f"d{i}") for i in range(1, 13)]
    table = store.VersionedTable(spark, f"file://{tmp_path}/t", ["code"])
    table.write(spark.createDataFrame([(*r, False) for r in state], "code string, name string, definition string, gone boolean"), 0)
    states = [sorted(state)]
    code = lambda: f"T-{rnd.randint(1, 14):02d}"
    for batch in (1, 2):
        operations = [(seq, rnd.choice(["add", "merge", "modify", "merge"]), code(), code(), rnd.choice([None, f"n{rnd.randint(1, 20)}"]), rnd.choice([None, "x", f"y{seq}"])) for seq in rnd.sample(range(100), 14)]
        frame = spark.createDataFrame(operations, "seq long, op string, code string, other string, name string, definition string")
        changes = store.mutate(table.read(), frame)
        table.write(changes, batch)
        table.write(store.mutate(table.read(batch - 1), frame), batch)  # a repeated run replaces its version
        states.append(plain_mutate(states[-1], operations))
    for version, told in enumerate(states):
        assert sorted((tuple(r) for r in table.read(version).select("code", "name", "definition").collect()), key=repr) == sorted(told, key=repr)
    assert table.read().count() == len(states[-1])


def test_refinement_looks_again_at_what_changed(spark):
    needs = {1: ["a", "b", "c", "d"], 2: ["a", "b"], 3: ["z"], 4: ["known"], 5: []}
    work = spark.createDataFrame(list(needs.items()), "item long, needs array<string>")
    state = spark.createDataFrame([("known", 1)], "name string, n int")
    looked = []

    def propose(left, have):
        looked.append(sorted(r.item for r in left.collect()))
        missing = left.select("item", F.explode("needs").alias("name")).join(have.select("name").distinct(), "name", "left_anti")
        return missing.groupBy("item").agg(F.min("name").alias("name")).unionByName(missing.limit(1).select("item", F.lit("known").alias("name")))

    after, log = store.refine(work, state, propose, lambda names, have: names.where("name < 'y'"))
    assert looked == [[1, 2, 3, 4, 5], [1, 2], [1, 2]]
    assert sorted((r.item, r.attempt, r.name, r.approved) for r in log.collect()) == [(1, 1, "a", True), (1, 2, "b", True), (1, 3, "c", True), (2, 1, "a", True), (2, 2, "b", True), (3, 1, "z", False)]
    assert sorted(r.name for r in after.collect()) == ["a", "b", "c", "known"]
    assert store.refine(work.limit(0), state, propose, lambda names, have: names)[1].collect() == []


@pytest.mark.parametrize("bits", [1 << 16, 64])
def test_fresh_rows_are_those_never_taken(spark, tmp_path, bits):
    """With 64 bits the filter lets everything through and the keys decide alone."""
    rows = spark.createDataFrame([(f"k{i % 300}", i) for i in range(900)] + [(None, 900), ("", 901)], "key string, n long").repartition(3)
    taken = resume.Consumed(spark, f"file://{tmp_path}/c{bits}", bits)
    taken.add(rows.where("n < 100"), 1)
    taken.add(rows.where("n >= 50 AND n < 120"), 2)
    taken.add(rows.where("n >= 50 AND n < 120"), 2)
    found = sorted(r.n for r in taken.fresh(rows).collect())
    assert found == [r.n for r in rows.orderBy("n").collect() if r.key is None or r.key == "" or int(r.key[1:]) >= 120]
    if bits > 64:
        assert rows.where(taken.maybe(F.col("key")) & (F.col("n") >= 120) & (F.col("n") < 300)).count() < 20
    assert taken.fresh(rows.limit(0)).collect() == []


def test_replay_builds_from_the_first_stale_window(spark):
    rows = [(w, i) for w in ("2024-01", "2024-02", "2024-03", "2024-04") for i in range(5)]
    frame = lambda x: spark.createDataFrame(x, "window string, v long").repartition(3)
    chain = lambda x, p="p": resume.chained(resume.window_digests(frame(x), "window", ["v"]), p)
    status = lambda a, b: {r.window: r.status for r in resume.stale_windows(a, b).collect()}
    old = chain(rows)
    assert set(status(old, chain(list(reversed(rows)))).values()) == {"ok"}
    assert set(status(old, chain(rows, "q")).values()) == {"stale"}
    late = [*rows, ("2024-03", 3)]
    assert status(old, chain(late)) == {"2024-01": "ok", "2024-02": "ok", "2024-03": "stale", "2024-04": "stale"}
    assert status(old, chain([r for r in rows if r[0] != "2024-02"])) == {"2024-01": "ok", "2024-02": "gone", "2024-03": "stale", "2024-04": "stale"}
    assert status(old, chain([*rows, ("2024-05", 1)]))["2024-05"] == "stale"

    def build(data, state, windows):
        """Running sums with decay: each window's value is its sum plus half of the one before."""
        value, out = ([r.total for r in state.collect()] or [0.0])[0], []
        for w in windows:
            value = sum(v for x, v in data if x == w) + 0.5 * value
            out.append((w, value))
        built.append(windows)
        return spark.createDataFrame(out, "window string, total double")

    built = []
    whole = build(rows, spark.createDataFrame([], "window string, total double"), sorted({w for w, _ in rows}))
    again = resume.replay(old, chain(late), whole, lambda state, windows: build(late, state, windows))
    wanted = build(late, spark.createDataFrame([], "window string, total double"), sorted({w for w, _ in late}))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, wanted.collect())) and built[1] == ["2024-03", "2024-04"]
    assert sorted(map(tuple, resume.replay(old, old, whole, None).collect())) == sorted(map(tuple, whole.collect()))
