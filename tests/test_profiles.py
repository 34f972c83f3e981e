"""A job profile by hand."""

from loomgraph.operators import profiles

EDGES = [
    ("job_skill", "J1", "S1", 0.4, 0.2, 0.9), ("job_skill", "J2", "S1", 0.2, 0.0, 0.5), ("job_skill", "J1", "S2", 0.0001, 0.0, 0.5), ("job_skill", "X", "S1", 9.0, 0.0, 0.1),
    ("job_task", "J1", "T1", 0.5, 0.0, 0.8), ("task_skill", "T1", "S1", 0.3, 0.0, 0.8), ("task_skill", "T1", "S9", 0.1, 0.0, 0.8),
    ("skill_skillpoint", "S1", "P1", 0.3, 0.0, 0.7), ("skill_skillpoint", "S1", "P2", 0.0, 0.002, 0.6), ("skill_skillpoint", "S2", "P1", 0.3, 0.0, 0.7),
]


def test_profile(spark):
    edges = spark.createDataFrame(EDGES, "relation string, src string, dst string, base double, delta double, confidence double")
    scopes = spark.createDataFrame([("all", "J1"), ("all", "J2"), ("all", "J2"), ("two", "J2"), ("none", None)], "scope string, job string")
    tilts = spark.createDataFrame([("S1", 1.5)], "skill string, tilt double")
    found = {(r.scope, r.kind, r.parent, r.id): tuple(round(x, 9) for x in (r.demand, r.forward_share, r.confidence)) for r in profiles.job_profile(scopes, edges, tilts, 0.5).collect()}
    one, two = (0.4 + 0.1) * 1.5, 0.2 * 1.5
    demand, share, sure = (one + two) / 2, 0.1 / (one + two), (0.9 * one + 0.5 * two) / (one + two)
    task = 0.5 * (1.5 * 0.3 + 1.0 * 0.1) / 0.4 / 2
    part = 0.3 / 0.31
    wanted = {
        ("all", "skill", None, "S1"): (demand, share, sure),
        ("all", "task", None, "T1"): (task, 0.0, 0.8),
        ("all", "skillpoint", "S1", "P1"): (demand * part, share, (sure + 0.7) / 2),
        ("all", "skillpoint", "S1", "P2"): (demand * (1 - part), 1.0, (sure + 0.6) / 2),
        ("two", "skill", None, "S1"): (two, 0.0, 0.5),
        ("two", "skillpoint", "S1", "P1"): (two * part, 0.0, 0.6),
        ("two", "skillpoint", "S1", "P2"): (two * (1 - part), 1.0, 0.55),
    }
    assert found == {k: tuple(round(x, 9) for x in v) for k, v in wanted.items()}
    assert profiles.job_profile(scopes.limit(0), edges, tilts, 0.5).collect() == []
