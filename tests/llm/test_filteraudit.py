import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from loomgraph.llm import filteraudit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    parts = defaultdict(list)
    for doc, text, lang in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": doc is not None and least[t] < doc}
        parts[lang or ""].append(({f for f, x in fails.items() if x}, doc in good, doc in toxic))
    out = []
    for part, docs in parts.items():
        mine, total = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order):
                hit = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                total[f] += len(hit)
                alone = sum(d[0] == {f} for d in docs)
                again = sum(f in d[0] for d in docs) - len(hit)
                mine.append((part, "".join(order), step + 1, len(left), len(hit), again, alone, sum(d[1] for d in hit), sum(d[2] for d in hit)))
        out += [(*m, total[m[1][m[2] - 1]]) for m in mine]
    return sorted(out)


def rows_of(seed=1):
    rnd = random.Random(seed)
    texts = [" ".join(rnd.choice(["Alpha", "beta", "c", "D#", "gamma%", "x"]) + str(rnd.randint(0, 150)) * rnd.randint(0, 1) for _ in range(rnd.choice([0, 3, 150, 199, 200, 201, 260]))) for _ in range(30)]
    texts += [None, "", " \t\n", "É" * 300, " ".join(f"w{i}" for i in range(200)), "ABC" + "a" * 97, "ABCD" + "a" * 96]
    rows = [(rnd.randint(0, 120), rnd.choice(texts), rnd.choice(["en", "de", None, ""])) for _ in range(300)]
    rows += [(None, texts[0], "en"), (None, texts[0], "en"), (7, texts[1], "de"), (7, texts[1], "de"), (7, texts[1], "fr"), (0, texts[1], None)]
    labels = [(rnd.choice([*range(121), None]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(90)]
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "m", 1, "g") for r in rows], "doc_id long, text string, lang string, part string, n int, good string").repartition(5)
    return docs, spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")


@pytest.mark.parametrize("seed", [1, 2])
def test_every_order_by_brute_force(spark, seed):
    rows, labels = rows_of(seed)
    found = sorted(tuple(r) for r in filteraudit.audit_filters(*frames(spark, rows, labels)).select(*COLUMNS).collect())
    assert found == brute(rows, labels)


def test_sql_by_brute_force():
    rows, labels = rows_of(3)
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.sql("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    assert sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({filteraudit.AUDIT_SQL})").fetchall()) == brute(rows, labels)


def test_empty_tables(spark):
    docs, labels = frames(spark, [(1, "a", "en")], [(1, 1, 1)])
    assert filteraudit.audit_filters(docs.limit(0), labels).collect() == []
    found = filteraudit.audit_filters(docs, labels.limit(0)).collect()
    assert len(found) == 600 and {r.good_lost for r in found} == {0}


@pytest.mark.parametrize("n", range(1, 7))
def test_single_swaps_visit_every_order_once(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for i in filteraudit.single_swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert seen == set(itertools.permutations(range(n)))


def test_walk_keeps_unchanged_steps():
    rnd = np.random.default_rng(5)
    cells = rnd.integers(0, 9, (16, 3))
    walk = filteraudit.Walk(cells, "WXYZ")
    for order, steps in walk.orders():
        fresh = filteraudit.Walk(cells, "WXYZ")
        fresh.order = ["WXYZ".index(f) for f in order]
        assert steps == [fresh.step(i) for i in range(4)]
    removed = cells[1:, 0].sum()
    assert sum(walk.shapley) == 24 * removed


def test_number_of_filters_is_bounded(spark):
    with pytest.raises(ValueError):
        filteraudit.every_order(spark.createDataFrame([], "part string, mask int, good long, toxic long, n long"), "ABCDEFGHI")
