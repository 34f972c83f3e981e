"""Hand-computed values of single operators."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import dedup, graph, matching, mentions, overlay, series, vectors
from loomgraph.operators.order_stats import values_at


def test_edge_weights(spark):
    facts = spark.createDataFrame([("A", "J", "T1", "S1", "p"), ("A", "J", "T1", "S2", "p"), ("B", "J", "T1", "S2", None), ("C", "K", "T2", None, None)], "doc string, job string, task string, skill string, point string")
    freq = graph.presence_frequency(graph.documents(facts, ["doc", "job", "task"]))
    w = {(r.kind, r.src, r.dst): r.w for r in freq.collect()}
    assert w["total", "", ""] == 3 and w["skill", "S2", ""] == 2 and w["skillpoint", "p", ""] == 2  # once under each parent
    edges = {(r.src, r.dst): r.weight for r in graph.conditional_edges(freq, "job_skill").collect()}
    assert edges == {("J", "S1"): 0.5, ("J", "S2"): 1.0}


def test_decay_and_noisy_or(spark):
    rows = spark.createDataFrame([("papers", "S", "high", "2026-05-10"), ("news", "", "low", None), ("jd", "", "medium", "2027-01-01")], "source string, tier string, confidence string, d string").withColumn("date", F.col("d").cast("date"))
    as_of = F.lit("2026-05-31").cast("date")
    got = [r.c for r in rows.select(overlay.contribution(F.col("source"), F.col("tier"), F.col("confidence"), F.col("date"), as_of).alias("c")).collect()]
    assert got == pytest.approx([0.5 ** (21 / 730), 0.4 * 0.3 * 0.5, 0.6])
    strength = spark.createDataFrame([(0.5,), (0.75,), (0.0,)], "c double").agg(overlay.noisy_or(F.col("c")).alias("s")).first().s
    assert strength == 1 - 0.5 * 0.25


def test_history_chain(spark):
    now, before = (spark.createDataFrame(r, "k string, w double") for r in ([("a", 2.0)], [("a", 4.0), ("b", 1.0)]))
    assert {r.k: r.w for r in graph.merge_history(now, before, ["k"], 0.85).collect()} == pytest.approx({"a": 5.4, "b": 0.85})


def test_gap_precedence(spark):
    rows = [(None, True, False, None, 1, "LEARN"), (3, False, False, True, 1, "EVIDENCE_INSUFFICIENT"), (3, True, True, True, None, "EVIDENCE_INSUFFICIENT"), (None, True, False, True, None, "SATISFIED"), (None, True, False, True, 2, "EVIDENCE_INSUFFICIENT"), (1, True, False, True, 2, "LEVEL_GAP"), (2, True, False, True, 2, "SATISFIED")]
    df = spark.createDataFrame(rows, "observed int, verified boolean, unknown boolean, held boolean, required int, want string")
    assert df.where(matching.gap_type(*map(F.col, ("observed", "verified", "unknown", "held", "required"))) != F.col("want")).count() == 0


def test_cycle_is_an_error(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, needs string")
    with pytest.raises(ValueError):
        matching.levels(edges.select("id"), edges)
    with pytest.raises(ValueError):
        spark.createDataFrame([(0, [1.0])] * 2, "g int, v array<double>").count() and vectors._matrix(__import__("pandas").DataFrame({"v": [[0.0]] * 2001}), "v")


def test_labels(spark):
    df = spark.createDataFrame([("2024-01",), ("2024-11",), ("2024-Q1",), ("2024-Q3",)], "l string")
    assert [r.p for r in df.select(series.previous_label(F.col("l")).alias("p")).collect()] == ["2023-12", "2024-10", "2023-Q4", "2024-Q2"]


def test_mentions_and_sections(spark):
    df = spark.createDataFrame([("Java and JavaScript, Spark SQL",)], "t string")
    assert df.select(mentions.longest_mentions(F.col("t"), ["Java", "JavaScript", "Spark", "Spark SQL", "SQL"]).alias("m")).first().m == ["Java", "JavaScript", "Spark SQL"]
    text = spark.createDataFrame([("intro\nDuties:\nwork\nPerks:\ncake\nmore",), ("Perks:\nonly",)], "t string")
    kept = [r.k for r in text.select(T.sections(F.col("t"), {"resp": "Duties:", "other": "Perks:"}, "other").alias("k")).collect()]
    assert kept == ["intro\nwork\n", "Perks:\nonly"]


def test_stars_in_order_of_ids(spark):
    rnd = random.Random(3)
    links = sorted({tuple(sorted(rnd.sample(range(60), 2), reverse=True)) for _ in range(90)})
    root = {}
    for i in range(60):
        earlier = sorted(b for a, b in links if a == i)
        root[i] = next((b for b in earlier if root[b] == b), i)
    touched = {x for p in links for x in p}
    found = {r.doc: r.root for r in dedup.star_clusters(spark.createDataFrame(links, "later long, earlier long")).collect()}
    assert found == {i: root[i] for i in touched}


def test_near_pairs(spark):
    base = "the quick brown fox jumps over the lazy dog while nobody on the farm is looking at it " * 8
    rows = [(1, base + "end"), (2, base + "enx"), (3, "something else entirely, " * 20), (4, base + "end"), (5, None), (6, "short")]
    pairs = dedup.near_pairs(spark.createDataFrame(rows, "doc_id long, t string"), "doc_id", F.col("t")).collect()
    assert [tuple(p) for p in pairs] == [(2, 1)]


def test_layout_recovers_distances():
    points = np.random.default_rng(1).normal(size=(12, 2))
    distances = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    x, stress = vectors.smacof(distances, vectors.classical_mds(distances))
    assert np.allclose(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), distances, atol=1e-6) and stress < 1e-6
    blobs = np.concatenate([np.random.default_rng(k).normal(8 * k, 0.3, size=(10, 3)) for k in range(4)])
    owner = vectors.search_clusters(blobs)
    assert len(set(owner)) == 4 and all(len(set(owner[10 * k : 10 * k + 10])) == 1 for k in range(4))


def test_stars_of_a_long_chain(spark):
    """Each text is near only the one before it: every other one is a root, however long the chain is."""
    for n, ordered in ((130, dedup.ORDERED), (7, 0)):
        links = spark.createDataFrame([(i, i - 1) for i in range(1, n)], "later long, earlier long")
        assert {r.doc: r.root for r in dedup.star_clusters(links, ordered).collect()} == {i: i - i % 2 for i in range(n)}


def test_near_members_take_all_copies(spark):
    base = "the quick brown fox jumps over the lazy dog while nobody on the farm is looking at it " * 8
    only = "something else entirely, " * 20
    rows = [(1, base + "end"), (2, base + "enx"), (3, only), (4, base + "end"), (5, None), (6, "short"), (7, base + "enx"), (8, only), (9, only), (10, "short")]
    members = dedup.near_members(spark.createDataFrame(rows, "doc_id long, t string"), "doc_id", F.col("t"))
    assert {r.doc: r.root for r in members.collect()} == {1: 1, 2: 1, 4: 1, 7: 1, 3: 3, 8: 3, 9: 3, 5: 5, 6: 6, 10: 10}
    assert tuple(dedup.cluster_stats(members).first()) == (2, 7, 4, 5)


def test_wrapped_copies_are_near(spark):
    rnd = random.Random(5)
    base = " ".join("".join(rnd.choices("abcdefghij", k=5)) for _ in range(120))
    wrapped = "\n\u3000".join(base[k : k + 40] for k in range(0, len(base), 40))
    edited = wrapped[:-3] + "xyz"
    docs = spark.createDataFrame([(1, base), (2, wrapped), (3, edited), (4, " \n" * 60), (5, " \t" * 60 + "ab")], "doc_id long, t string")
    assert {r.doc: r.root for r in dedup.near_members(docs, "doc_id", F.col("t")).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert docs.where("doc_id < 3").select(dedup.solid(F.col("t"))).distinct().count() == 1


def test_evidence_of_terms_in_many_documents(spark, tmp_path):
    from loomgraph.plans import text_queries

    rows = [(i, f"Opening words number{i}! Then the grapple came! Later grapple again!" if i % 20 == 0 else f"Filler about banana{i % 2}! Nothing else!", "s", "en") for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"file://{tmp_path}/documents.parquet")
    found = text_queries.evidence_pool(spark, f"file://{tmp_path}").collect()
    assert {(r.doc_id, r.sentence) for r in found if r.term == "grapple"} == {(i, "Then the grapple came!") for i in (0, 20, 40)}
    assert {"grapple", "later"} <= {r.term for r in found} and not {"banana0", "filler"} & {r.term for r in found}


def test_deep_graphs_and_cycles(spark, monkeypatch):
    monkeypatch.setattr(matching, "KEPT", 4)
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 10)], "id int, needs int")
    nodes = spark.range(10).selectExpr("int(id) AS id")
    assert {(r.id, r.level) for r in matching.levels(nodes, chain).collect()} == {(i, i) for i in range(10)}
    assert matching.prerequisite_closure(chain, nodes.where("id = 9")).count() == 10
    circle = chain.unionByName(spark.createDataFrame([(0, 9)], "id int, needs int"))
    for run in (lambda: matching.levels(nodes, circle), lambda: matching.prerequisite_closure(circle, nodes.where("id = 3"))):
        with pytest.raises(ValueError, match="cycle"):
            run()


def test_values_at_ranks(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, 1.0, 2.0, rnd.random() * 1e6])) for _ in range(500)] + [("c", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {r.g: (r.n, r.low, r.high) for r in values_at(df, "v", ["g"], {"low": F.floor((F.col("n") - 1) / 2), "high": F.floor(F.col("n") / 2)}).collect()}
    for g in ("a", "b", None, "c"):
        v = sorted(x for h, x in rows if h == g and x is not None)
        assert found[g] == (len(v), v[(len(v) - 1) // 2], v[len(v) // 2])


def test_neighbours_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES", 3)
    monkeypatch.setattr(vectors, "ROWS", 17)
    rnd = random.Random(4)
    rows = [(i, [float(rnd.randint(-2, 2)) for _ in range(4)]) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found = {(r.query, r["rank"]): r.id for r in vectors.top_k_similar(df, df.where("id % 10 = 0"), "id", "v", 3).collect()}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (norm(a) * norm(b)), 6) if norm(a) * norm(b) else 0.0
    for q in range(0, 100, 10):
        best = sorted((-cos(rows[q][1], v), i) for i, v in rows if i != q)[:3]
        assert [found[q, k] for k in (1, 2, 3)] == [i for _, i in best]


def test_ranks_with_heavy_tails_and_signs(spark):
    rnd = random.Random(5)
    values = [rnd.choice([rnd.gauss(0, 1), rnd.gauss(0, 1) * 10 ** rnd.randint(-300, 300), 0.0, -0.0, 7.5]) for _ in range(700)] + [1e308, float("inf"), float("-inf")]
    rows = [("a", v) for v in values] + [("b", 3.0)] * 900 + [(None, -1.0), ("c", None), ("a", None)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(3)
    found = {r.k: r for r in values_at(frame, "v", ["k"], {"low": F.floor((F.col("n") - 1) / 2), "last": F.col("n") - 1, "first": F.lit(0)}).collect()}
    own = sorted(values)
    assert (found["a"].n, found["a"]["first"], found["a"].low, found["a"].last) == (len(own), own[0], own[(len(own) - 1) // 2], own[-1])
    assert (found["b"].n, found["b"].low) == (900, 3.0) and (found[None].n, found[None].last) == (1, -1.0) and set(found) == {"a", "b", None}


def test_vectors_that_cannot_be_compared_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, []), (7, [0.0, 0.0]), (None, [1.0, 0.0]), (8, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    found = sorted(tuple(r) for r in vectors.top_k_similar(frame, frame.where("id IN (1, 3, 4, 5, 6, 7)"), "id", "v", 2).collect())
    assert found == [(1, 2, 0.995037, 1), (1, 7, 0.0, 2), (7, 1, 0.0, 1), (7, 2, 0.0, 2)]
    assert vectors.top_k_similar(frame.limit(0), frame, "id", "v", 2).collect() == []


def test_similar_sets_share_a_key_and_others_do_not():
    """Any two sets of 0.95 or more share a key, whatever their sizes; sets that only have most of their items in common don't."""
    rnd = np.random.default_rng(7)
    for n in [1, 2, 3, 19, 20, 21, 39, 40, 41, 60, 100, 333, 1000]:
        for _ in range(40):
            a = np.unique(rnd.integers(0, 1 << 62, n))
            gone = rnd.integers(0, len(a) // 20 + 1)
            b = np.unique(np.r_[a[gone:], rnd.integers(0, 1 << 62, rnd.integers(0, len(a) // 20 + 1))])
            if len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.95:
                assert np.intersect1d(dedup.similarity_keys(a, 0.95), dedup.similarity_keys(b, 0.95)).size
    keys = [dedup.similarity_keys(np.unique(rnd.integers(0, 2000, 2000)), 0.95) for _ in range(200)]
    assert len(np.unique(np.concatenate(keys))) > 0.99 * sum(map(len, keys))


def test_near_pairs_are_those_of_all_pairs(spark):
    rnd = random.Random(11)
    texts = []
    for _ in range(12):
        words = ["".join(rnd.choices("abcdeé漢", k=rnd.randint(3, 9))) for _ in range(rnd.choice((20, 60, 200)))]
        for edits in (0, 1, 2, 4, 9):
            own = list(words)
            for k in rnd.sample(range(len(own)), edits):
                own[k] = own[k][::-1]
            texts.append(" ".join(own))
    texts = list(dict.fromkeys(t for t in texts if len(t) >= 80))
    pairs = {tuple(p) for p in dedup.near_pairs(spark.createDataFrame(list(enumerate(texts)), "d long, t string"), "d", F.col("t")).collect()}
    solid = [t.replace(" ", "") for t in texts]
    sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in solid]
    bits = [dedup.simhash64(t) for t in solid]
    near = {(i, j) for i in range(len(texts)) for j in range(i) if solid[i] != solid[j] and len(sets[i] & sets[j]) >= 0.95 * len(sets[i] | sets[j]) and ((bits[i] ^ bits[j]) & (2**64 - 1)).bit_count() <= 6}
    assert pairs == near and len(near) > 5
    assert dedup._simhashes(pa.array([*solid, None, "ab", ""])).to_pylist() == [*bits, None, dedup.simhash64("ab"), dedup.simhash64("")]


def test_sketches_bound_what_is_verified(spark, monkeypatch):
    """Texts of a family that are somewhat alike share keys and bits, but few of their pairs are verified on the texts; no near pair is lost."""
    rnd = random.Random(2)
    base = ["".join(rnd.choices("abcdefghijklmnopqrst", k=6)) for _ in range(220)]
    texts = []
    for _ in range(60):
        own = list(base)
        for k in rnd.sample(range(len(own)), rnd.choice((1, 4, 6))):
            own[k] = own[k][::-1]
        texts.append(" ".join(own))
    texts = list(dict.fromkeys(texts))
    sets = [np.unique(dedup._gram_codes(t.replace(" ", ""))) for t in texts]
    keys = [set(dedup.similarity_keys(g, 0.95).tolist()) for g in sets]
    bits = [dedup.simhash64(t.replace(" ", "")) for t in texts]
    met = {(i, j) for i in range(len(texts)) for j in range(i) if keys[i] & keys[j] and ((bits[i] ^ bits[j]) & (2**64 - 1)).bit_count() <= 6}
    similar = {(i, j) for i, j in met if len(np.intersect1d(sets[i], sets[j])) >= 0.95 * len(np.union1d(sets[i], sets[j]))}
    for i, j in met:
        differ = np.bitwise_count((dedup.sketch(sets[i]) ^ dedup.sketch(sets[j])).view(np.uint64)).sum()
        assert differ <= len(np.setxor1d(sets[i], sets[j]))
    written, settle = {}, dedup.settle
    monkeypatch.setattr(dedup, "settle", lambda df, name="interim": written.setdefault(name, settle(df, name)))
    pairs = {tuple(p) for p in dedup.near_pairs(spark.createDataFrame(list(enumerate(texts)), "d long, t string"), "d", F.col("t")).collect()}
    verified = written["near"].count()
    assert pairs == similar and len(similar) > 20
    assert len(similar) <= verified < len(similar) + (len(met) - len(similar)) / 4


def test_texts_of_one_id_are_their_own(spark):
    """Of two texts under one id, only the one that is the first of its copies is near anything."""
    rnd = random.Random(4)
    one, two = (" ".join("".join(rnd.choices("abcdefghij", k=5)) for _ in range(120)) for _ in range(2))
    rows = [(3, one), (5, one), (5, two), (7, two[:-3] + "xyz"), (9, one[:-3] + "xyz"), (9, one[:-3] + "xyz")]
    pairs = dedup.near_pairs(spark.createDataFrame(rows, "d long, t string"), "d", F.col("t")).collect()
    assert sorted(map(tuple, pairs)) == [(7, 5), (9, 3)]


def test_blocks_of_vectors_take_little_memory():
    rnd = np.random.default_rng(1)
    table = lambda n: pa.table({"id": pa.array(range(n)), "v": pa.array(list(rnd.normal(size=(n, 8))), pa.list_(pa.float64()))})
    asked, rows = table(1000), table(4096)
    tracemalloc.start()
    found = vectors._best(2, ("id", "v"))(asked, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 2000 and peak < 30e6  # one matrix of all queries and rows is 33 MB
