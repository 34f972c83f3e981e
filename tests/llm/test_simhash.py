import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from loomgraph.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(x for x in (least.get(find(i)), doc) if x is not None) if doc is not None or find(i) in least else None
    return sorted(((doc, f"{fps[i]:016x}", least[find(i)]) for i, (doc, _) in enumerate(rows)), key=str)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2**64 == brute_fingerprint(text)


def test_components_match_brute_force(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "É x y")]
    for i in range(6, 150):
        if i % 3 and i > 8:
            text = rnd.choice(rows[6:])[1].split()
            for _ in range(rnd.randint(0, 2)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            rows.append((i, " ".join(text)))
        else:
            rows.append((i, " ".join(rnd.choices(words, k=rnd.randint(3, 400)))))
    rows.append((10, rows[10][1]))
    rows.append((None, "alone among nulls"))
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, root int").repartition(5)
    found = sorted((tuple(r) for r in simhash.simhash_components(docs).collect()), key=str)
    assert found == brute_components(rows)


@pytest.mark.parametrize(("distance", "small"), [(3, 64), (3, 2)])
def test_links_between_random_fingerprints(spark, monkeypatch, distance, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for f in base:
        for _ in range(10):
            g = f
            for b in rnd.sample(range(64), rnd.randint(1, distance + 2)):
                g ^= 1 << b
            fps.add(g)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance).collect()
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        assert ((u ^ v) % 2**64).bit_count() <= distance
        root[find(u)] = find(v)
    for u in signed:
        for v in signed:
            if ((u ^ v) % 2**64).bit_count() <= distance:
                assert find(u) == find(v)


def test_empty_table(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_verified_links(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(40):
        base = rnd.choices(words, k=300)
        rows.append((2 * i, " ".join(base)))
        for k in rnd.sample(range(300), rnd.choice([1, 3, 6, 20])):
            base[k] = rnd.choice(words)
        rows.append((2 * i + 1, " ".join(base)))
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(296)} for d, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in simhash.simhash_components(docs, verify=(5, 0.8)).collect()}
    alike = {d: len(sets[d] & sets[d - 1]) / len(sets[d] | sets[d - 1]) for d in sets if d % 2}
    assert all(found[d] == d for d in found if d % 2 == 0) and all(found[d] in (d, d - 1) for d in found)
    assert not any(found[d] == d - 1 for d, j in alike.items() if j < 0.8)
    close = [d for d, j in alike.items() if j >= 0.8]
    assert close and all(found[d] == d - 1 for d in close)


@pytest.mark.parametrize("small", [64, 2])
def test_verified_links_in_dense_runs(spark, monkeypatch, small):
    """Families whose members are all near in bits but not all alike: no link that joins two components is missed."""
    monkeypatch.setattr(simhash, "SMALL", small)
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(9000)]
    rows = []
    for _ in range(4):
        base = rnd.choices(words, k=900)
        for _ in range(14):
            text = list(base)
            for k in rnd.sample(range(900), rnd.randint(6, 16)):
                text[k] = rnd.choice(words)
            rows.append((len(rows), " ".join(text)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(896)} for _, t in rows]
    least = list(range(len(rows)))
    near = [(i, j) for i in range(len(rows)) for j in range(i) if i // 14 == j // 14]
    alike = [(i, j) for i, j in near if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in rows:
        for i, j in alike:
            least[i] = least[j] = min(least[i], least[j])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in simhash.simhash_components(docs, verify=(5, 0.8)).collect()}
    assert found == dict(enumerate(least)) and len(alike) < len(near)


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=6), max_size=6))
def test_whole_runs(batches):
    """Runs come whole and in order, however the batches cut them; no piece is empty."""
    keys = sorted(k for b in batches for k in b)
    at, dealt = 0, []
    for b in batches:
        dealt.append(pa.record_batch({"key": pa.array(keys[at : at + len(b)], pa.int64()), "n": pa.array(range(at, at + len(b)), pa.int64())}))
        at += len(b)
    pieces = list(simhash._whole_runs(iter(dealt)))
    assert [k for p in pieces for k in p[0]] == keys and [n for p in pieces for n in p[1]] == list(range(len(keys)))
    assert all(len(p[0]) for p in pieces) and all(a[0][-1] < b[0][0] for a, b in zip(pieces, pieces[1:]))


def test_verified_links_beyond_the_distance(spark):
    """Plain Jaccard of 0.8 or more links, also where fingerprints are far apart."""
    rnd = random.Random(21)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for _ in range(120):
        base = rnd.choices(words, k=300)
        rows.append((len(rows), " ".join(base)))
        for k in rnd.sample(range(300), rnd.randint(4, 8)):
            base[k] = rnd.choice(words)
        rows.append((len(rows), " ".join(base)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(296)} for _, t in rows]
    prints = [simhash.fingerprint(t) for _, t in rows]
    least = {d: d - 1 if d % 2 and len(sets[d] & sets[d - 1]) >= 0.8 * len(sets[d] | sets[d - 1]) else d for d in range(len(rows))}
    assert any(((prints[d] ^ prints[r]) % 2**64).bit_count() > 7 for d, r in least.items()) and any(d % 2 and d == r for d, r in least.items())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in simhash.simhash_components(docs, verify=(5, 0.8)).collect()} == least


@pytest.mark.parametrize(("small", "sample", "split"), [(64, 8192, 4096), (2, 8192, 4096), (64, 4, 4096), (2, 4, 7), (64, 8192, 5)])
def test_prefix_links_miss_no_pair(spark, monkeypatch, small, sample, split):
    """Short texts of few words, whose shingles nearly all occur often, and longer ones: every pair of 0.8 or more is among the
    candidates, whatever the sample tells of common shingles and however they are split."""
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "SAMPLE", sample)
    monkeypatch.setattr(simhash, "SPLIT", split)
    rnd = random.Random(small)
    texts = [" ".join(rnd.choices("ab", k=rnd.randint(1, 24))) for i in range(120)]
    for _ in range(40):
        base = rnd.choices("abcdefghij", k=rnd.randint(20, 60))
        texts += [" ".join(base), " ".join([*base[: rnd.randint(18, 60)], rnd.choice("abcd")])]
    rows = [(i, i // 3, t) for i, t in enumerate(texts)]
    sets = [set(simhash.shingle_hashes(t, 3).tolist()) for t in texts]
    n = len(rows)
    alike = {(i, j) for j in range(n) for i in range(j) if i // 3 != j // 3 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    docs = spark.createDataFrame(rows, "node long, root long, text string")
    told = simhash.common_shingles(docs, n, 3, 0.8)
    found = simhash.prefix_links(docs, told, 3, 0.8).collect()
    assert alike <= {(r.u, r.v) for r in found} and len(alike) > 30
    assert all((r.root_u, r.root_v) == (r.u // 3, r.v // 3) and r.shared > 0 for r in found)


def test_sketches_never_tell_too_few():
    """Sets of all sizes, nested, equal or apart, with members that crowd in one place: the bound holds and tells unlike sets apart."""
    rnd = np.random.default_rng(3)
    pool = rnd.integers(-(2**63), 2**63, 40_000, np.int64)
    crowd = np.unique(pool[:400] << 16)
    for size in (0, 1, 63, 64, 300, 5000):
        one = np.unique(pool[:size])
        for other in (one, pool[size : 2 * size], pool[size // 2 : size * 3 // 2], pool[: 2 * size], np.r_[pool[:size], crowd], crowd):
            other = np.unique(other)
            shared = len(np.intersect1d(one, other))
            assert simhash.most_shared(simhash.sketch(one), simhash.sketch(other)) >= shared
    assert simhash.most_shared(simhash.sketch(pool[:300]), simhash.sketch(pool[300:600])) < 240


def test_possible_links_keep_all_alike(spark):
    base = [f"w{i}" for i in range(60)]
    texts = {1: base, 2: [*base[:57], "x"], 3: base[30:] + [f"y{i}" for i in range(30)], 4: [], 5: [f"z{i}" for i in range(3)]}
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()] + [(1, " ".join(base))], "node long, text string")
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts if a < b], "u long, v long")
    assert (1, 2) in {tuple(r) for r in simhash.possible_links(pairs, docs, 5, 0.8).collect()}
    assert {tuple(r) for r in simhash.possible_links(pairs, docs, 5, 0.8).collect()} == {(1, 2)}
    assert simhash.possible_links(pairs.limit(0), docs, 5, 0.8).collect() == []


def test_nearest_links_grow_with_the_texts(spark):
    """A group of texts that all share a passage: a few pairs for each text, none within a root, the nearest fingerprints among them."""
    rnd = random.Random(5)
    base = rnd.choices([f"w{i}" for i in range(500)], k=120)
    texts = [" ".join([*base[:at], f"x{i}", *base[at + 1 :]]) for i, at in enumerate(rnd.choices(range(120), k=150))]
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    told = simhash.common_shingles(docs, len(texts), 5, 0.8)
    few = simhash.filed_under_few(docs, told, 5, 0.8)
    prints = [simhash.fingerprint(t) for t in texts]
    roots = spark.createDataFrame([(i, i % 100, prints[i]) for i in range(150)], "node long, root long, fp long")
    found = {tuple(r) for r in simhash.nearest_links(few, roots, 0.8).collect()}
    assert 0 < len(found) <= 150 * simhash.FEW * simhash.NEAREST and all(u % 100 != v % 100 for u, v in found)
    assert simhash.nearest_links(few.limit(0), roots, 0.8).collect() == []


def test_one_of_each_keeps_every_text_that_is_no_copy(spark, monkeypatch):
    """Different texts under one id, copies under several, repeated rows, null ids; 64-bit numbers that clash change nothing."""
    rnd = random.Random(9)
    base = [" ".join(rnd.choices([f"w{i}" for i in range(500)], k=120)) for _ in range(8)]
    rows = [(7, t, "s", i) for i, t in enumerate(base)] + [(9, f"{base[2]} more", "s", 0), (3, base[4], "s", 0), (3, base[4], "a", 5), (3, base[4], "a", 5), (None, base[1], "s", 0), (None, base[1], "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(4)
    wanted = sorted([r for r in rows if r[0] == 7 and r[1] != base[4]] + [(3, base[4], "a", 5)] + [r for r in rows if r[0] is None], key=str)
    assert sorted((tuple(r) for r in simhash.one_of_each(docs, 5, 0.8).collect()), key=str) == wanted
    assert simhash.one_of_each(docs.limit(0), 5, 0.8).collect() == []
    # numbers of two bits: nearly all texts clash, and the second hash tells them apart
    short = lambda text, clashes=(): simhash._told_apart(F.pmod(F.xxhash64(text), F.lit(4)), F.xxhash64(F.lit(1), text), clashes)
    monkeypatch.setattr(simhash, "text_nodes", short)
    assert sorted((tuple(r) for r in simhash.one_of_each(docs, 5, 0.8).collect()), key=str) == wanted
