import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from loomgraph.llm import langid, mixing, packing, simhash, suffixdedup
from test_langid import brute_identify
from test_packing import check_bins
from test_suffixdedup import brute as brute_cuts


def documents():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices(["the", "and", "ing", "er", "on", "é", "st"], k=rnd.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(rnd.randint(60, 300))) for _ in range(80)]
    texts += [f"{t} {word()}" for t in texts[:10]] + texts[10:15] + [f"{t} {passage} {word()}" for t in texts[20:30]] + ["", None, "12345 67", passage]
    return [(i, t, ["en", "fr"][i % 2], f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]


def test_stages_match_brute_force(spark, tmp_path):
    rows = documents()
    table = pa.table(dict(zip(corpus_pipeline.COLUMNS, map(list, zip(*rows)))))
    pq.write_table(table, tmp_path / "documents.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    run = lambda k, df: corpus_pipeline.STAGES[k][1](spark, df, f"file://{tmp_path}")

    kept = sorted(map(tuple, run(0, docs).collect()), key=str)
    good = {r[0] for r in brute_identify([r[:3] for r in rows]) if r[2] != "und" and r[3] >= corpus_pipeline.LEAST_SCORE}
    assert kept == sorted((r for r in rows if r[0] in good), key=str) and not {r[0] for r in rows if r[1] in ("", None, "12345 67")} & good

    sets = {r[0]: set(simhash.shingle_hashes(r[1], 5).tolist()) for r in kept}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    second = spark.createDataFrame(kept, docs.schema)
    unique = sorted(map(tuple, run(1, second).collect()))
    assert unique == sorted(r for r in kept if find(r[0]) == r[0]) and len(unique) < len(kept)

    third = spark.createDataFrame(unique, docs.schema)
    cut = sorted(map(tuple, run(2, third).collect()))
    removed = {r[0]: r[2] for r in brute_cuts([(r[0], r[1]) for r in unique])}
    assert {r[0]: len(r[1].encode()) for r in cut}.items() <= {r[0]: len(r[1].encode()) - removed[r[0]] for r in unique}.items()
    assert sum(removed.values()) > 0 and len(cut) >= len(unique) - 5

    fourth = spark.createDataFrame(cut, docs.schema)
    mixed = Counter(r.doc_id for r in run(3, fourth).collect())
    wanted = {r.doc_id: r.copies for r in mixing.mix_sources(fourth).collect() if r.copies}
    assert mixed == wanted and max(mixed.values()) <= 2
    words = {r[0]: len(re.findall(r"\S+", r[1])) for r in cut}
    assert abs(sum(words[d] * n for d, n in mixed.items()) / sum(words.values()) - 1.5) < 0.1

    last = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert Counter(r.doc_id for r in last if r.piece == 0) == mixed
    check_bins(last, 4096)


def test_stages_take_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == corpus_pipeline.COLUMNS and docs.collect() == [], name
