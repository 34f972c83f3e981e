import corpus_pipeline
from loomgraph.llm import simhash
from test_pipeline import documents


def test_near_duplicates_are_all_pairs_of_the_similarity(spark):
    """Plain Jaccard of 0.8 or more over five-word shingles, whatever the fingerprints say."""
    rows = [r for r in documents() if len((r[1] or "").split()) > 5]
    prints = {r[0]: simhash.fingerprint(r[1]) for r in rows}
    sets = {r[0]: set(simhash.shingle_hashes(r[1], 5).tolist()) for r in rows}
    alike = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    least = {i: i for i in sets}
    for _ in sets:
        for i, j in alike:
            least[i] = least[j] = min(least[i], least[j])
    assert any(((prints[i] ^ prints[j]) % 2**64).bit_count() > 7 for i, j in alike)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, "").collect()))
    assert kept == sorted(r for r in rows if least[r[0]] == r[0])
