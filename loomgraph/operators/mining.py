"""Counting texts: duplicates, document frequencies, n-grams, candidate terms, TF-IDF, near copies."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomgraph.sources.interim import at_hand, dealt, fits, settle

_NO_WORD = re.compile("[^a-z0-9]+")


def keep_first(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key by a unique order; a minimum, so it is aggregated before the shuffle."""
    firsts = rows.groupBy(key.alias("_k")).agg(F.min(order).alias(order)).drop("_k")
    return rows.join(firsts, order, "left_semi")


def duplicate_stats(rows: DataFrame, key: Column) -> DataFrame:
    """One row: rows, distinct, groups with copies, extra rows, largest group."""
    groups = rows.groupBy(key.alias("_k")).agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct"), F.sum((F.col("n") > 1).cast("long")).alias("groups"), F.sum(F.col("n") - 1).alias("extra"), F.max("n").alias("largest"))


def document_frequency(rows: DataFrame, tokens: Column) -> DataFrame:
    """(token, df): documents that hold a token at least once."""
    return rows.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def frequent_ngrams(rows: DataFrame, doc: str, words: Column, least: int, longest: int) -> DataFrame:
    """(gram, size, df) of word n-grams of 1..longest words that `least` documents or more hold.

    Level by level. Grams are counted within a task before they are shuffled, so what is dealt is a task's distinct grams. While the frequent
    grams of the level before are few enough to be sent to every executor, a gram without two frequent parts isn't counted at all; it
    couldn't be frequent, so beyond that size they are all counted. Every level reads the rows once.
    """
    found = rows.select(F.explode(F.array(words)).alias("w"))  # made once a row, not for each of its grams
    grams = lambda k: F.transform(
        F.when(F.size("w") >= k, F.sequence(F.lit(0), F.size("w") - k)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice("w", i + 1, k), " ")
    )
    frequent, out = None, None
    for k in range(1, longest + 1):
        level = found.select(F.explode(F.array_distinct(grams(k))).alias("gram"))
        if frequent is not None and fits(frequent, "gram"):
            parts = F.broadcast(frequent.select("gram"))
            level = level.withColumn("a", F.regexp_replace("gram", r" [^ ]*$", "")).withColumn("b", F.regexp_replace("gram", r"^[^ ]* ", ""))
            level = level.join(parts.withColumnRenamed("gram", "a"), "a", "left_semi").join(parts.withColumnRenamed("gram", "b"), "b", "left_semi")
        frequent = settle(level.groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df") >= least), "grams")
        part = frequent.select("gram", F.lit(k).alias("size"), "df")
        out = part if out is None else out.unionByName(part)
    return out


def reduce_substrings(grams: DataFrame, ratio: float) -> DataFrame:
    """Drop a gram that is part of one a word longer whose document frequency is nearly its own (df <= ratio * longer's)."""
    longer = grams.select(F.explode(F.array(F.regexp_replace("gram", r" [^ ]*$", ""), F.regexp_replace("gram", r"^[^ ]* ", ""))).alias("gram"), F.col("df").alias("longer_df"))
    best = longer.groupBy("gram").agg(F.max("longer_df").alias("longer_df"))
    return grams.join(best, "gram", "left").where(F.col("longer_df").isNull() | (F.col("df") > ratio * F.col("longer_df"))).drop("longer_df")


def _first_places(sentences: pa.Array) -> pa.Array:
    """(term, pos) of the distinct words of a document's sentences, each at the first sentence that holds it."""
    out = []
    for own in sentences.to_pylist():
        places: dict[str, int] = {}
        for at, sentence in enumerate(own or ()):
            for word in _NO_WORD.split(sentence):
                places.setdefault(word, at)
        out.append([{"term": w, "pos": at} for w, at in places.items()])
    return pa.array(out, pa.list_(pa.struct([("term", pa.string()), ("pos", pa.int32())])))


def first_sentences(docs: DataFrame, doc: str, sentence_list: Column, terms: DataFrame, cap: int) -> DataFrame:
    """(term, doc, sentence): the first sentence of each document that holds the term as a word, for `cap` documents a term.

    A document's words are made distinct in its row and only (term, doc) is dealt, of which each task keeps the first `cap` documents of a term; sentences
    are read again, of the documents that are left.
    """
    terms = settle(terms.select("term").distinct(), "terms")
    read = docs.select(doc, F.explode(F.array(sentence_list)).alias("_s"))
    places = F.arrow_udf(_first_places, "array<struct<term: string, pos: int>>")(F.transform("_s", lambda s: F.lower(s)))
    held = read.select(doc, F.explode(F.transform(places, lambda p: p["term"])).alias("term")).join(at_hand(terms, "term"), "term", "left_semi")
    nth = F.dense_rank().over(Window.partitionBy("term").orderBy(doc))
    wanted = settle(held.withColumn("_r", nth).where(F.col("_r") <= cap).select("term", F.col(doc).alias("_doc")).distinct(), "wanted")
    by_doc = wanted.groupBy("_doc").agg(F.collect_set("term").alias("_terms"))
    by_doc = F.broadcast(by_doc) if fits(wanted, "term") else by_doc
    left = read.join(by_doc, F.col(doc).eqNullSafe(F.col("_doc"))).withColumn("_p", F.explode(F.filter(places, lambda p: F.array_contains("_terms", p["term"]))))
    return left.select(F.col("_p.term").alias("term"), doc, F.col("_p.pos").alias("pos"), F.get("_s", F.col("_p.pos")).alias("sentence")).groupBy("term", doc).agg(F.min_by("sentence", "pos").alias("sentence"))


def tfidf(rows: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """(doc, token, weight): unit vectors of (1 + ln tf) * ln((N + 1) / (df + 0.5))."""
    tf = rows.select(doc, F.explode(tokens).alias("token")).groupBy(doc, "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    n = rows.agg(F.count("*").alias("n"))
    raw = tf.join(df, "token").join(F.broadcast(n)).withColumn("w", (1 + F.log("tf")) * F.log((F.col("n") + 1) / (F.col("df") + 0.5)))
    norm = raw.groupBy(doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, doc).where("norm > 0").select(doc, "token", (F.col("w") / F.col("norm")).alias("weight"))


#: Queries and vectors of one block.
QUERIES, ROWS = 16_384, 8192


def _postings(vectors: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row number, token and weight of each entry of the rows' vectors."""
    own = vectors.combine_chunks()
    own = pa.concat_arrays(own.chunks) if isinstance(own, pa.ChunkedArray) else own
    entries = own.flatten()
    return np.repeat(np.arange(len(own)), pc.list_value_length(own).to_numpy(zero_copy_only=False)), entries.field("token"), entries.field("weight").to_numpy(zero_copy_only=False)


def _best_sparse(k: int, doc: str, kind: pa.DataType):
    def best(asked: pa.Table, rows: pa.Table) -> pa.Table:
        """The k vectors of a block nearest to each of its queries, of those that share a token with it; ties to the smaller id."""
        found = [[], [], []]
        if len(asked) and len(rows):
            rows = rows.take(pc.sort_indices(rows[doc]))
            (q, q_tokens, q_weights), (d, d_tokens, d_weights) = _postings(asked["v"]), _postings(rows["v"])
            codes = pa.concat_arrays([d_tokens, q_tokens]).dictionary_encode().indices.to_numpy()
            by_token = np.argsort(codes[: len(d)], kind="stable")
            d, d_weights, q_codes = d[by_token], d_weights[by_token], codes[len(d) :]
            bounds = np.searchsorted(codes[: len(d)][by_token], np.arange(codes.max(initial=-1) + 2))
            itself, last = pc.index_in(asked[doc], value_set=rows[doc].combine_chunks()).to_pylist(), np.searchsorted(q, np.arange(len(asked) + 1))
            for i in range(len(asked)):
                terms = [(slice(bounds[c], bounds[c + 1]), w) for c, w in zip(q_codes[last[i] : last[i + 1]], q_weights[last[i] : last[i + 1]])]
                if not terms:
                    continue
                held = np.concatenate([d[s] for s, _ in terms])
                scores = np.bincount(held, np.concatenate([d_weights[s] * w for s, w in terms]), len(rows))
                near = np.flatnonzero(np.bincount(held, minlength=len(rows)))
                near = near[near != itself[i]] if itself[i] is not None else near
                ranked = np.round(scores[near], 9)
                if len(near) > k:
                    enough = ranked >= np.partition(ranked, len(near) - k)[len(near) - k]
                    near, ranked = near[enough], ranked[enough]
                near = near[np.lexsort((near, -ranked))][:k]
                for column, values in zip(found, (np.full(len(near), i), near, scores[near])):
                    column.append(values)
        i, j, scores = (np.concatenate(c) if c else np.zeros(0) for c in found)
        ids = lambda t, at: t[doc].combine_chunks().take(pa.array(at.astype(np.int64))).cast(kind)
        return pa.table([ids(asked, i), ids(rows, j), pa.array(scores, pa.float64())], ["query", doc, "score"])

    return best


def sparse_cosine_top_k(vectors: DataFrame, doc: str, queries: DataFrame, k: int) -> DataFrame:
    """(query, doc, score) of the k most similar vectors to each query vector, of those that share a token with it.

    Queries and vectors come in blocks, as in `vectors.top_k_similar`: a pair of blocks is one task's, which adds up the postings of a query's tokens and
    leaves k rows a query. No pair of a query and a vector is a row. All are compared, so the time grows with queries times vectors.
    """
    gathered = [df.where(F.col(doc).isNotNull()).groupBy(doc).agg(F.collect_list(F.struct("token", "weight")).alias("v")) for df in (queries, vectors)]
    asked, rows = (settle(df, "vectors") for df in gathered)
    parts, blocks = (max(1, -(-df.count() // n)) for df, n in ((asked, QUERIES), (rows, ROWS)))
    number = lambda n: F.pmod(F.xxhash64(doc), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = dealt(asked.select(doc, "v", number(parts).alias("part"), every(blocks).alias("block")), "part", "block")
    held = dealt(rows.select(doc, "v", every(parts).alias("part"), number(blocks).alias("block")), "part", "block")
    kind = dict(vectors.dtypes)[doc]
    best = _best_sparse(k, doc, to_arrow_type(vectors.schema[doc].dataType))
    scored = asked.groupBy("part", "block").cogroup(held.groupBy("part", "block")).applyInArrow(best, f"query {kind}, {doc} {kind}, score double")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), doc))).where(F.col("rank") <= k)
