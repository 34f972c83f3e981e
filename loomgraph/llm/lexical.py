"""Ranked lexical search: every document scored for a stated set of items, window by window of documents."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from loomgraph.llm.shared import settle
from loomgraph.sources.interim import discard

#: Documents of a window: the scores of one item are an array of this many 64-bit integers, 32 KB.
WINDOW = 4096
#: Bytes of item text whose terms one pass over the documents looks for. More items are searched in further passes.
BLOCK_BYTES = 16 << 20

#: Separators become spaces, A-Z become a-z; bytes of other characters stay.
_TABLE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    """Runs of letters and digits of ASCII and of any other characters, A-Z in lower case."""
    return text.translate(_TABLE).split()


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term: n of all its terms, the others of those in the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, sizes, ends, codes, tfs, rows = batch.column(0), [], [0], [], [], []
            for row, text in enumerate(batch.column(1).cast(pa.binary())):
                found = terms(text.as_py() or b"")
                if found:
                    rows.append(row)
                    sizes.append(len(found))
                    for term, tf in Counter(found).items():
                        if term in known:
                            codes.append(known[term])
                            tfs.append(tf)
                    ends.append(len(codes))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((codes, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")


class WindowPostings:
    """The postings of a window of documents, filed by term, with what each adds to a score."""

    def __init__(self, n: np.ndarray, ends: np.ndarray, codes: np.ndarray, tfs: np.ndarray, weights: np.ndarray, total: int, length: int):
        slots = np.repeat(np.arange(len(n)), np.diff(ends))
        m = 50 + (50 * n * total) // length
        order = np.argsort(codes, kind="stable")
        self.slots, self.starts = slots[order], np.searchsorted(codes[order], np.arange(len(weights) + 1))
        self.adds = (weights[codes] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[slots])))[order]
        self.bits: dict[int, np.ndarray] = {}

    def occupied(self, term: int) -> np.ndarray:
        """One bit for each document of the window that holds the term."""
        found = self.bits.get(term)
        if found is None:
            there = np.zeros(WINDOW, bool)
            there[self.slots[self.starts[term] : self.starts[term + 1]]] = True
            found = self.bits[term] = np.packbits(there).view(np.uint64)
        return found

    def score(self, item: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Adds the item's postings to `scores` (all zero before) and returns the places that are taken."""
        bits = np.zeros(WINDOW // 64, np.uint64)
        for term in item:
            first, last = self.starts[term], self.starts[term + 1]
            if first < last:
                scores[self.slots[first:last]] += self.adds[first:last]  # a term has a document once
                bits |= self.occupied(term)
        return np.flatnonzero(np.unpackbits(bits.view(np.uint8)))


class Best:
    """The k best documents of an item so far, the worst of them first in the heap."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def harvest(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """Takes documents with their scores; of equal scores the smaller id is better, no id the worst."""
        full = len(self.heap) == self.k
        at = np.flatnonzero(scores >= max(self.heap[0][0] if full else 1, 1))
        if len(at) > self.k:
            at = at[scores[at] >= np.partition(scores[at], -self.k)[-self.k]]
        for score, there, one in zip(scores[at].tolist(), known[at].tolist(), ids[at].tolist()):
            entry = (score, there, -one)
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task, a window at a time."""
    kept, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            taken = batch.slice(0, WINDOW - rows)
            kept.append(taken)
            rows += taken.num_rows
            batch = batch.slice(taken.num_rows)
            if rows == WINDOW:
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept, rows = [], 0
    if rows:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def best_of_tasks(kept: DataFrame, items: list[np.ndarray], weights: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each item among the rows of each task."""
    shared = kept.sparkSession.sparkContext.broadcast((items, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        best = [Best(k) for _ in items]
        scores = np.zeros(WINDOW, np.int64)
        for batch in windows(batches):
            ids, n, codes, tfs = (batch.column(x) for x in ("doc_id", "n", "terms", "tfs"))
            known, ids = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0))
            ends = np.asarray(codes.offsets, np.int64) - codes.offsets[0].as_py()
            window = WindowPostings(np.asarray(n), ends, np.asarray(codes.flatten(), np.int64), np.asarray(tfs.flatten()), weights, total, length)
            for item, heap in zip(items, best):
                taken = window.score(item, scores)
                if len(taken):
                    heap.harvest(scores[taken], ids[taken], known[taken])
                    scores[taken] = 0
        found = [(i, -one if there else None, score) for i, heap in enumerate(best) for score, there, one in heap.heap]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], kind) for j, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return kept.mapInArrow(search, "item int, doc_id long, score long")


def search_items(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 for each item.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document adds w * (10^9 tf div (1000 tf + 20 m)) for each
    distinct term of the item, m being 50 + (50 n N div L). Equal scores go by document id, rows without one last; rows of one
    id are documents of their own. Items of one id (null included) are one item with the terms of all of them. Null texts
    have no terms; an item that shares none with any document, and an empty table, give no rows. Further columns aren't read.

    Documents are cut into terms once: of each row its size and its items' terms are kept in an interim table, in which
    counts over all rows are taken and from which windows of 4096 documents in the order of ids are scored. No posting is
    shuffled; each task sends k rows an item. Item texts up to `block_bytes` are looked for in one pass, further ones in passes
    of their own, so what the driver holds and the executors get is bounded whatever the number of items.
    """
    spark = docs.sparkSession
    texts = items.groupBy(F.col(item_col).alias("item_id")).agg(F.array_sort(F.collect_set(F.col(text_col))).alias("texts"))
    texts = settle(texts.withColumn("bytes", F.aggregate("texts", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t))), "items")
    blocks = max(1, -(-(texts.agg(F.sum("bytes")).first()[0] or 0) // block_bytes))
    found = None
    for block in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).select("item_id", "texts").collect() if blocks > 1 else texts.select("item_id", "texts").collect()
        part = _search_block(docs, [(r.item_id, r.texts) for r in rows], k, id_col, text_col, items.schema[item_col].dataType)
        found = part if found is None else found.unionByName(part)
    return found


def _search_block(docs: DataFrame, rows: list[tuple], k: int, id_col: str, text_col: str, kind) -> DataFrame:
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    items = [np.array(sorted({vocabulary.setdefault(t, len(vocabulary)) for text in texts for t in terms(text.encode())}), np.int64) for _, texts in rows]
    kept = settle(postings(docs, vocabulary, id_col, text_col).sortWithinPartitions("doc_id"), "postings")
    total, length = kept.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = dict(kept.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # a row for each term of the block
    weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * holding.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(rows)], f"item int, item_id {kind.simpleString()}")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = best_of_tasks(kept, items, weights, total, length, k).withColumn("rank", place).where(F.col("rank") <= k)
    out = settle(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "found")
    discard(kept)
    return out


SEARCH_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
sized AS (SELECT row_number() OVER () AS row, doc_id, len(w) AS n, w FROM words WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM sized),
held AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(w) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weighed AS (SELECT term, floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM held, total GROUP BY term),
scored AS (SELECT item_id, row, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length))))::BIGINT AS score
    FROM asked JOIN held USING (term) JOIN weighed USING (term), total GROUP BY item_id, row, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
