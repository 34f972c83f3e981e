"""Packing token pieces into fixed-size sequences: large-item matching, then best fit."""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from loomgraph.llm.shared import settle, tasks

#: Token that ends each document.
END = 1
# ASCII punctuation and Latin letters as classes of a pattern, and what the vocabulary writes at the end of a word's last token.
PUNCTUATION = r"!-/:-@\[-`{-~"
#: Letters up to U+012F: below the first one whose lower case is two characters.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-\u012f"
WORD_END = "</w>"
#: Words, marks and odd chunks whose ids a worker keeps.
KEPT = 1_000_000
#: Chunks that are encoded in one call.
TOGETHER = 2000
#: Bytes of text that are encoded together.
STRIDE = 8_000_000
#: Parts at least that the pieces of one length are dealt to while they are numbered.
DEALT = 256


def _strings(values) -> pa.Array:
    return pa.array(values, pa.string())


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each start and size, in a row."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class ChunkEncoder:
    """Token ids of whole texts, with the ids of chunks between ASCII white space kept for the next text.

    For vocabularies of lower-case words, which drop white space and never join what it separates or letters with punctuation: a
    text's ids are its chunks' ids in a row, and those of a word and the punctuation behind it are the lower-case word's and the
    punctuation's. These parts are kept, in a table that Arrow searches: a loop over chunks would take longer than their encoding.
    A text that holds a special token's string is encoded whole. When the table is full, only the parts of the present texts stay.
    """

    WORD = f"^(?P<stem>[{LETTERS}]+)(?P<end>[{PUNCTUATION}]*)$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.of_words = Tokenizer.from_file(path)  # of words as they are kept: there's nothing to normalize
        self.of_words.normalizer = None
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        specials = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(specials)) if specials else None
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.known, self.flat, self.sizes = _strings([""]), np.zeros(0, self.kind), np.zeros(1, np.int64)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _bounds(self, ids: np.ndarray, texts: list[str], found, words: bool) -> np.ndarray:
        """Where each text's ids begin, and the end: single words by the tokens that close words, else by offsets."""
        if words:
            return np.r_[0, np.flatnonzero(self.closes[ids]) + 1]
        starts = np.fromiter((a for a, _ in found.offsets), np.int64, len(ids))
        return np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))

    def _encode_parts(self, parts: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts in a row, and how many each has."""
        flat, sizes = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for at in range(0, len(parts), TOGETHER):
            texts = parts[at : at + TOGETHER].to_pylist()
            joined = " ".join(texts)
            if words:  # the fast form keeps no offsets
                found = self.of_words.encode_batch_fast([joined], add_special_tokens=False)[0]
            else:
                found = self.tokenizer.encode(joined, add_special_tokens=False)
            flat.append(np.array(found.ids, self.kind))
            sizes.append(np.diff(self._bounds(flat[-1], texts, found, words)))
        return np.concatenate(flat), np.concatenate(sizes)

    def _places(self, parts: pa.Array) -> np.ndarray:
        """Where distinct parts are in the table; those that aren't yet are encoded."""
        place = pc.index_in(parts, value_set=self.known)
        new = parts.filter(place.is_null())
        if not len(new):
            return place.to_numpy()
        if len(self.known) + len(new) > KEPT:
            old = pa.concat_arrays([_strings([""]), parts.filter(pc.and_(place.is_valid(), pc.not_equal(parts, "")))])
            at = pc.index_in(old, value_set=self.known).to_numpy()
            self.flat = _gathered(self.flat, (np.cumsum(self.sizes) - self.sizes)[at], self.sizes[at])
            self.known, self.sizes = old, self.sizes[at]
            place = pc.index_in(parts, value_set=self.known)
        word = pc.match_substring_regex(new, f"^[{LETTERS}]+$")
        place, lacking = pc.fill_null(place, 0).to_numpy().astype(np.int64), np.flatnonzero(place.is_null())
        for some, words in ((word, True), (pc.invert(word), False)):
            flat, sizes = self._encode_parts(new.filter(some), words)
            place[lacking[some.to_numpy(zero_copy_only=False)]] = len(self.known) + np.arange(len(sizes))
            self.known = pa.concat_arrays([self.known, new.filter(some)])
            self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        return place

    def _known(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks in a row, and how many each has: those of the word, or the whole chunk, and of what is behind it."""
        found = pc.extract_regex(chunks, self.WORD)
        stems = pc.if_else(found.is_valid(), pc.utf8_lower(pc.struct_field(found, "stem")), chunks)
        ends = pc.fill_null(pc.struct_field(found, "end"), "")
        coded = pa.concat_arrays([stems, ends]).dictionary_encode()
        place = self._places(coded.dictionary)[coded.indices.to_numpy()].reshape(2, -1).T.ravel()
        sizes = self.sizes[place]
        return _gathered(self.flat, (np.cumsum(self.sizes) - self.sizes)[place], sizes), sizes.reshape(-1, 2).sum(axis=1)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text. Arrow splits the texts and numbers their distinct chunks; only those go through the table."""
        whole = {i for i, t in enumerate(texts) if self.special and self.special.search(t)}
        column = _strings(["" if i in whole else t for i, t in enumerate(texts)])
        words = pc.ascii_split_whitespace(column)
        coded = words.values.dictionary_encode()
        flat, sizes = self._known(coded.dictionary)
        index = coded.indices.to_numpy()
        length = sizes[index]
        ids = _gathered(flat, (np.cumsum(sizes) - sizes)[index], length)
        bounds = np.r_[0, np.cumsum(length)][words.offsets.to_numpy()]
        for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
            yield self._whole(texts[i]) if i in whole else ids[a:b]


@functools.cache
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end token, cut at `capacity`."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            ids_of, texts, held = batch.column(0).to_pylist(), [], 0
            for value in batch.column(1):
                texts.append(value.as_py() or "")
                held += len(texts[-1])
                if held > STRIDE:
                    yield cut(ids_of[: len(texts)], encoder.encode(texts))
                    ids_of, texts, held = ids_of[len(texts) :], [], 0
            yield cut(ids_of, encoder.encode(texts))

    def cut(docs_ids: list, encoded: Iterator[np.ndarray]) -> pa.RecordBatch:
        rows: list[tuple] = []
        for doc, found in zip(docs_ids, encoded):
            ids = np.append(found, END).astype("<u4")
            for piece, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start : start + capacity]
                rows.append((doc, piece, start, len(part), zlib.crc32(part.tobytes())))
        columns = list(zip(*rows)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Bins for a histogram of lengths, as runs: `count` bins in a row that hold the same lengths.

    It needs lengths and their counts only, at most `capacity` of them, so its work doesn't grow with the number of pieces.
    `placed` gets (length, first rank, count, first bin, offset): pieces of one length are numbered from 0 and taken in order.
    """

    def __init__(self, capacity: int, counts: dict[int, int]):
        self.capacity, self.left = capacity, dict(counts)
        self.rank = dict.fromkeys(counts, 0)
        self.bins = 0
        self.placed: list[tuple[int, int, int, int, int]] = []
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []
        self.match_large()
        self.best_fit()

    def place(self, length: int, count: int, first_bin: int, offset: int) -> None:
        self.placed.append((length, self.rank[length], count, first_bin, offset))
        self.rank[length] += count
        self.left[length] -= count

    def open_gap(self, gap: int, first_bin: int, count: int) -> None:
        if gap:
            if gap not in self.gaps:
                bisect.insort(self.sizes, gap)
                self.gaps[gap] = []
            self.gaps[gap].append((first_bin, count))

    def match_large(self) -> None:
        """Lengths above a third of capacity: at most two to a bin. The largest takes the largest partner that fits."""
        large = sorted(n for n, c in self.left.items() if 3 * n > self.capacity and c)
        while large:
            one = large[-1]
            at = bisect.bisect_right(large, self.capacity - one) - 1
            other = large[at] if at >= 0 else None
            if other is None:
                count = self.left[one]
                self.place(one, count, self.bins, 0)
                self.open_gap(self.capacity - one, self.bins, count)
            else:
                count = self.left[one] // 2 if other == one else min(self.left[one], self.left[other])
                if count == 0:  # a single piece that could only pair with its own kind
                    large_without = [n for n in large[:at] if self.left[n]]
                    other = large_without[-1] if large_without else None
                    count = 1
                self.place(one, count, self.bins, 0)
                if other is not None:
                    self.place(other, count, self.bins, one)
                self.open_gap(self.capacity - one - (other or 0), self.bins, count)
            self.bins += count
            large = [n for n in large if self.left[n]]

    def best_fit(self) -> None:
        """The other lengths, longest first, each into the smallest gap that holds it, else into a new bin."""
        for length in sorted((n for n, c in self.left.items() if c), reverse=True):
            while self.left[length]:
                at = bisect.bisect_left(self.sizes, length)
                if at == len(self.sizes):
                    per_bin = self.capacity // length
                    if self.left[length] >= per_bin:
                        count, each = self.left[length] // per_bin, per_bin
                    else:
                        count, each = 1, self.left[length]
                    for k in range(each):
                        self.place(length, count, self.bins, k * length)
                    self.open_gap(self.capacity - each * length, self.bins, count)
                    self.bins += count
                    continue
                gap = self.sizes[at]
                runs = self.gaps[gap]
                first, count = runs.pop()
                if not runs:
                    del self.gaps[gap]
                    self.sizes.pop(at)
                used = min(count, self.left[length])
                self.place(length, used, first, self.capacity - gap)
                self.open_gap(gap - length, first, used)
                if used < count:
                    self.open_gap(gap, first + used, count - used)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...) of 1..capacity tokens.

    The driver sees the histogram of lengths (at most `capacity` rows) and plans runs of equal bins from it. Pieces of one
    length are numbered in parts, as many as there are tasks, so that a length which a third of all pieces have is no
    single task: a part's first number is the sum of the parts of that length before it.
    """
    spark = pieces.sparkSession
    parts = max(DEALT, tasks(spark))
    kept = settle(pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int")), "pieces")
    by_part = kept.groupBy("length", "part").count()
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = Packing(capacity, counts).placed
    order = np.array(sorted(plan), np.int64).reshape(-1, 5)
    runs = spark.sparkContext.broadcast(order)
    base = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = by_part.select("length", "part", F.coalesce(base, F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = kept.withColumn("within", number).join(firsts, ["length", "part"]).withColumn("rank", F.col("first") + F.col("within"))

    def locate(length: pa.Array, rank: pa.Array) -> pa.Array:
        table = runs.value
        keys = table[:, 0] * (1 << 44) + table[:, 1]
        at = np.searchsorted(keys, length.to_numpy() * (1 << 44) + rank.to_numpy(), side="right") - 1
        found = table[at]
        bins = found[:, 3] + rank.to_numpy() - found[:, 1]
        return pa.StructArray.from_arrays([pa.array(bins), pa.array(found[:, 4])], ["sequence_id", "offset"])

    placed = F.arrow_udf(locate, "sequence_id long, offset long")
    return numbered.withColumn("place", placed(F.col("length"), F.col("rank"))).select(*[c for c in pieces.columns], "place.sequence_id", "place.offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    A null text is an empty document: its end token only. Repeated rows are documents of their own. Null ids are kept.
    Pieces of `capacity` tokens fill a sequence alone. Offsets in a sequence run from 0 without gaps.
    """
    return pack(token_pieces(docs, tokenizer, capacity, id_col, text_col), capacity)
