"""Byte-level BPE: exact merges by backtracking from longest matches, and decoding.

A token sequence is what merging by rank gives for its bytes exactly if each two adjacent tokens are what merging gives for
their own bytes. So a piece of text is cut from the left: the longest token at each place comes from one pass of an
Aho-Corasick automaton over the piece (bytes as Latin-1 characters), a token that doesn't fit its predecessor gives way to
its longest proper prefix in the vocabulary, and a place from which nothing fits is closed for good, so that each place
fails at most once. Whether two tokens fit is worked out once and kept.
"""

from __future__ import annotations

import base64
import itertools
import re
import uuid
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Entries of each memo of a worker; a full memo starts anew. Results don't depend on it.
KEPT = 400_000
#: Rows that a task holds as ids and bytes at once.
ROWS = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: on each line a token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def same_classes(pattern: str) -> str:
    """The pattern with each character class as the tiktoken library has it, whose tables are of another Unicode version.

    Every code point is asked for once, and what `regex` has beyond the library, or lacks, is named in the class.
    """
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    for name in sorted(set(re.findall(r"\\p\{\w+\}|\\s", pattern))):
        engine = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        told, own = set(engine.decode(engine.encode_ordinary(everything))), set(regex.findall(name, everything))
        if told != own:
            listed = lambda found: "".join(f"\\U{ord(c):08x}" for c in sorted(found))
            less = f"--[{listed(own - told)}]" if own - told else ""
            exact = f"[{name}{less}]"
            pattern = pattern.replace(name, f"[{exact}{listed(told - own)}]" if told - own else exact)
    return pattern


def merge(ranks: dict[bytes, int], text: bytes, below: int | None = None) -> list[bytes]:
    """Merging by rank as defined: the leftmost pair of the lowest rank first, as long as that is under `below`."""
    below = len(ranks) if below is None else below
    parts = [text[i : i + 1] for i in range(len(text))]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def last_merges(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """The two tokens of lower rank that each token of several bytes is merged from in the end. If merging by growing rank makes
    every token, as in a trained vocabulary, all are in it; others are left out."""
    parts = {rank: merge(ranks, token, rank) for token, rank in ranks.items() if len(token) > 1}
    return {rank: (ranks[p[0]], ranks[p[1]]) for rank, p in parts.items() if len(p) == 2 and max(ranks[p[0]], ranks[p[1]]) < rank}


class ByteCoder:
    """Encodes and decodes with one vocabulary. All 256 single bytes must be in it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, exact: str | None = None, merges: dict[int, tuple[int, int]] | None = None):
        """exact, merges: `same_classes(pattern)` and `last_merges(ranks)`, which are dear to work out. The plain pattern serves
        text below U+0100, where both agree."""
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.ranks, self.tokens, self.pattern = ranks, {rank: token for token, rank in ranks.items()}, regex.compile(pattern)
        self.exact = regex.compile(exact or same_classes(pattern), regex.V1)
        self.merges = last_merges(ranks) if merges is None else merges
        self.trained = len(self.merges) == sum(len(token) > 1 for token in ranks)
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            if len(token) == 1 or rank in self.merges or merge(ranks, token) == [token]:  # what merging can't make is never part of a longer piece
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.edges: tuple[dict[int, tuple], dict[int, tuple]] = ({}, {})
        self.prefixes: dict[int, int] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def edge(self, token: int, side: int) -> tuple[int, ...]:
        """The token, then its last (side 1) or first (side 0) part, that part's part and so on to a byte."""
        found = self.edges[side].get(token)
        if found is None:
            pair = self.merges.get(token)
            found = self.edges[side][token] = (token, *(self.edge(pair[side], side) if pair else ()))
        return found

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the two stay as they are when their bytes stand together."""
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) >= KEPT:
                self.fits.clear()
            found = self.border(left, right) if self.trained else merge(self.ranks, self.tokens[left] + self.tokens[right]) == [self.tokens[left], self.tokens[right]]
            self.fits[left, right] = found
        return found

    def border(self, left: int, right: int) -> bool:
        """`adjacent` where merges come by growing rank, so that what stands at the border changes from bytes to whole tokens in the
        order of ranks. The two don't stay if at some time the pair across it is a token that comes before the next change on
        either side; of equal ranks the left one comes first.
        """
        one, other, none = self.edge(left, 1), self.edge(right, 0), len(self.tokens) + 1
        i, j = len(one) - 1, len(other) - 1
        while True:
            across = self.ranks.get(self.tokens[one[i]] + self.tokens[other[j]], none)
            next_left, next_right = one[i - 1] if i else none, other[j - 1] if j else none
            if across < next_left and across <= next_right:
                return False
            if not i and not j:
                return True
            if next_left <= next_right:
                i -= 1
            else:
                j -= 1

    def shorter(self, token: int) -> int:
        """The longest proper prefix of a token that the automaton holds, or -1."""
        found = self.prefixes.get(token)
        if found is None:
            text = self.tokens[token].decode("latin-1")
            ends = (text[:n] for n in range(len(text) - 1, 0, -1))
            found = self.prefixes[token] = next((self.automaton.get(t) for t in ends if t in self.automaton), -1)
        return found

    def cut(self, text: bytes) -> array:
        """The tokens of one piece."""
        if not text:
            return array("i")
        if text in self.ranks:
            return array("i", [self.ranks[text]])
        size, chars = len(text), text.decode("latin-1")
        sizes, fits, closed = self.sizes, self.fits, bytearray(size + 1)
        ahead = self.automaton.iter_long(chars)  # the longest token at a place, then the longest behind it
        found, place, token, longest = array("i"), 0, next(ahead)[1], True
        while True:
            while token >= 0:
                end = place + sizes[token]
                if not closed[end] and (not found or fits.get((found[-1], token)) or self.adjacent(found[-1], token)):
                    break
                token, longest = self.shorter(token), False
            if token < 0:  # nothing goes on from here
                closed[place] = 1
                token = found.pop()
                place -= sizes[token]
                continue
            found.append(token)
            place = end
            if place == size:
                return found
            if not longest:
                ahead, longest = self.automaton.iter_long(chars, place), True
            token = next(ahead)[1]

    def encode(self, text: str) -> array:
        try:
            text.encode("latin-1")
            pattern = self.pattern
        except UnicodeEncodeError:
            pattern = self.exact
        ids, matches = array("i"), iter(pattern.findall(text)) if len(text) < 1 << 20 else (m.group() for m in pattern.finditer(text))
        while batch := list(itertools.islice(matches, 1 << 16)):
            found = list(map(self.pieces.get, batch))
            for i, ids_of in enumerate(found):
                if ids_of is None:
                    found[i] = self.kept(batch[i])
            ids.frombytes(b"".join(found))
        return ids

    def kept(self, piece: str) -> bytes:
        """The tokens of a piece as 32-bit integers. Short pieces are kept; those used lately stay when the memo is full."""
        found = self.pieces.get(piece) or self.older.get(piece)
        if found is None:
            found = self.cut(piece.encode()).tobytes()
        if len(piece) < 64:
            if len(self.pieces) >= KEPT // 2:
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = found
        return found

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class SharedCoder:
    """A vocabulary sent to the executors once; each worker builds its coder at first use."""

    _built: dict[str, ByteCoder] = {}

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str):
        self.key = uuid.uuid4().hex
        self.sent = spark.sparkContext.broadcast((ranks, pattern, same_classes(pattern), last_merges(ranks)))

    def get(self) -> ByteCoder:
        if self.key not in self._built:
            self._built.clear()
            self._built[self.key] = ByteCoder(*self.sent.value)
        return self._built[self.key]


def _ids(own: ByteCoder, texts: pa.Array) -> pa.ListArray:
    ids, ends = array("i"), [0]
    for t in texts:
        ids.extend(own.encode(t.as_py() or ""))
        ends.append(len(ids))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if ids else np.empty(0, np.int32)))


def _bytes(own: ByteCoder, lists: pa.ListArray) -> pa.Array:
    return pa.array([own.decode(x.values.to_numpy().tolist()) if x.is_valid else None for x in lists], pa.binary())


def encoded(coder: SharedCoder, text: Column) -> Column:
    """The ids of a text as array<int>; null gives an empty array."""
    return F.arrow_udf(lambda texts: _ids(coder.get(), texts), "array<int>")(text)


def decoded(coder: SharedCoder, ids: Column) -> Column:
    """The bytes that ids stand for; null gives null. Ids outside the vocabulary raise."""
    return F.arrow_udf(lambda lists: _bytes(coder.get(), lists), "binary")(ids)


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) for each row: its ids, and the bytes that decoding them gives.

    A null text is empty and has no ids. Null ids of rows are kept, repeated rows give repeated results, an empty table an
    empty one; columns besides the two aren't read. Text that the pattern doesn't match has no ids. Texts of any length are
    encoded whole, in time linear in their length. There is no shuffle: each row stays in its task, and the vocabulary (its
    size is that of the file, some MB) is what executors get.
    """
    coder = SharedCoder(docs.sparkSession, ranks, pattern)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder.get()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                ids = _ids(own, rows.column(1))
                yield pa.RecordBatch.from_arrays([rows.column(0), ids, _bytes(own, ids)], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(both, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


def token_digests(coded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of rows as `encode_documents` gives them."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
