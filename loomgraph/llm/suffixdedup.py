"""Removal of passages that earlier documents hold, by a hash-compared suffix sort.

Bytes covered by a `WINDOW`-byte string that also starts in a document with a smaller id are removed. The corpus is sorted
piecewise: every window is filed under the k-gram of it that hashes smallest, so equal windows meet in one bucket, and
only k-grams that several documents hold are followed up. A bucket sorts the suffixes at its windows by mergesort; two
suffixes are compared by the length of their common prefix, found by binary search over prefix polynomial hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from loomgraph.llm.shared import settle, tasks

WINDOW = 50
GRAM = 16
#: Bytes of text whose windows are filed together; also the longest part of a text that is held in arrays.
SLICE = 1 << 19
#: Bytes of text to a block of documents.
BLOCK = 8 << 20
#: Blocks whose k-grams, if dealt to parts, fill one.
PARTS = 4
#: Documents with one k-gram beyond which its windows are filed singly, under their own hashes.
HOT = 8_000

_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Mixed polynomial hash of the `size` bytes from each position, built up by doubling."""
    part, width = data.astype(np.uint64) + np.uint64(1), 1
    whole, done = None, 0
    while True:
        if size & width:
            if whole is None:
                whole, done = part, width
            else:
                n = len(data) - done - width + 1
                whole = whole[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + part[done : done + n]
                done += width
        if done == size:
            break
        n = len(data) - 2 * width + 1
        part = part[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + part[width : width + n]
        width *= 2
    mixed = whole ^ (whole >> np.uint64(31))
    mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def slices(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of parts of texts: bytes, start of each part in them, the part's text and its start there.

    A text longer than SLICE comes in parts that overlap by WINDOW - 1 bytes, so each window is in one part exactly.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def joined():
        sizes = np.array([len(b) for _, _, b in held])
        return np.frombuffer(b"".join(b for _, _, b in held), np.uint8), np.r_[0, np.cumsum(sizes)[:-1]], np.array([t for t, _, _ in held]), np.array([s for _, s, _ in held])

    for text, data in enumerate(texts):
        for start in range(0, max(len(data) - WINDOW + 1, 0), SLICE):
            part = data[start : start + SLICE + WINDOW - 1]
            if held and size + len(part) > SLICE:
                yield joined()
                held, size = [], 0
            held.append((text, start, part))
            size += len(part)
    if held:
        yield joined()


def runs(data: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows filed under one k-gram: first window, number of windows, the k-gram's place and 48-bit hash.

    The smallest hash in a window is taken, the leftmost of equals: windows with equal bytes have it at the same place.
    """
    hashes = _gram_hashes(data, GRAM)
    bits = np.uint64(max(int(len(hashes)).bit_length(), 1))
    ranked = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    least = _sliding_min(ranked, WINDOW - GRAM + 1)
    ends = np.r_[parts[1:], len(data)]
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    for at in (parts, np.maximum(ends - WINDOW + 1, 0)):  # where a part begins, and where its windows would reach beyond it
        new[at[at < len(new)]] = True
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(least)])
    inside = first <= ends[np.searchsorted(parts, first, side="right") - 1] - WINDOW
    first, count = first[inside], count[inside]
    place = (least[first] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return first, count, place, (hashes[place] >> np.uint64(16)).astype(np.int64)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number that orders like them."""
    return np.ndarray((max(len(data) - 7, 0),), ">u8", data, strides=(1,))


class SuffixOrder:
    """Order of suffixes of `data`, cut at WINDOW bytes, by comparisons of prefix polynomial hashes (modulo 2**64)."""

    def __init__(self, data: np.ndarray, base: int = _BASE):
        self.data = data
        self.words = _words(data)
        self.power = np.full(len(data) + 1, base & _M64, np.uint64)
        self.power[0] = 1
        self.power = np.cumprod(self.power, dtype=np.uint64)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:-1], dtype=np.uint64, out=self.prefix[1:])

    def same(self, a: np.ndarray, b: np.ndarray, length) -> np.ndarray:
        """Whether the hashes of `length` bytes from a and from b agree."""
        return (self.prefix[a + length] - self.prefix[a]) * self.power[b] == (self.prefix[b + length] - self.prefix[b]) * self.power[a]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix, WINDOW at most, by binary search."""
        low = np.where(self.same(a, b, WINDOW), WINDOW, 0)
        open_at = np.flatnonzero(low == 0)
        a, b = a[open_at], b[open_at]
        least, most = np.zeros(len(a), np.int64), np.full(len(a), WINDOW - 1, np.int64)
        while len(a) and (least < most).any():
            middle = (least + most + 1) // 2
            agree = self.same(a, b, middle)
            least, most = np.where(agree, middle, least), np.where(agree, most, middle - 1)
        low[open_at] = least
        return low

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether the suffix at a comes before that at b (or equals it): by the first eight bytes if they differ, else past the
        common prefix."""
        one, other = self.words[a], self.words[b]
        out = one < other
        alike = np.flatnonzero(one == other)
        a, b = a[alike], b[alike]
        common = self.common(a, b)
        at = np.minimum(common, WINDOW - 1)
        out[alike] = np.where(common < WINDOW, self.data[a + at] < self.data[b + at], or_equal[alike])
        return out

    def merge_sort(self, at: np.ndarray, group: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the suffixes `at` sorted within groups, and which places a hash collision kept from being filled.

        `group` and `size` give each place its group's first place and size. All runs of a level are merged at once: an
        element's new place is its own place in its run plus the number of elements of the sibling run that go before it,
        found by binary search.
        """
        order, width, lost = np.arange(len(at)), 1, np.zeros(len(at), bool)
        while width < int(size.max(initial=0)):
            own = np.flatnonzero(size > width)
            offset = own - group[own]
            run = group[own] + offset // (2 * width) * (2 * width)
            within = own - run
            left = within < width
            end = np.minimum(run + 2 * width, group[own] + size[own])
            low = np.where(left, np.minimum(run + width, end), run)
            high = np.where(left, end, run + width)
            base = low.copy()
            open_at = np.flatnonzero(low < high)
            while len(open_at):
                middle = (low[open_at] + high[open_at]) // 2
                sibling_first = self.before(at[order[middle]], at[order[own[open_at]]], ~left[open_at])
                low[open_at] = np.where(sibling_first, middle + 1, low[open_at])
                high[open_at] = np.where(sibling_first, high[open_at], middle)
                open_at = open_at[low[open_at] < high[open_at]]
            moved = run + np.where(left, within, within - width) + (low - base)
            filled = np.zeros(len(at), bool)
            filled[moved] = True
            lost[own] |= ~filled[own]
            result = order.copy()
            result[moved] = order[own]
            order, width = result, 2 * width
        return order, lost

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 by the WINDOW bytes themselves, eight at a step: the check on hash collisions."""
        sign = np.zeros(len(a), np.int8)
        for step in (*range(0, WINDOW - 8, 8), WINDOW - 8):
            one, other = self.words[a + step], self.words[b + step]
            sign = np.where(sign == 0, (one > other).astype(np.int8) - (one < other), sign)
        return sign


def equal_windows(order: SuffixOrder, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of windows in sorted order, and whether each equals the one before it. Only equal keys can be equal windows."""
    by = np.argsort(key, kind="stable")
    start = np.r_[True, key[by][1:] != key[by][:-1]] if len(by) else np.zeros(0, bool)
    first = np.flatnonzero(start)
    size = np.diff(np.r_[first, len(by)])
    group, sizes = np.repeat(first, size), np.repeat(size, size)
    shared = sizes > 1
    by, group, sizes = by[shared], group[shared], sizes[shared]
    group = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], np.arange(len(by)), 0)) if len(by) else group
    places, lost = order.merge_sort(at[by], group, sizes)
    index = by[places]
    same = np.zeros(len(index), bool)
    if len(index):
        within = np.r_[False, group[1:] == group[:-1]]
        sign = np.r_[0, order.compare(at[index[1:]], at[index[:-1]])]
        same = within & (sign == 0)
        for bad in np.unique(group[lost | (within & (sign < 0))]):  # hashes collided: sort that group by its bytes
            span = slice(int(bad), int(bad + sizes[bad]))
            read = lambda i: order.data[at[i] : at[i] + WINDOW].tobytes()
            index[span] = sorted(by[span], key=read)
            same[span] = [k > bad and read(index[k]) == read(index[k - 1]) for k in range(span.start, span.stop)]
    return index, same


def _texts(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts of a block's documents in the order of (doc_id, rid), with both. Documents without an id come last."""
    ids = _ids(table)
    known = table["doc_id"].is_valid().to_numpy(zero_copy_only=False)
    rid = table["rid"].to_numpy()
    order = np.lexsort((rid, ids, ~known))
    column = table["text"].take(pa.array(order)).cast(pa.binary())
    return [t or b"" for t in column.to_pylist()], order, known[order]


def _ids(table: pa.Table) -> np.ndarray:
    """Ids as integers, 0 for null: by way of floats, large ones would lose their last digits."""
    return pc.fill_null(table["doc_id"], 0).to_numpy()


def _comparable(table: pa.Table, side: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """Texts to compare (empty for copies of another document and documents without an id) and their ids."""
    texts, order, known = _texts(table)
    rid = table["rid"].to_numpy()[order]
    copies = np.isin(rid, side.filter(pc.equal(side["kind"], 2))["key"].to_numpy())
    return [t if ok else b"" for t, ok in zip(texts, known & ~copies)], _ids(table)[order]


#: `grams` are 64-bit numbers in a row; `docs`, as 32-bit ones, how many of the block's documents have each.
_GRAMS = "part int, block int, grams binary, docs binary"


def _sorted_distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def _spans(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of equal labels."""
    first = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]]) if len(labels) else np.zeros(0, np.int64)
    return first, np.diff(np.r_[first, len(labels)])


def _cells(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """values[a:b] of each two bounds in a row, as bytes: a row for each number would cost more than what is done with it."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _values(cells: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers of all cells in a row."""
    return np.frombuffer(b"".join(cells.to_pylist()), kind)


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(sizes, dtype=np.int64)]


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = _ends(sizes)
    return values[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])]


def _file_grams(parts_of_grams: int):
    def file_grams(table: pa.Table, side: pa.Table) -> pa.Table:
        """The k-grams that a block's windows are filed under, once each, with the number of its documents that have it, a row per part of all k-grams.

        A document that goes on in the next slice may be counted in both: its k-grams are then followed up for nothing.
        """
        texts, ids = _comparable(table, side)
        found = [np.zeros(0, np.uint64)]
        for data, parts, text_of, _ in slices(texts):
            first, _, _, key = runs(data, parts)
            owners = np.unique(ids[text_of], return_inverse=True)[1].astype(np.uint64)  # of a slice's texts: fewer than 2 ** 16
            owner = owners[np.searchsorted(parts, first, side="right") - 1]
            found.append(_sorted_distinct(key.astype(np.uint64) << np.uint64(16) | owner) >> np.uint64(16))
        every = np.sort(np.concatenate(found)).astype(np.int64)
        first, docs = _spans(every)
        keys = every[first]
        part = keys % parts_of_grams
        order = np.argsort(part, kind="stable")
        keys, docs, part = keys[order], docs[order].astype(np.int32), part[order]
        first, _ = _spans(part)
        bounds = np.r_[first, len(part)]
        block = np.full(len(first), table["block"][0].as_py(), np.int32)
        return pa.table({"part": part[first].astype(np.int32), "block": block, "grams": _cells(keys, bounds), "docs": _cells(docs, bounds)})

    return file_grams


def _shared_grams(hot: int):
    def shared(table: pa.Table) -> pa.Table:
        """The k-grams of a part that several documents have, for each block that has them; of kind 1 those in more than `hot` documents."""
        grams, docs = _values(table["grams"], np.int64), _values(table["docs"], np.int32)
        block = np.repeat(table["block"].to_numpy(), pc.binary_length(table["grams"]).to_numpy() // 8)
        order = np.argsort(grams)
        first, size = _spans(grams[order])
        total = np.repeat(np.add.reduceat(docs[order].astype(np.int64), first) if len(first) else first, size)
        order, total = order[total > 1], total[total > 1]
        label = block[order].astype(np.int64) * 2 + (total > hot)
        by = np.argsort(label, kind="stable")
        keys, label = grams[order[by]], label[by]
        first, _ = _spans(label)
        packed = _cells(keys, np.r_[first, len(label)])
        return pa.table({"block": (label[first] // 2).astype(np.int32), "kind": (label[first] % 2).astype(np.int32), "grams": packed})

    return shared


#: A row per block and bucket, with numbers of its segments in a row: `places` is where the k-gram is in the bytes, -1 for a window filed
#: under its own hash; `sizes` how many bytes a segment has, `counts` how many spots.
_SEGMENTS = "bucket int, block int, places binary, sizes binary, bytes binary, least binary, spread binary, counts binary, spots binary"


def _cut_segments(buckets: int):
    def cut(table: pa.Table, side: pa.Table) -> pa.Table:
        """The bytes of runs under shared k-grams, once for equal bytes in the block, with all spots (text, start) they are at."""
        texts, ids = _comparable(table, side)
        wanted, hot = (np.sort(_values(side.filter(kind)["grams"], np.int64)) for kind in (pc.less(side["kind"], 2), pc.equal(side["kind"], 1)))
        distinct, columns, held = [pa.array([], pa.binary())], [np.zeros((4, 0), np.int64)], 0
        for data, parts, text_of, start_of in slices(texts):
            first, count, place, key = runs(data, parts)
            keep = _member(key, wanted)
            first, count, place, key = first[keep], count[keep], place[keep], key[keep]
            within = place - first
            single = _member(key, hot)
            if single.any():  # a window each, filed under its own bytes
                each = count[single]
                own = np.repeat(first[single], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                hashed = (_gram_hashes(data, WINDOW)[own] >> np.uint64(16)).astype(np.int64)
                first, count = np.r_[first[~single], own], np.r_[count[~single], np.ones(len(own), np.int64)]
                within, key = np.r_[within[~single], np.full(len(own), -1)], np.r_[key[~single], hashed]
            part = np.searchsorted(parts, first, side="right") - 1
            spot = (text_of[part] << 32) + start_of[part] + first - parts[part]
            raw = data.tobytes()
            coded = pa.array([raw[a:b] for a, b in zip(first.tolist(), (first + count + WINDOW - 1).tolist())], pa.binary()).dictionary_encode()
            columns.append(np.stack([coded.indices.to_numpy() + held, key % buckets, within, spot]))
            distinct.append(coded.dictionary)
            held += len(coded.dictionary)
        coded = pa.concat_arrays(distinct).dictionary_encode()
        code, to, at, spots = np.concatenate(columns, axis=1)
        code = coded.indices.to_numpy()[code]
        order = np.argsort(code, kind="stable")
        spots = np.ascontiguousarray(spots[order])
        begins, counts = _spans(code[order])  # equal bytes have one bucket and one place
        to, at = to[order[begins]].astype(np.int32), at[order[begins]].astype(np.int32)
        owners = ids[spots >> 32]
        least = np.minimum.reduceat(owners, begins) if len(begins) else owners
        spread = (np.maximum.reduceat(owners, begins) if len(begins) else owners) - least
        by = np.argsort(to, kind="stable")
        pieces = coded.dictionary.take(pa.array(by))
        sizes = pc.binary_length(pieces).to_numpy().astype(np.int32)
        data = np.frombuffer(b"".join(pieces.to_pylist()), np.uint8)
        first, _ = _spans(to[by])
        bounds = np.r_[first, len(by)]
        block = np.full(len(first), table["block"][0].as_py(), np.int32)
        columns = {"places": (at[by], bounds), "sizes": (sizes, bounds), "bytes": (data, _ends(sizes)[bounds]), "least": (least[by], bounds), "spread": (spread[by], bounds)}
        columns |= {"counts": (counts[by].astype(np.int32), bounds), "spots": (_gathered(spots, begins[by], counts[by]), _ends(counts[by])[bounds])}
        return pa.table({"bucket": to[by][first], "block": block} | {name: _cells(*cells) for name, cells in columns.items()})

    return cut


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


#: A row per bucket and block, with numbers of its ranges in a row; or the rid of a text that is a copy.
_FOUND = "block int, low binary, high binary, least binary, counts binary, spots binary, copy long"


def _hashed_alike(data: np.ndarray, at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which windows have the key and the hash of another one. Equal windows of one key always do, so the others needn't be sorted."""
    if not len(at):
        return np.zeros(0, bool)
    tag = _gram_hashes(data, WINDOW)[at] + key.astype(np.uint64) * np.uint64(_BASE)
    by = np.argsort(tag)
    same = tag[by[1:]] == tag[by[:-1]]
    alike = np.zeros(len(at), bool)
    alike[by[1:][same]] = True
    alike[by[:-1][same]] = True
    return alike


def _sort_bucket(table: pa.Table) -> pa.Table:
    """For each segment the ranges of its windows that a smaller document holds, with that document.

    Equal segments are one, so inside a long passage a k-gram has one segment only and all its windows are settled. The
    windows of the others are sorted: those of one k-gram that have it at the same distance.
    """
    sizes, counts = _values(table["sizes"], np.int32), _values(table["counts"], np.int32)
    spots, block = _values(table["spots"], np.int64), np.repeat(table["block"].to_numpy(), pc.binary_length(table["sizes"]).to_numpy() // 4)
    coded = _cells(_values(table["bytes"], np.uint8), _ends(sizes)).dictionary_encode()
    pieces, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
    bounds = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64) if len(pieces) else np.zeros(1, np.int64)
    owner, spread = _values(table["least"], np.int64), _values(table["spread"], np.int64)
    least = np.full(len(pieces), np.iinfo(np.int64).max)
    np.minimum.at(least, code, owner)
    place = np.empty(len(pieces), np.int64)
    place[code] = _values(table["places"], np.int32)
    count = np.diff(bounds) - WINDOW + 1
    begin = np.cumsum(count) - count
    smallest = np.repeat(least, count)

    filed = np.flatnonzero(place >= 0)
    halves = [_words(data)[bounds[filed] + place[filed] + k] for k in (0, GRAM - 8)]
    by = np.lexsort(halves)
    new = np.r_[True, (halves[0][by[1:]] != halves[0][by[:-1]]) | (halves[1][by[1:]] != halves[1][by[:-1]])] if len(by) else np.zeros(0, bool)
    kind = np.empty(len(by), np.int64)
    kind[by] = np.cumsum(new) - 1
    several = np.bincount(kind, minlength=1)[kind] > 1
    filed, kind = filed[several], kind[several]
    each = count[filed]
    window = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    key = np.repeat(kind * (4 * WINDOW) + place[filed] + 2 * WINDOW, each) - window
    slot = np.repeat(begin[filed], each) + window
    at = np.repeat(bounds[filed], each) + window
    alike = _hashed_alike(data, at, key)
    at, key, slot = at[alike], key[alike], slot[alike]
    index, same = equal_windows(SuffixOrder(data), at, key)
    if len(index):
        firsts = np.flatnonzero(~same)
        lowest = np.minimum.reduceat(smallest[slot[index]], firsts)
        smallest[slot[index]] = np.repeat(lowest, np.diff(np.r_[firsts, len(index)]))

    # runs of windows of a piece with one smallest document, then a row for each segment that has the piece
    start = np.ones(len(smallest), bool)
    start[1:] = smallest[1:] != smallest[:-1]
    start[begin] = True
    first_of = np.flatnonzero(start)
    piece = np.searchsorted(begin, first_of, side="right") - 1
    low, high = first_of - begin[piece], np.r_[first_of[1:], len(smallest)] - 1 - begin[piece]
    runs_of = np.bincount(piece, minlength=len(pieces))
    run_at = np.cumsum(runs_of) - runs_of
    row = np.repeat(np.arange(len(code)), runs_of[code])
    run = np.arange(len(row)) - np.repeat(np.cumsum(runs_of[code]) - runs_of[code], runs_of[code]) + run_at[code[row]]
    told = smallest[first_of[run]] < (owner + spread)[row]
    row, run = row[told], run[told]
    first, _ = _spans(block[row])
    cells, each = np.r_[first, len(row)], counts[row]
    columns = {"low": low[run].astype(np.int32), "high": high[run].astype(np.int32), "least": smallest[first_of[run]], "counts": each}
    found = {name: _cells(numbers, cells) for name, numbers in columns.items()}
    found["spots"] = _cells(_gathered(spots, _ends(counts)[row], each), _ends(each)[cells])
    return pa.table({"block": block[row[first]]} | found | {"copy": pa.nulls(len(first), pa.int64())})


def _apply_removals(extra: list[str], with_text: bool):
    def remove(table: pa.Table, found: pa.Table) -> pa.Table:
        """Cut the found ranges out of a block's texts."""
        texts, order, known = _texts(table)
        rid = table["rid"].to_numpy()[order]
        ids = _ids(table)[order]
        length = np.array([len(t) for t in texts], np.int64)
        copies = np.flatnonzero(np.isin(rid, found.filter(found["copy"].is_valid())["copy"].to_numpy()))
        low, high, least, counts = (_values(found[c].drop_null(), kind) for c, kind in (("low", np.int32), ("high", np.int32), ("least", np.int64), ("counts", np.int32)))
        spots, each = _values(found["spots"].drop_null(), np.int64), np.repeat(np.arange(len(counts)), counts)
        cut = ids[spots >> 32] > least[each]
        spots, each = spots[cut], each[cut]
        begin = (spots & 0xFFFFFFFF) + low[each]
        cuts = _united(np.r_[spots >> 32, copies], np.r_[begin, np.zeros(len(copies), np.int64)], np.r_[begin - low[each] + high[each] + WINDOW, length[copies]], len(texts))
        rows = [_without(text, some) for text, some in zip(texts, cuts)]
        columns = {"doc_id": table["doc_id"].take(pa.array(order)), "n_bytes": length}
        columns |= {name: pa.array([r[k] for r in rows], pa.int64()) for k, name in ((1, "n_removed"), (2, "n_spans"))}
        columns["kept_sha256"] = pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string())
        if with_text:
            columns["kept_text"] = pa.array([r[0].decode("utf-8", "ignore") for r in rows], pa.string())
        return pa.table(columns | {c: table[c].take(pa.array(order)) for c in extra})

    return remove


def _united(text: np.ndarray, begin: np.ndarray, end: np.ndarray, texts: int) -> Iterator[list[tuple[int, int]]]:
    """The union of each text's ranges: those that overlap or touch are one."""
    order = np.lexsort((begin, text))
    text, begin, end = text[order], begin[order], end[order]
    apart = text * (int(end.max(initial=0)) + 1)
    reach = np.maximum.accumulate(end + apart)
    first = np.flatnonzero(np.r_[True, (begin + apart)[1:] > reach[:-1]]) if len(text) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(text)][: len(first)] - 1
    ranges = list(zip(begin[first].tolist(), (reach[last] - apart[last]).tolist()))
    bounds = np.searchsorted(text[first], np.arange(texts + 1)).tolist()
    for a, b in zip(bounds, bounds[1:]):
        yield ranges[a:b]


def _without(text: bytes, cuts: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The text without the cuts, the number of bytes in them and of cuts."""
    if not cuts:
        return text, 0, 0
    at = [0, *(place for cut in cuts for place in cut), len(text)]
    out = b"".join(text[a:b] for a, b in zip(at[::2], at[1::2]))
    return out, len(text) - len(out), len(cuts)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row; with kept_text and the columns `carry` if asked for.

    A null text is empty; texts shorter than the window are kept whole. A document with a null id is neither cut nor
    compared with. Rows with one id are one document's: they don't cut each other. Copies of a whole text are found by
    their SHA-256 and cut without being sorted. In kept_text, bytes of a character that a cut split are left out.

    Documents are dealt to blocks of about BLOCK bytes by a hash of their id, so neither a hot source nor a group of copies
    lands in one task; within a block, equal k-grams and equal segments go out once. What a bucket gets for a passage is a segment
    per block, not per document. K-grams, segments and ranges are shuffled as numbers in a row, one row per block and part or bucket. A k-gram in more than HOT documents is filed window by window, under the windows' own
    hashes, so its different contexts spread over all buckets. The shuffled texts are used by all three passes.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"c_{c}") for c in carry])
    rid = F.xxhash64("doc_id", "text")
    marks = settle(named.select("doc_id", rid.alias("rid"), F.sha2("text", 256).alias("digest"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), "digests")
    total = marks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    blocks = max(2 * tasks(spark), -(-total // BLOCK))
    buckets = max(tasks(spark), 2 * -(-total // BLOCK))
    block = F.pmod(F.xxhash64("doc_id", "rid"), F.lit(blocks)).cast("int").alias("block")
    firsts = marks.where(f"n_bytes >= {WINDOW} AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id")
    copies = settle(marks.join(firsts, "digest").where("doc_id > first_id").select(block, F.col("rid").alias("key"), F.lit(2).alias("kind")).distinct(), "copies")
    by_block = named.withColumn("rid", rid).select(block, "rid", "doc_id", "text", *[f"c_{c}" for c in carry]).groupBy("block")

    grams = by_block.cogroup(copies.groupBy("block")).applyInArrow(_file_grams(max(2 * tasks(spark), blocks // PARTS)), _GRAMS)
    shared = grams.groupBy("part").applyInArrow(_shared_grams(HOT), "block int, kind int, grams binary")
    side = copies.withColumn("grams", F.lit(None).cast("binary")).unionByName(shared.withColumn("key", F.lit(None).cast("long")))
    segments = by_block.cogroup(side.groupBy("block")).applyInArrow(_cut_segments(buckets), _SEGMENTS)
    found = segments.groupBy("bucket").applyInArrow(_sort_bucket, _FOUND)
    whole = copies.select("block", *[F.lit(None).cast("binary").alias(c) for c in ("low", "high", "least", "counts", "spots")], F.col("key").alias("copy"))
    extra = [f"c_{c}" for c in carry]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    schema += "".join(f", c_{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    out = by_block.cogroup(found.unionByName(whole).groupBy("block")).applyInArrow(_apply_removals(extra, with_text), schema)
    return out.withColumnsRenamed({f"c_{c}": c for c in carry})
