"""SimHash near-duplicate detection with pigeonring filtering."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from loomgraph.llm.components import connected_components
from loomgraph.llm.shared import settle, tasks

SEED = 42
#: Segments of the ring; 64 bits in bytes.
SEGMENTS = 8
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15
#: Runs of equal keys up to this length give all their links.
SMALL = 64
#: About so many texts are read to tell which shingles are very common, and at most so many shingles are told.
SAMPLE, COMMON = 8192, 1 << 19
#: An odd factor that spreads numbers over 64 bits.
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Texts filed under one shingle beyond which they are dealt to several tasks.
SPLIT = 4096
#: Most shared shingles of a text, and texts near its fingerprint under each, by which large groups of near copies are joined before
#: pairs are listed.
FEW, NEAREST = 8, 8
#: So many pairs between two components, those with most shared shingles, are verified before the others.
LIKELY = 24


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles as a signed integer; 0 without words or for null."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: ASCII rules only
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(text: Column, shingle: int) -> Column:
    def signed(texts: pa.Array) -> pa.Array:
        return pa.array((fingerprint(t.as_py(), shingle) for t in texts), pa.int64())

    return F.arrow_udf(signed, T.LongType())(text)


def budgets(distance: int) -> np.ndarray:
    """Most differing bits of the first l segments of a chain, l = 1..SEGMENTS: floor(l * distance / SEGMENTS)."""
    return np.arange(1, SEGMENTS + 1) * distance // SEGMENTS


@dataclass(frozen=True)
class Chain:
    """A prefix of the ring's chains: `equal` bytes with budget 0, then `tail` bytes in pieces, all but the tail's budget of which
    are equal. Two fingerprints within `distance` bits meet under some start and choice of equal pieces."""

    distance: int
    tail: int
    piece: int

    @property
    def equal(self) -> int:
        return int((budgets(self.distance) == 0).sum())

    def choices(self) -> list[tuple[int, ...]]:
        pieces = 8 * self.tail // self.piece
        spare = int(budgets(self.distance)[self.equal + self.tail - 1])
        return list(itertools.combinations(range(pieces), pieces - spare))

    @property
    def width(self) -> int:
        return 8 * self.equal + self.piece * len(self.choices()[0])

    def keys(self, fp: Column) -> list[Column]:
        cut = lambda at, size: F.shiftrightunsigned(fp, at % 64).bitwiseAND((1 << size) - 1)  # noqa: E731  no piece crosses a byte
        out = []
        for start in range(SEGMENTS):
            for number, chosen in enumerate(self.choices()):
                key = F.lit(start << 8 | number).cast("long")
                for step in range(self.equal):
                    key = F.shiftleft(key, 8).bitwiseOR(cut(8 * (start + step), 8))
                for k in chosen:
                    key = F.shiftleft(key, self.piece).bitwiseOR(cut(8 * (start + self.equal) + self.piece * k, self.piece))
                out.append(key)
        return out


#: Chains by distance: 24 keys of 32 bits for 3 bits apart.
CHAINS = {3: Chain(3, 3, 8)}


def _linked(differ: np.ndarray, starts: np.ndarray | int, distance: int) -> np.ndarray:
    """Which XORed pairs keep the whole chain from their start within its budgets and `distance` bits in all."""
    found = np.bitwise_count(differ) <= distance
    at = np.flatnonzero(found)
    bits = np.bitwise_count(differ[at].astype("<u8").view(np.uint8).reshape(-1, SEGMENTS))
    order = (np.broadcast_to(starts, differ.shape)[at][:, None] + np.arange(SEGMENTS)) % SEGMENTS
    chain = np.cumsum(np.take_along_axis(bits, order, axis=1), axis=1)
    found[at] = (chain <= budgets(distance)).all(axis=1)
    return found


def _trees(fps: np.ndarray, nodes: np.ndarray, start: int, distance: int) -> Iterator[list[tuple[int, int]]]:
    """Edges between nodes of each tree of a spanning forest of the links within one run of equal keys.

    Breadth first over the members not reached yet: at most one edge a member comes out, never all pairs, and a dense
    run of near copies is used up after a few comparisons.
    """
    waiting = np.arange(len(fps))
    while len(waiting) > 1:
        frontier, waiting, tree = [waiting[0]], waiting[1:], []
        while frontier and len(waiting):
            one = frontier.pop()
            hit = _linked(fps[waiting] ^ fps[one], start, distance)
            tree.extend((int(nodes[one]), int(other)) for other in nodes[waiting[hit]])
            frontier.extend(waiting[hit])
            waiting = waiting[~hit]
        if tree:
            yield tree


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows that come sorted by the first one, cut where its value changes: no run of equal keys is in two pieces."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        keys = columns[0]
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        if last == 0 and held and held[-1][0][-1] == keys[0]:
            held.append(columns)
            continue
        if last:
            held.append([c[:last] for c in columns])
        if held:
            yield [np.concatenate(part) for part in zip(*held)]
        held = [[c[last:] for c in columns]]
    if held:
        yield [np.concatenate(part) for part in zip(*held)]


def _link_sorted(distance: int):
    width = CHAINS[distance].width

    def edges(keys: np.ndarray, fps: np.ndarray, nodes: np.ndarray) -> pa.Table:
        cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        size = np.repeat(np.diff(cut), np.diff(cut))
        starts = keys >> (width + 8)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for step in range(1, SMALL):  # members of short runs `step` places apart, of all runs at once
            at = np.flatnonzero((keys[step:] == keys[:-step]) & (size[step:] <= SMALL))
            if not len(at):
                break
            at = at[_linked(fps[at] ^ fps[at + step], starts[at], distance)]
            found.append((nodes[at], nodes[at + step]))
        for at in np.flatnonzero(np.diff(cut) > SMALL):
            run = slice(cut[at], cut[at + 1])
            found.extend(tuple(np.array(tree, np.int64).T) for tree in _trees(fps[run], nodes[run], int(starts[cut[at]]), distance))
        u, v = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        return pa.table({"u": u, "v": v})

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps, *nodes in _whole_runs(batches):
            yield from edges(keys, fps.view(np.uint64), nodes[0] if nodes else fps).to_batches()

    return link


def fingerprint_links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Edges (u, v) of the links at `distance` or fewer bits between the longs of column `fp`, distinct unless a column `node` names
    what is linked instead of them: all links within runs of SMALL or fewer, spanning ones within longer runs.

    Every fingerprint is dealt out under the keys of the distance's chain. Distinct fingerprints under one key of
    32 bits differ in the other 32 only, so a run's length is bounded by the fingerprints that exist around one chain and not by
    the number of documents; copies have one fingerprint.
    """
    spark = fps.sparkSession
    keyed = fps.select(F.explode(F.array(*CHAINS[distance].keys(F.col("fp")))).alias("key"), "fp", *[c for c in fps.columns if c == "node"])
    dealt = keyed.repartition(tasks(spark), "key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_link_sorted(distance), "u long, v long")


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles (signed); none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)] if words else []
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)).view(np.int64)


def _sets(shingle: int):
    """Rows (node, s) of (node, text), about BLOCK hashes in a batch however many texts come together."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, found, size = [], [], 0
            for node, text in zip(*batch.columns):
                nodes.append(node.as_py())
                found.append(shingle_hashes(text.as_py(), shingle))
                size += len(found[-1])
                if size >= BLOCK:
                    yield packed(nodes, found)
                    nodes, found, size = [], [], 0
            if nodes:
                yield packed(nodes, found)

    def packed(nodes: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), lists], ["node", "s"])

    return lambda texts: texts.select("node", "text").mapInArrow(sets, "node long, s array<long>")


def sketch(hashes: np.ndarray) -> bytes:
    """How many hashes have each of some low bits, 255 for that or more; a power of two of numbers, one for each hash or two."""
    width = 1 << max(6, len(hashes).bit_length() - 1)
    return np.minimum(np.bincount(hashes & (width - 1), minlength=width), 255).astype(np.uint8).tobytes()


def most_shared(one: bytes, other: bytes) -> int:
    """No fewer than the members that two sets with these sketches share."""
    a, b = sorted((np.frombuffer(x, np.uint8).astype(np.int64) for x in (one, other)), key=len)
    if max(a.max(), b.max()) == 255:
        return 1 << 62
    return int(np.minimum(a, b.reshape(-1, len(a)).sum(axis=0)).sum())


def _ends(pairs: DataFrame) -> DataFrame:
    """The nodes that pairs (u, v) name, each once: each side's are made distinct where they are."""
    return pairs.select(F.col("u").alias("node")).distinct().unionByName(pairs.select(F.col("v").alias("node")).distinct()).distinct()


def possible_links(candidates: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The candidates (u, v) that may be this similar by their sketches, a byte or less for each shingle: none that is goes.

    `texts` is (node, text). What texts share by chance or in a passage only is told apart here, before whole sets are shuffled.
    """

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingle_hashes(text.as_py(), shingle) for text in batch.column(1))
            size, bits = zip(*((len(s), sketch(s)) for s in sets)) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int32()), pa.array(bits, pa.binary())], ["node", "size", "bits"])

    def bound(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array((most_shared(x.as_py(), y.as_py()) for x, y in zip(a, b)), pa.int64())

    named = _ends(candidates)
    drawn = texts.join(named, "node", "left_semi").select("node", "text").mapInArrow(sketches, "node long, size int, bits binary")
    drawn = settle(drawn.dropDuplicates(["node"]), "sketches")
    both = candidates.join(drawn.toDF("u", "m", "a"), "u").join(drawn.toDF("v", "n", "b"), "v")
    both = both.withColumn("shared", F.arrow_udf(bound, T.LongType())("a", "b"))
    return settle(both.where(F.col("shared") * (1 + similarity) >= (F.col("m") + F.col("n")) * similarity - 1e-9).select("u", "v"), "possible")


def prefix_length(size: int, similarity: float) -> int:
    """How many of a set's first members, in one order for all sets, include a common one with any other set this similar."""
    return size - math.ceil(similarity * size - 1e-9) + 1 if size else 0


def _often(tokens: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values of column `s` that occur `least` times or more, the COMMON most frequent at most, and how often."""
    counts = tokens.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "s").limit(COMMON).toArrow()
    found, n = counts["s"].to_numpy(), counts["n"].to_numpy()
    order = np.argsort(found)
    return found[order], n[order]


def _lookup(values: np.ndarray, numbers: np.ndarray, wanted: np.ndarray, default: int) -> np.ndarray:
    """The numbers that belong to the wanted ones of the sorted values."""
    if not len(values):
        return np.full(len(wanted), default, np.int64)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return np.where(values[at] == wanted, numbers[at], default)


def _cells(token: np.ndarray, node: np.ndarray, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which rows go out and under what token, about BLOCK at once. A row under a token of p parts is in one of them and goes to the p
    cells (its part, any part): two rows of the token meet in the cell of their parts. With one part the token stays."""
    part = (node.view(np.uint64) * MIX >> np.uint64(33)).view(np.int64) % parts
    ends = np.cumsum(parts)
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(BLOCK, ends[-1], BLOCK)) + 1, len(parts)])
    for begin, end in zip(cuts[:-1], cuts[1:]):
        many = parts[begin:end]
        row = np.repeat(np.arange(begin, end), many)
        other = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        cell = np.minimum(part[row], other) * parts[row] + np.maximum(part[row], other)
        yield row, (token[row].view(np.uint64) ^ cell.view(np.uint64) * MIX).view(np.int64)  # tokens that collide only give candidates


def _prefixes(shingle: int, similarity: float, common: tuple[np.ndarray, np.ndarray], hot: tuple[np.ndarray, np.ndarray], few: int | None = None):
    """Rows (token, node, root, size, place) for the prefix of each text's set, or the last `few` of it: shingles that aren't very common
    first, by hash, then the common ones, the rarest first. Hot tokens go to cells."""

    def prefix(text: str | None) -> tuple[np.ndarray, int, int]:
        s = shingle_hashes(text, shingle)
        s = s[np.argsort(_lookup(*common, s, 0), kind="stable")]
        end = prefix_length(len(s), similarity)
        begin = max(0, end - few) if few else 0
        return s[begin:end], len(s), begin

    def rows(held: list[tuple[np.ndarray, int, int, int, int]]) -> Iterator[pa.RecordBatch]:
        many = [len(s) for s, *_ in held]
        token, place = np.concatenate([s for s, *_ in held]), np.concatenate([np.arange(h[4], h[4] + len(h[0]), dtype=np.int32) for h in held])
        node, root, size = (np.repeat(np.array([h[k] for h in held], kind), many) for k, kind in ((1, np.int64), (2, np.int64), (3, np.int32)))
        for row, filed in _cells(token, node, _lookup(*hot, token, 1)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (filed, node[row], root[row], size[row], place[row])], ["token", "node", "root", "size", "place"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for node, root, text in zip(*batch.columns):
                s, whole, begin = prefix(text.as_py())
                if len(s):
                    held.append((s, node.as_py(), root.as_py(), whole, begin))
                    size += len(s)
                if size >= BLOCK:
                    yield from rows(held)
                    held, size = [], 0
        if held:
            yield from rows(held)

    return lambda texts: texts.select("node", "root", "text").mapInArrow(deal, "token long, node long, root long, size int, place int")


def _link_prefixes(similarity: float):
    """Pairs (u, v) of texts of different roots under one token whose sizes and places of the token allow the similarity. Rows come
    sorted by token. Of two sets this similar the first common member is in both prefixes, and the other common ones follow it."""

    def allowed(one: np.ndarray | int, others: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
        a, b = sizes[one], sizes[others]
        shared = np.minimum(a - places[one], b - places[others])
        return (np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9) & (shared >= similarity / (1 + similarity) * (a + b) - 1e-9)

    def pairs(tokens: np.ndarray, roots: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of both rows of each pair."""
        cut = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1], True])
        length = np.repeat(np.diff(cut), np.diff(cut))
        for step in range(1, SMALL):
            at = np.flatnonzero((tokens[step:] == tokens[:-step]) & (length[step:] <= SMALL))
            if not len(at):
                break
            at = at[roots[at] != roots[at + step]]
            at = at[allowed(at, at + step, sizes, places)]
            yield at, at + step
        for k in np.flatnonzero(np.diff(cut) > SMALL):
            run = np.arange(cut[k], cut[k + 1])
            _, component, many = np.unique(roots[run], return_inverse=True, return_counts=True)
            order = np.lexsort((component, many[component]))  # the largest component last: it is compared with, never searched
            run, component = run[order], component[order]
            ends = np.flatnonzero(component[1:] != component[:-1]) + 1
            for begin, end in zip(np.r_[0, ends], ends):
                for one in run[begin:end]:
                    hit = run[end:][allowed(one, run[end:], sizes, places)]
                    yield np.full(len(hit), one), hit

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, nodes, roots, sizes, places in _whole_runs(batches):
            for i, j in pairs(tokens, roots, sizes, places):
                if len(i):
                    u, v = np.where(nodes[i] < nodes[j], i, j), np.where(nodes[i] < nodes[j], j, i)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (nodes[u], nodes[v], roots[u], roots[v])], ["u", "v", "root_u", "root_v"])

    return link


def common_shingles(texts: DataFrame, number: int, shingle: int, similarity: float) -> tuple[tuple, tuple]:
    """The shingles of (node, text) rows that are common, with counts, and those that about SPLIT of the `number` texts or more are filed
    under, with the parts they are dealt to. A sample of about SAMPLE texts tells them; no pair depends on what it tells."""
    step = max(1, number // SAMPLE)
    some = texts.where(F.pmod("node", F.lit(step)) == 0).dropDuplicates(["node"]).select("node", F.lit(0).cast("long").alias("root"), "text")
    some = settle(some, "sample")
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    common = _often(_sets(shingle)(some).select(F.explode("s").alias("s")), 2)
    hot, n = _often(_prefixes(shingle, similarity, common, none)(some).select(F.col("token").alias("s")), max(2, SPLIT // step + 1))
    return common, (hot, -(-n * step // SPLIT))


def prefix_links(texts: DataFrame, told: tuple[tuple, tuple], shingle: int, similarity: float) -> DataFrame:
    """Pairs (u, v, root_u, root_v, shared) of nodes with different roots, among them all whose shingle sets have a Jaccard similarity of
    `similarity` or more, with how many shingles brought them together.

    `texts` is (node, root, text), `told` of common_shingles(). Each text is filed under some shingles of its set, the very common ones
    last, so many that two sets this similar share one of them (prefix filter); nothing is left to chance. Rows that are repeated give no
    more pairs. Shingles that many texts are filed under are dealt to parts, and each pair of parts is a group of its own.
    """
    dealt = _prefixes(shingle, similarity, *told)(texts).repartition(tasks(texts.sparkSession), "token").sortWithinPartitions("token")
    found = dealt.mapInArrow(_link_prefixes(similarity), "u long, v long, root_u long, root_v long")
    return found.groupBy("u", "v", "root_u", "root_v").agg(F.count("*").alias("shared"))


def filed_under_few(texts: DataFrame, told: tuple[tuple, tuple], shingle: int, similarity: float) -> DataFrame:
    """Rows (token, node, size) of each text of (node, text) for the last FEW shingles of its prefix, the most shared of them."""
    rows = _prefixes(shingle, similarity, *told, few=FEW)(texts.select("node", F.lit(0).cast("long").alias("root"), "text"))
    return settle(rows.select("token", "node", "size").distinct(), "few")


def _link_nearest(similarity: float):
    """Pairs (u, v) of each text in a run of more than FEW, but those of its largest component, and the NEAREST ones by fingerprint that
    have another root and a similar size."""

    def nearest(nodes: np.ndarray, roots: np.ndarray, sizes: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        _, component, many = np.unique(roots, return_inverse=True, return_counts=True)
        for one in np.flatnonzero(component != many.argmax()):
            low, high = np.minimum(sizes[one], sizes), np.maximum(sizes[one], sizes)
            others = np.flatnonzero((roots != roots[one]) & (low >= similarity * high - 1e-9))
            differ = np.bitwise_count(fps[others] ^ fps[one])
            if len(others) > NEAREST:
                others = others[np.argpartition(differ, NEAREST - 1)[:NEAREST]]
            yield np.full(len(others), nodes[one]), nodes[others]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, nodes, roots, sizes, fps in _whole_runs(batches):
            cut = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1], True])
            for k in np.flatnonzero(np.diff(cut) > FEW):
                run = slice(cut[k], cut[k + 1])
                found = list(nearest(nodes[run], roots[run], sizes[run], fps[run].view(np.uint64)))
                if found:
                    u, v = (np.concatenate(side) for side in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    return link


def nearest_links(few: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of different roots among the texts under one token of filed_under_few(), each with those whose fingerprints are
    nearest: their number grows with the texts and not with the pairs of a group. `roots` is (node, root, fp)."""
    rooted = few.join(roots, "node").select("token", "node", "root", "size", "fp")
    dealt = rooted.repartition(tasks(few.sparkSession), "token").sortWithinPartitions("token")
    return dealt.mapInArrow(_link_nearest(similarity), "u long, v long").distinct()


def verified_links(docs: DataFrame, distinct: DataFrame, links: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (u, v) of texts whose shingle sets have a Jaccard similarity of `similarity` or more: enough to join all that are connected.

    `docs` is (doc_id, node, text), `distinct` (node, fp, first_id), `links` of fingerprint_links(). Links between near fingerprints are
    verified first, which makes most near copies one component, then pairs of texts and the nearest ones under a shared shingle,
    which join most others of large groups; all pairs of a prefix filter that are still in different components are verified at last, so none is lost whose fingerprints are far
    apart: of two components the pairs with most shared shingles come first, and if one of them links, the others are spared. Only texts that a candidate names are read for their sets.
    """
    pairs = settle(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")

    def named_texts(candidates: DataFrame) -> DataFrame:
        named = _ends(candidates).join(distinct, "node").select("node", F.col("first_id").alias("doc_id"))
        return docs.join(named, ["doc_id", "node"]).dropDuplicates(["node"])

    def verified(candidates: DataFrame) -> DataFrame:
        hashed = settle(_sets(shingle)(named_texts(candidates)), "sets")
        both = candidates.join(hashed.toDF("u", "a"), "u").join(hashed.toDF("v", "b"), "v")
        shared, sizes = F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b")
        return settle(both.where(shared * (1 + similarity) >= sizes * similarity - 1e-9).select("u", "v"), "verified")  # shared / union

    def bounded(candidates: DataFrame, name: str) -> DataFrame:
        candidates = settle(candidates, name)
        return verified(possible_links(candidates, named_texts(candidates), shingle, similarity))

    def rooted(found: DataFrame) -> DataFrame:
        joined = distinct.join(connected_components(found), "node", "left")
        return settle(joined.select("node", "fp", F.col("first_id").alias("doc_id"), F.coalesce("root", "node").alias("root")), "roots")

    found = verified(pairs)
    told = common_shingles(docs, distinct.count(), shingle, similarity)
    few = filed_under_few(docs, told, shingle, similarity)
    found = found.unionByName(bounded(nearest_links(few, rooted(found).select("node", "root", "fp"), similarity), "nearest"))
    texts = docs.join(rooted(found).select("doc_id", "node", "root"), ["doc_id", "node"])
    further = settle(prefix_links(texts, told, shingle, similarity), "further")
    between = Window.partitionBy(F.least("root_u", "root_v"), F.greatest("root_u", "root_v")).orderBy(F.desc("shared"), "u", "v")
    likely = settle(further.withColumn("nth", F.row_number().over(between)).where(F.col("nth") <= LIKELY).select("u", "v", "root_u", "root_v"), "likely")
    first = bounded(likely.select("u", "v"), "first")
    # of two components that one of their likeliest pairs joins the other pairs are done with
    joined = connected_components(first.join(likely, ["u", "v"]).select(F.col("root_u").alias("u"), F.col("root_v").alias("v"))).toDF("old", "new")
    rest = further.join(likely, ["u", "v"], "left_anti")
    for side in ("root_u", "root_v"):
        rest = rest.join(joined.toDF(side, f"new_{side}"), side, "left").withColumn(side, F.coalesce(f"new_{side}", side)).drop(f"new_{side}")
    return found.unionByName(first).unionByName(bounded(rest.where("root_u <> root_v").select("u", "v"), "rest"))


def text_nodes(text: Column, clashes: list[int] = ()) -> Column:
    """64-bit number of a text. Texts whose numbers are `clashes` are told apart by a second hash, so 128 bits tell texts apart."""
    return _told_apart(F.xxhash64(text), F.xxhash64(F.lit(1), text), clashes)


def _told_apart(node: Column, second: Column, clashes: list[int]) -> Column:
    return F.when(node.isin(clashes), F.xxhash64(node, second)).otherwise(node) if clashes else node


#: Numbers that several texts of a table may have at most; at 10 ** 12 texts some 30,000 are expected.
CLASHES = 100_000


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, shingle: int = 3, verify: tuple[int, float] | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null and word-less texts have fingerprint zero and link like any other. Repeated rows give repeated
    result rows. A null id never becomes a component's id; a component of null ids only has a null one.
    Other columns of `docs` are ignored; an empty table gives an empty result. With `verify` = (words, similarity) those texts link
    whose sets of shingles of so many words are that similar (Jaccard), all of them and no others: near fingerprints are the
    first candidates only; a column `leads` more tells the rows of one text of each component: that of the component's id, of several with
    that id the one with the smallest hash. Texts are told apart by 128 bits of hashes, and one that has only null ids links with no other.
    """
    if verify:
        return verified_components(docs, id_col, text_col, distance, shingle, verify)[0]
    signed = settle(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col), shingle).alias("fp")).withColumn("node", F.col("fp")), "fingerprints")
    distinct = settle(signed.groupBy("node").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("first_id")), "distinct")
    classes = _classes(distinct, fingerprint_links(distinct.select("fp"), distance))
    return signed.join(classes, "node").select("doc_id", _hex("fp"), "component_id")


def _hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0")).alias("fingerprint")


def _classes(distinct: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component_id, leader) from (node, first_id) and links: the smallest id of a component, and of the nodes with it the smallest."""
    members = distinct.join(connected_components(links), "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    least = members.groupBy("root").agg(F.min(F.when(F.col("first_id").isNotNull(), F.struct("first_id", "node"))).alias("least"))
    return members.join(least, "root").select("node", F.col("least.first_id").alias("component_id"), F.col("least.node").alias("leader"))


def verified_components(docs: DataFrame, id_col: str, text_col: str, distance: int, shingle: int, verify: tuple[int, float]) -> tuple[DataFrame, list[int]]:
    """(doc_id, fingerprint, component_id, node, leads), see `simhash_components`, and the numbers that several texts have: `node` is what
    `text_nodes` gives for the text and these."""
    text = F.col(text_col)
    signed = docs.select(F.col(id_col).alias("doc_id"), fingerprints(text, shingle).alias("fp"), text_nodes(text).alias("node"), F.xxhash64(F.lit(1), text).alias("second"))
    signed = settle(signed, "fingerprints")

    def numbered(rows: DataFrame) -> DataFrame:
        return settle(rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("first_id"), F.min("second").alias("one"), F.max("second").alias("other")), "distinct")

    distinct = numbered(signed)
    clashes = [r.node for r in distinct.where("one < other").select("node").limit(CLASHES + 1).collect()]
    if len(clashes) > CLASHES:
        raise ValueError("too many texts share a 64-bit hash")
    if clashes:
        signed = signed.withColumn("node", _told_apart(F.col("node"), F.col("second"), clashes))
        distinct = numbered(signed)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_nodes(text, clashes).alias("node"), text.alias("text"))
    distinct = distinct.select("node", "fp", "first_id")
    classes = _classes(distinct, verified_links(texts, distinct, fingerprint_links(distinct.select("fp", "node"), distance), *verify))
    leads = F.coalesce((F.col("node") == F.col("leader")) & (F.col("doc_id") == F.col("component_id")), F.lit(False))
    return signed.join(classes, "node").select("doc_id", _hex("fp"), "component_id", "node", leads.alias("leads")), clashes


def one_of_each(docs: DataFrame, shingle: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with one text of each group of near copies: that of the group's smallest id.

    Different texts under one id are told apart: each that is no near copy of another stays. Of rows with one id and text that whose other columns are
    smallest stays. Rows with a null id all stay.
    """
    groups, clashes = verified_components(docs, id_col, text_col, 3, 3, (shingle, similarity))
    leaders = groups.where("leads").select(F.col("doc_id").alias(id_col), F.col("node").alias("_node")).distinct()
    named = docs.where(F.col(id_col).isNotNull()).withColumn("_node", text_nodes(F.col(text_col), clashes))
    kept = named.join(leaders, [id_col, "_node"], "left_semi")
    rest = F.struct(F.lit(0).alias("_"), *[c for c in docs.columns if c not in (id_col, text_col)])
    least = kept.groupBy(id_col, "_node").agg(F.min_by(text_col, rest).alias(text_col), F.min(rest).alias("_rest"))
    return least.select(*[c if c in (id_col, text_col) else F.col(f"_rest.{c}") for c in docs.columns]).unionByName(docs.where(F.col(id_col).isNull()))
