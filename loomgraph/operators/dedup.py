"""Near-duplicate postings: 64-bit SimHash of character 3-grams, candidates by equal parts of gram sets, star clusters around the earliest."""

from __future__ import annotations

import bisect
import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loomgraph.plans import params as P
from loomgraph.sources.interim import dealt, settle


#: Texts whose grams are hashed together: a gram that several of them hold is hashed once.
TOGETHER = 256


def _gram_codes(text: str) -> np.ndarray:
    """The text's 3-grams, each packed into 64 bits as it is (21 bits a character), in order and with repeats."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return points[:-2] << 42 | points[1:-1] << 21 | points[2:]


def _signs(grams: list[str]) -> np.ndarray:
    """+1 or -1 for each bit of each gram's hash (BLAKE2b, 8 bytes)."""
    hashes = np.frombuffer(b"".join(hashlib.blake2b(g.encode(), digest_size=8).digest() for g in grams), ">u8").astype("<u8")
    return 2.0 * np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") - 1.0


def _fingerprint(votes: np.ndarray) -> int:
    return int(np.packbits(votes > 0, bitorder="little").view("<i8")[0])


def simhash64(text: str, size: int = P.NGRAM) -> int:
    """Bit is 1 where the votes of all n-grams (BLAKE2b, 8 bytes, repeats included) are positive; signed."""
    grams = Counter(text[i : i + size] for i in range(max(1, len(text) - size + 1)))
    return _fingerprint(np.fromiter(grams.values(), np.float64) @ _signs(list(grams)))


def _marked(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Fingerprint and distinct packed grams of each text of 3 characters or more."""
    for at in range(0, len(texts), TOGETHER):
        counted = [np.unique(_gram_codes(t), return_counts=True) for t in texts[at : at + TOGETHER]]
        every = np.unique(np.concatenate([g for g, _ in counted]))
        signs = _signs(["".join(chr(int(g) >> shift & 0x1FFFFF) for shift in (42, 21, 0)) for g in every])
        for grams, counts in counted:
            yield _fingerprint(counts.astype(np.float64) @ signs[np.searchsorted(every, grams)]), grams


def _simhashes(texts: pa.Array) -> pa.Array:
    own = texts.to_pylist()
    long = iter(_marked([t for t in own if t is not None and len(t) >= 3]))
    return pa.array([None if t is None else next(long)[0] if len(t) >= 3 else simhash64(t) for t in own], pa.int64())


def solid(text: Column) -> Column:
    """Without white space, as Python's \\s has it: copies that are wrapped or indented differently are equal."""
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", "")


def block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * k).bitwiseAND(255)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of whole numbers (the finalizer of SplitMix64)."""
    x = x.astype(np.uint64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@functools.cache
def _size_bounds(least: float, most: int = 1 << 40) -> tuple[int, ...]:
    """Where classes of sizes begin: sets with a Jaccard similarity of `least` or more are in one class or in two neighbouring ones."""
    bounds = [1, 2]
    while bounds[-1] < most:
        bounds.append(max(bounds[-1] + 1, int((bounds[-1] - 1) / least + 1e-6) + 1))
    return tuple(bounds)


def similarity_keys(items: np.ndarray, least: float) -> np.ndarray:
    """Keys of a set of whole numbers, of which any two sets with a Jaccard similarity of `least` or more share one.

    Two such sets of at most m items differ in 2 m (1 - least) / (1 + least) items at most. Their items are dealt to one part more than
    that by their hash, so in one part at least they don't differ; a key is the hash of what a part holds. m is the end of the
    larger set's class of sizes: each set is filed for its own class and for the next.
    """
    bounds, hashes = _size_bounds(least), _mixed(items)
    dealt, own = _mixed(hashes), bisect.bisect_right(bounds, len(items)) - 1
    keys = []
    for size in (own, own + 1):
        parts = int(2 * (bounds[size + 1] - 1) * (1 - least) / (1 + least) + 1e-6) + 1
        held = np.zeros(parts, np.uint64)
        np.add.at(held, (dealt % np.uint64(parts)).astype(np.int64), hashes)
        keys.append(_mixed(held + _mixed(np.arange(parts, dtype=np.uint64) + np.uint64(size << 32))))
    return np.concatenate(keys).view(np.int64)


#: Longs of a sketch.
SKETCH = 32


def sketch(items: np.ndarray) -> np.ndarray:
    """64 * SKETCH bits: whether the number of items that a bit is dealt is odd. Two sets differ in as many items at least as their sketches do in bits."""
    dealt_to = (_mixed(items ^ np.int64(0x5851F42D4C957F2D)) % np.uint64(64 * SKETCH)).astype(np.int64)
    return np.packbits(np.bincount(dealt_to, minlength=64 * SKETCH) & 1, bitorder="little").view(np.int64)


def _marks(least: float, min_chars: int):
    """Key of the text without white space, and fingerprint, size, keys and sketch of its gram set; null for texts under `min_chars`. Copies in a batch are read once."""

    def marks(texts: pa.Array) -> pa.Array:
        own = ["".join(t.split()) if t is not None and len(t) >= min_chars else None for t in texts.to_pylist()]
        distinct = list(dict.fromkeys(t for t in own if t is not None))
        long = [t for t in distinct if len(t) >= P.NGRAM]
        found = dict(zip(long, ((fp, len(grams), similarity_keys(grams, least), sketch(grams)) for fp, grams in _marked(long))))
        of = {t: (hashlib.md5(t.encode()).hexdigest(), *found.get(t, (None, 0, None, None))) for t in distinct} | {None: (None,) * 5}
        columns = zip(*[of[t] for t in own]) if own else ([],) * 5
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())))], ["key", "fp", "n", "keys", "sketch"])

    return F.arrow_udf(marks, "key string, fp long, n int, keys array<long>, sketch array<long>")


def _marked_docs(docs: DataFrame, doc: str, text: Column, least: float = P.JACCARD_MIN, min_chars: int = P.DEDUP_MIN_CHARS) -> DataFrame:
    """(doc, key, fp, n, keys, sketch) of every row, written once: texts are read and marked where they lie, and not shuffled."""
    return settle(docs.select(F.col(doc).alias("doc"), _marks(least, min_chars)(text).alias("m")).select("doc", "m.*"), "marked")


def _solid_key(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else hashlib.md5("".join(t.split()).encode()).hexdigest() for t in texts.to_pylist()], pa.string())


def _gram_set(text: str) -> np.ndarray:
    return np.unique(_gram_codes("".join(text.split())))


def _similarities(a: pa.Array, b: pa.Array) -> pa.Array:
    """Jaccard similarity of the 3-gram sets of two texts without white space; a text's set is made once for all its pairs of a batch."""
    sets, out = {}, []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        for t in (x, y):
            if t not in sets:
                sets[t] = _gram_set(t)
        x, y = sets[x], sets[y]
        shared = len(np.intersect1d(x, y, assume_unique=True))
        out.append(shared / (len(x) + len(y) - shared))
    return pa.array(out, pa.float64())


def _near_pairs(docs: DataFrame, doc: str, text: Column, marked: DataFrame, distance: int, least: float) -> DataFrame:
    kept = marked.where("key IS NOT NULL AND n > 0")
    earliest = kept.groupBy("key").agg(F.min("doc").alias("doc"))
    firsts = kept.join(earliest, ["key", "doc"], "left_semi").dropDuplicates(["key", "doc"])
    keyed = dealt(firsts.select("doc", "fp", "n", F.explode("keys").alias("key")), "key")
    a, b = keyed.toDF("later", "fa", "na", "key"), keyed.toDF("earlier", "fb", "nb", "key")
    # sets of too different sizes can't be alike enough
    sizes = F.least("na", "nb") >= least * F.greatest("na", "nb")
    alike = a.join(b, "key").where((F.col("earlier") < F.col("later")) & sizes & (hamming(F.col("fa"), F.col("fb")) <= distance)).select("later", "earlier").distinct()
    sketches = firsts.select("doc", "n", "sketch")
    bounded = alike.join(sketches.toDF("later", "na", "sa"), "later").join(sketches.toDF("earlier", "nb", "sb"), "earlier")
    differ = functools.reduce(Column.__add__, (hamming(F.col("sa")[i], F.col("sb")[i]) for i in range(SKETCH)))
    near = settle(bounded.where(differ <= (1 - least) / (1 + least) * (F.col("na") + F.col("nb")) + 1e-6).select("later", "earlier").distinct(), "near")
    touched = near.select(F.explode(F.array("later", "earlier")).alias("doc")).distinct()
    # an id may stand for several texts: those that are the first of their copies count
    named = firsts.select("doc", "key").join(touched, "doc", "left_semi")
    texts = settle(docs.select(F.col(doc).alias("doc"), text.alias("t")).join(named, "doc").where(F.arrow_udf(_solid_key, T.StringType())("t") == F.col("key")).select("doc", "t"), "texts")
    both = dealt(dealt(near, "later").join(texts.toDF("later", "ta"), "later"), "earlier").join(texts.toDF("earlier", "tb"), "earlier")
    return both.where(F.arrow_udf(_similarities, T.DoubleType())("ta", "tb") >= least).select("later", "earlier").distinct()


def near_pairs(docs: DataFrame, doc: str, text: Column, distance: int = P.HAMMING_MAX, least: float = P.JACCARD_MIN, min_chars: int = P.DEDUP_MIN_CHARS) -> DataFrame:
    """(later, earlier) of distinct texts within `distance` bits and with 3-gram Jaccard similarity of `least` or more.

    White space doesn't count, but for `min_chars`. Copies of a text meet by its 128-bit hash and are one text here, so a text that very many documents
    hold is a few small rows. Candidates share a key of their gram sets, see `similarity_keys`, which loses no pair and which texts that are
    only of one language don't share; fingerprints of one language are alike, so they are tested, but nothing is looked up by them.
    Candidates that pass the bit test are bounded by sketches of their gram sets, which lose none; the texts are joined to what is left only.
    """
    return _near_pairs(docs, doc, text, _marked_docs(docs, doc, text, least, min_chars), distance, least)


#: Links of undecided documents that are settle in one ordered pass.
ORDERED = 200_000


def _in_order(rows: list[tuple]) -> list[tuple]:
    """(doc, root) of undecided documents from all their links (later, earlier, root of the earlier one if decided)."""
    links, star = {}, {}
    for later, earlier, root in rows:
        links.setdefault(later, []).append(earlier)
        if root is not None:
            star[earlier] = root == earlier
    out = []
    for doc in sorted(links):
        root = min((e for e in links[doc] if star[e]), default=doc)
        star[doc] = root == doc
        out.append((doc, root))
    return out


def star_clusters(pairs: DataFrame, ordered: int = ORDERED) -> DataFrame:
    """(doc, root): in order of ids, a document joins its earliest link that is a root, or else is a root itself.

    Roots only, never members, attract: a chain of near copies is several stars. A document is decided in the round after all its
    earlier links are; each round writes its table to the checkpoint folder. Rounds go on until at most `ordered` links are open,
    which one ordered pass settles: a chain costs no round a document. Every round decides the smallest open id at least. Where a
    document is near several roots the earliest is taken.
    """
    links = settle(pairs.select("later", "earlier"))
    every = links.select(F.explode(F.array("later", "earlier")).alias("doc")).distinct()
    decided = settle(every.join(links.select(F.col("later").alias("doc")), "doc", "left_anti").select("doc", F.col("doc").alias("root")))
    while True:
        open_links = links.join(decided.select(F.col("doc").alias("later")), "later", "left_anti")
        told = settle(open_links.join(decided.select(F.col("doc").alias("earlier"), F.col("root")), "earlier", "left").select("later", "earlier", "root"))
        left = told.count()
        if not left:
            return decided
        if left <= ordered:
            return settle(decided.unionByName(pairs.sparkSession.createDataFrame(_in_order([tuple(r) for r in told.collect()]), decided.schema)))
        state = told.groupBy("later").agg(F.min(F.when(F.col("root") == F.col("earlier"), F.col("earlier"))).alias("star"), F.min(F.when(F.col("root").isNull(), F.col("earlier"))).alias("open"))
        # decided if no earlier link is open, or a root comes before the first open one
        ready = state.where("open IS NULL OR star < open").select(F.col("later").alias("doc"), F.coalesce("star", "later").alias("root"))
        decided = settle(decided.unionByName(ready))


def near_members(docs: DataFrame, doc: str, text: Column) -> DataFrame:
    """(doc, root) of every document: the root of the first copy of its text, or else that copy; short and null texts stand alone.

    Copies meet by a 128-bit hash of the text without white space.
    """
    every = _marked_docs(docs, doc, text)
    firsts = every.where("key IS NOT NULL").groupBy("key").agg(F.min("doc").alias("first"))
    stars = star_clusters(_near_pairs(docs, doc, text, every, P.HAMMING_MAX, P.JACCARD_MIN)).toDF("first", "root")
    placed = firsts.join(stars, "first", "left").select("key", F.coalesce("root", "first").alias("root"))
    alone = every.where("key IS NULL").select("doc", F.col("doc").alias("root"))
    return every.join(placed, "key").select("doc", "root").unionByName(alone)


def cluster_stats(stars: DataFrame) -> DataFrame:
    """One row: clusters of two or more, members, largest, share of variants."""
    sizes = stars.groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
    return sizes.agg(F.count("*").alias("clusters"), F.sum("n").alias("members"), F.max("n").alias("largest"), F.sum(F.col("n") - 1).alias("variants"))
