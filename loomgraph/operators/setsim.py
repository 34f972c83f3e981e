"""Pairs of similar sets by a prefix filter: rare items first, bounds on sizes and places, then the sets themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.sources.interim import at_hand, dealt, fits, settle


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def classes(rows: DataFrame, doc: str, items: Column) -> tuple[DataFrame, DataFrame]:
    """Sets (set_id, items) that differ, and members (doc, set_id): copies of a set meet by a 128-bit hash and are one set from then on.

    Null and empty sets belong to none.
    """
    listed = rows.select(F.col(doc).alias("doc"), F.array_sort(F.array_distinct(items)).alias("items")).where(F.size("items") > 0)
    keyed = listed.withColumn("set_id", F.md5(F.to_json("items").cast("binary")))
    return keyed.groupBy("set_id").agg(F.any_value("items").alias("items")), keyed.select("doc", "set_id")


def in_reach(rows: DataFrame, items: Column, b: DataFrame, least: float, known_bytes: int = 16 << 10) -> DataFrame:
    """Rows whose set of `items` can be similar to one of the sets of `b`: `least` of its items or more are held there, and its size isn't
    beyond those of all.

    It is decided within the row, before sets are sorted, hashed or shuffled. If what `b` holds is more than `known_bytes`, all rows stay.
    """
    known = settle(b.select(F.explode("items").alias("item")).distinct(), "known")
    if not fits(known, "item", known_bytes):
        return rows
    bounds = b.agg(F.min(F.size("items")).alias("_low"), F.max(F.size("items")).alias("_high"))
    held = F.broadcast(known.agg(F.collect_list("item").alias("_known")).crossJoin(bounds))

    def reaches(n: Column, x: Column) -> Column:
        sizes = (n >= least * F.col("_low") - 1e-9) & (F.col("_high") >= least * n - 1e-9)
        return sizes & (F.size(F.array_intersect(x, F.col("_known"))) >= F.ceil(least * n - 1e-9))

    # the items are made once, not again for each time they are named
    near = F.transform(F.array(F.array_distinct(items)), lambda x: reaches(F.size(x), x))[0]
    return rows.crossJoin(held).where(near).select(*rows.columns)


def similar_sets(a: DataFrame, b: DataFrame | None = None, least: float = 0.8) -> DataFrame:
    """(a, b, similarity): pairs of sets (set_id, items) whose Jaccard similarity is `least` or more; without `b` of two sets of `a`, a < b.

    Items are ordered by how many sets hold them, over all sets of both sides. A set of n items that is similar enough shares one of its
    first p = n - ceil(least n) + 1 with the other, so only these are filed. What two sets share is at most what their first items
    share and what is left behind the first items of one of them, n - p; a pair whose count of shared first items can't make up the
    rest isn't looked at, nor one of too different sizes. Every pair is found; none is decided without its sets.

    Of two sides only items that `b` holds can be shared, so the others aren't filed: of a set of n items with m of them
    the first m - ceil(least n) + 1 are, none if that is not positive. A set stays in its task until its pairs are counted, if what `b` holds is
    small enough to be sent to every executor.
    """
    same = b is None
    sides = [a] if same else [a, b]
    every = a if same else a.unionByName(b)
    held = every.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("held"))
    if not same:
        known = settle(b.select(F.explode("items").alias("item")).distinct(), "known")
        held = at_hand(settle(held.join(at_hand(known, "item"), "item", "left_semi"), "held"), "item")
    filed = []
    for side in sides:
        placed = dealt(side, "set_id").select("set_id", F.size("items").alias("n"), F.explode("items").alias("item")).join(held, "item")
        ordered = placed.groupBy("set_id", "n").agg(F.array_sort(F.collect_list(F.struct("held", "item"))).alias("order"))
        length = (F.size("order") - F.ceil(least * F.col("n") - 1e-9) + 1).cast("int")
        placed = ordered.withColumn("p", length).where("p > 0")
        first = placed.select("set_id", "n", (F.size("order") - F.col("p")).alias("rest"), F.explode(F.slice("order", F.lit(1), F.col("p"))).alias("x"))
        filed.append(first.select("set_id", "n", "rest", F.col("x.item").alias("item")))
    right = settle(filed[-1], "prefixes")
    left = (right if same else filed[0]).toDF("a", "n_a", "rest_a", "item")
    right = (right if same else at_hand(right, "set_id")).toDF("b", "n_b", "rest_b", "item")
    sizes = F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-9
    met = left.join(right, "item").where(sizes & (F.col("a") < F.col("b") if same else F.lit(True)))
    counted = met.groupBy("a", "b", "n_a", "rest_a", "n_b", "rest_b").agg(F.count("*").alias("c"))
    needed = F.ceil(least / (1 + least) * (F.col("n_a") + F.col("n_b")) - 1e-9)
    pairs = counted.where(F.col("c") + F.greatest("rest_a", "rest_b") >= needed).select("a", "b")
    both = pairs.join(a.toDF("a", "items_a"), "a").join(sides[-1].toDF("b", "items_b"), "b")
    shared = F.size(F.array_intersect("items_a", "items_b"))
    similarity = shared / (F.size("items_a") + F.size("items_b") - shared)
    return both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= least - 1e-12)
