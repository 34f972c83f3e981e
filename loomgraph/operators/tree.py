"""Trees of codes: paths from the root and the nearest ancestor that is retained, by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomgraph.sources.interim import settle

ROOT = "__ROOT__"


def ancestry(nodes: DataFrame) -> DataFrame:
    """(code, path, depth, retained, parent, state) for nodes (code, name, parents array, retained).

    The first parent counts. `path` has the names from the top down to the node, `parent` is the nearest ancestor that is retained,
    itself left out, or `__ROOT__`; `depth` counts ancestors. state: `ok`, `orphan` (a parent on the way isn't there: what is below it is a tree of
    its own) or `cycle` (the way up never ends: no path, no depth, `__ROOT__`). Rows of one code: the one whose name is smallest; a
    null code is no node, a null or empty array of parents is the top.

    Each round joins every open node with the node its pointer has reached and doubles the way, so there are as many rounds as
    the depth has binary digits; ways longer than there are nodes are cycles.
    """
    first = F.when(F.size("parents") > 0, F.col("parents")[0])
    rows = nodes.where("code IS NOT NULL").select("code", F.struct("name", first.alias("up"), F.coalesce("retained", F.lit(False)).alias("retained")).alias("r"))
    rows = settle(rows.groupBy("code").agg(F.min("r").alias("r")).select("code", "r.*"), "tree")
    known = rows.select(F.col("code").alias("up"), F.lit(True).alias("_there"))
    started = rows.join(known, "up", "left")
    reach = started.select("code", F.when(F.col("_there"), F.col("up")).alias("up"), F.array("name").alias("path"), F.lit(None).cast(rows.schema["code"].dataType).alias("nearest"), (F.col("up").isNotNull() & F.col("_there").isNull()).alias("orphan"))
    reach = settle(reach, "tree")
    kept = rows.where("retained").select(F.col("code").alias("up"), F.col("code").alias("_kept"))
    deepest = rows.count()
    for _ in range(deepest.bit_length() + 1):
        if reach.where("up IS NOT NULL").isEmpty():
            break
        above = reach.select(F.col("code").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"), F.col("nearest").alias("nearest2"), F.col("orphan").alias("orphan2"))
        joined = reach.join(above, "up", "left").join(kept, "up", "left")
        path = F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat("path2", "path"))
        path = F.when(F.size(path) <= deepest, path)  # longer than the table: it has gone round
        nearest = F.coalesce("nearest", "_kept", "nearest2")
        reach = settle(joined.select("code", F.col("up2").alias("up"), path.alias("path"), nearest.alias("nearest"), (F.col("orphan") | F.coalesce("orphan2", F.lit(False))).alias("orphan")), "tree")
    cycle = F.col("up").isNotNull()
    state = F.when(cycle, "cycle").when(F.col("orphan"), "orphan").otherwise("ok")
    out = reach.select("code", F.when(~cycle, F.col("path")).alias("path"), F.when(~cycle, F.size("path") - 1).alias("depth"), F.when(cycle, ROOT).otherwise(F.coalesce("nearest", F.lit(ROOT))).alias("parent"), state.alias("state"))
    return out.join(rows.select("code", "retained"), "code").select("code", "path", "depth", "retained", "parent", "state")


def retained_tree(nodes: DataFrame) -> DataFrame:
    """(parent, child, n_below): the tree of the retained nodes, each under its nearest retained ancestor or the root, with how many nodes
    that aren't retained hang below it without a retained one between."""
    rows = ancestry(nodes)
    hidden = rows.where("NOT retained").groupBy(F.col("parent").alias("code")).agg(F.count("*").alias("n"))
    return rows.where("retained").join(hidden, "code", "left").select("parent", F.col("code").alias("child"), F.coalesce("n", F.lit(0)).alias("n_below"))
