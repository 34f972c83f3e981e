"""Layered weighted graph: presence counts per document, conditional-share edges, history, synthesis and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.operators.order_stats import values_at

#: Pair kinds and the node kind whose weight divides them.
RELATIONS = {"job_task": "job", "job_skill": "job", "task_skill": "task", "skill_skillpoint": "skill"}


def documents(facts: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """One row per document (`keys` hold doc, job, task and whatever else is one per document): skills and (skill, point)
    pairs as sets, and the document's weight. The only shuffle of facts; the sets are as long as a document is."""
    w = weight if weight is not None else F.lit(1.0)
    pair = F.when(F.col("skill").isNotNull(), F.struct("skill", "point"))
    return facts.groupBy(*keys).agg(F.collect_set("skill").alias("skills"), F.collect_set(pair).alias("points"), F.max(w).alias("w"))


def presence_frequency(docs: DataFrame, window: str | None = None) -> DataFrame:
    """(window?, kind, src, dst, w): each document adds its weight once to the total, its job, each task, skill and pair it
    holds; a point once under each parent skill. Rows are made per document and summed with partial aggregation."""

    def line(kind: str, src: Column, dst: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), src.alias("src"), (dst if dst is not None else F.lit("")).alias("dst"))

    job, task = F.col("job"), F.col("task")
    lines = F.concat(
        F.array(line("total", F.lit("")), line("job", job), line("task", task), line("job_task", job, task)),
        F.transform("skills", lambda s: line("skill", s)),
        F.transform("skills", lambda s: line("job_skill", job, s)),
        F.transform("skills", lambda s: line("task_skill", task, s)),
        F.transform("points", lambda p: line("skillpoint", p["point"])),
        F.transform("points", lambda p: line("skill_skillpoint", p["skill"], p["point"])),
    )
    key = [window] if window else []
    return docs.select(*key, "w", F.inline(lines)).groupBy(*key, "kind", "src", "dst").agg(F.sum("w").alias("w"))


def conditional_edges(freq: DataFrame, relation: str, window: str | None = None, scale: float = 1.0, digits: int = 4) -> DataFrame:
    """(window?, src, dst, weight) with weight = scale * W(src, dst) / W(src), positive weights only.

    Both sides are aggregates of one table; the node side has one row per node.
    """
    key = [window] if window else []
    nodes = freq.where(F.col("kind") == RELATIONS[relation]).select(*key, "src", F.col("w").alias("node_w"))
    share = F.lit(scale) * F.col("w") / F.col("node_w")
    edges = freq.where(F.col("kind") == relation).join(nodes, [*key, "src"]).where(share > 0)
    return edges.select(*key, "src", "dst", F.bround(share, digits).alias("weight"))


def entity_share(freq: DataFrame, digits: int = 6) -> DataFrame:
    """(kind, src, share): weighted share of all documents; the total is one row, joined as a scalar."""
    total = freq.where("kind = 'total'").select(F.col("w").alias("total"))
    nodes = freq.where(F.col("kind").isin("task", "skill", "skillpoint"))
    return nodes.join(F.broadcast(total)).select("kind", "src", F.bround(F.col("w") / F.col("total"), digits).alias("share"))


def merge_history(now: DataFrame, before: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """now + alpha * before for every key of either: union and sum, so no join."""
    return now.select(*keys, "w").unionByName(before.select(*keys, (F.col("w") * alpha).alias("w"))).groupBy(*keys).agg(F.sum("w").alias("w"))


def decayed_chain(freq: DataFrame, step: Column, last: Column, keys: list[str], alpha: float) -> DataFrame:
    """The chain of merges over all windows up to `last` in closed form: sum of alpha ** (last - step) * w."""
    return freq.groupBy(*keys).agg(F.sum(F.pow(F.lit(alpha), last - step) * F.col("w")).alias("w"))


def upper_median(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Element n // 2 (from 0) of the sorted values of each group."""
    return values_at(rows, value, by, {"median": F.floor(F.col("n") / 2)}).select(*by, "median")


def gaps(strengths: DataFrame, exposure: DataFrame) -> DataFrame:
    """(kind, id, gap) = max(0, strength - exposure); an entity without exposure has exposure 0."""
    joined = strengths.join(exposure, ["kind", "id"], "left")
    return joined.select("kind", "id", F.greatest(F.lit(0.0), F.col("strength") - F.coalesce("exposure", F.lit(0.0))).alias("gap"))


def synthesize(edges: DataFrame, gap: DataFrame, lam_j: float, lam_ts: float, lam_sp: float, max_new: int) -> DataFrame:
    """Effective edges (relation, src, dst, base_weight, delta_weight, effective_weight, origin).

    J-T and J-S gain by the right end's gap, T-S by both ends', S-SP by the parent's. Task and skill pairs that both have a
    gap and no edge give at most `max_new` new edges, largest first. Only gap-bearing tasks and skills are crossed: entities
    of the taxonomy, whose number doesn't grow with the documents.
    """
    right = {"job_task": ("task", lam_j), "job_skill": ("skill", lam_j)}
    tasks = gap.where("kind = 'task'").select(F.col("id").alias("t"), F.col("gap").alias("gap_t"))
    skills = gap.where("kind = 'skill'").select(F.col("id").alias("s"), F.col("gap").alias("gap_s"))
    parts = []
    for relation, (kind, lam) in right.items():
        side = (tasks if kind == "task" else skills).toDF("dst", "g")
        parts.append(edges.where(F.col("relation") == relation).join(side, "dst", "left").withColumn("delta", F.lit(lam) * F.coalesce("g", F.lit(0.0))))
    ts = edges.where("relation = 'task_skill'")
    both = ts.join(tasks.toDF("src", "gap_t"), "src", "left").join(skills.toDF("dst", "gap_s"), "dst", "left")
    parts.append(both.withColumn("delta", F.lit(lam_ts) * F.coalesce("gap_t", F.lit(0.0)) * F.coalesce("gap_s", F.lit(0.0))))
    points = edges.where("relation = 'skill_skillpoint'").join(skills.toDF("src", "g"), "src", "left")
    parts.append(points.withColumn("delta", F.lit(lam_sp) * F.coalesce("g", F.lit(0.0))))
    chosen = [p.select("relation", "src", "dst", F.col("weight").alias("base"), "delta", F.lit("base").alias("origin")) for p in parts]
    fresh = tasks.where("gap_t > 0").crossJoin(skills.where("gap_s > 0")).select(F.col("t").alias("src"), F.col("s").alias("dst"), (F.lit(lam_ts) * F.col("gap_t") * F.col("gap_s")).alias("delta"))
    fresh = fresh.join(ts.select("src", "dst"), ["src", "dst"], "left_anti").where("delta > 0").orderBy(F.desc("delta"), "src", "dst").limit(max_new)
    chosen.append(fresh.select(F.lit("task_skill").alias("relation"), "src", "dst", F.lit(0.0).alias("base"), "delta", F.lit("synthesized").alias("origin")))
    out = chosen[0]
    for part in chosen[1:]:
        out = out.unionByName(part)
    return out.select("relation", "src", "dst", F.col("base").alias("base_weight"), F.bround("delta", 4).alias("delta_weight"), F.bround(F.col("base") + F.col("delta"), 4).alias("effective_weight"), "origin")


def two_hop(first: DataFrame, second: DataFrame) -> DataFrame:
    """(src, dst, weight): sum over middle nodes of the products of weights, one equi join and a partial aggregation."""
    a = first.select(F.col("src"), F.col("dst").alias("middle"), F.col("weight").alias("w1"))
    b = second.select(F.col("src").alias("middle"), F.col("dst"), F.col("weight").alias("w2"))
    return a.join(b, "middle").groupBy("src", "dst").agg(F.sum(F.col("w1") * F.col("w2")).alias("weight"))


def blend_two_hop(direct: DataFrame, via: DataFrame, share_direct: float = 0.3) -> DataFrame:
    """Normalise both by the source's maximum, blend, normalise again."""
    top = Window.partitionBy("src")
    norm = lambda df, name: df.select("src", "dst", (F.col("weight") / F.max("weight").over(top)).alias(name))
    both = norm(direct, "d").join(norm(via, "v"), ["src", "dst"], "full_outer")
    mixed = both.withColumn("x", share_direct * F.coalesce("d", F.lit(0.0)) + (1 - share_direct) * F.coalesce("v", F.lit(0.0)))
    return mixed.select("src", "dst", (F.col("x") / F.max("x").over(top)).alias("score"))


def base_and_effective(base: DataFrame, effective: DataFrame) -> DataFrame:
    """Full outer merge by (src, dst): base-only edges keep their weight as effective, effective-only have base 0."""
    b = base.select("src", "dst", F.col("weight").alias("b"))
    e = effective.select("src", "dst", F.col("weight").alias("e"))
    merged = b.join(e, ["src", "dst"], "full_outer")
    origin = F.when(F.col("b").isNull(), "delta").when(F.col("e").isNull(), "base").otherwise("both")
    return merged.select("src", "dst", F.coalesce("b", F.lit(0.0)).alias("base_weight"), F.coalesce("e", "b").alias("effective_weight"), origin.alias("origin"))


def violations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rule, src, dst) of edges that break the graph: self loops, unknown ends, weights outside (0, 1], duplicate pairs."""
    def broken(rule: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(rule).alias("rule"), "src", "dst")

    known = nodes.select("id").distinct()
    out = broken("self_loop", edges.where("src = dst"))
    out = out.unionByName(broken("unknown_src", edges.join(known, edges.src == known.id, "left_anti")))
    out = out.unionByName(broken("unknown_dst", edges.join(known, edges.dst == known.id, "left_anti")))
    out = out.unionByName(broken("weight_range", edges.where("weight <= 0 OR weight > 1")))
    return out.unionByName(broken("duplicate", edges.groupBy("src", "dst").count().where("count > 1")))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) over both ends of every edge."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def ordinal_shares(rows: DataFrame, by: str, level: str, levels: list[str]) -> DataFrame:
    """(by, n, one share column per level, unset): weighted by rows; levels outside the list count as unset."""
    counts = [F.sum((F.col(level) == x).cast("long")).alias(x) for x in levels]
    return rows.groupBy(by).agg(F.count("*").alias("n"), *counts, F.sum((F.col(level).isNull() | ~F.col(level).isin(levels)).cast("long")).alias("unset"))
