"""Gap-based matching: requirements, gap types, scores, priorities, learning order, evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.sources.interim import settle


def lower_median_rank(counts: DataFrame, by: list[str], rank: str, n: str) -> DataFrame:
    """(by, median): first rank at which the running count reaches (total + 1) // 2; input is counts by rank."""
    w = Window.partitionBy(*by)
    running = counts.withColumn("_up", F.sum(n).over(w.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum(n).over(w))
    return running.where(F.col("_up") >= F.floor((F.col("_all") + 1) / 2)).groupBy(*by).agg(F.min(rank).alias("median"))


def requirement_profile(presence: DataFrame, graded: DataFrame, least_presence: float = 0.1, least_graded: float = 0.5) -> DataFrame:
    """(job, skill, presence, graded, median, requirement) from (job, skill, presence, n) and (job, skill, graded, median)."""
    joined = presence.join(graded, ["job", "skill"], "left").where(F.col("presence") >= least_presence)
    ratio = F.coalesce(F.col("graded") / F.col("n"), F.lit(0.0))
    kind = F.when(ratio >= least_graded, "EXPLICIT_LEVEL").otherwise("LEVEL_UNSPECIFIED")
    return joined.select("job", "skill", "presence", F.coalesce("graded", F.lit(0)).alias("graded"), F.when(kind == "EXPLICIT_LEVEL", F.col("median")).alias("median"), kind.alias("requirement"))


def gap_type(observed: Column, verified: Column, unknown: Column, held: Column, required: Column) -> Column:
    """In this order: not held -> LEARN; unverified or unknown -> EVIDENCE_INSUFFICIENT; no level required -> SATISFIED; level not
    observed -> EVIDENCE_INSUFFICIENT; below the required level -> LEVEL_GAP; else SATISFIED."""
    return (
        F.when(held.isNull(), "LEARN")
        .when(~verified | unknown, "EVIDENCE_INSUFFICIENT")
        .when(required.isNull(), "SATISFIED")
        .when(observed.isNull(), "EVIDENCE_INSUFFICIENT")
        .when(observed < required, "LEVEL_GAP")
        .otherwise("SATISFIED")
    )


def match_scores(gaps: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Score and rates of each pair from its gap rows."""
    rate = lambda kind: F.round(F.count_if(F.col("gap") == kind) / F.count("*"), 6)
    scored = gaps.groupBy(*by).agg(
        F.count("*").alias("n"), rate("SATISFIED").alias("satisfied_rate"), rate("LEVEL_GAP").alias("level_gap_rate"), rate("EVIDENCE_INSUFFICIENT").alias("uncertainty_rate"), rate("LEARN").alias("missing_rate"),
        F.round(100 * F.count_if(F.col("gap") == "SATISFIED") / F.count("*"), 2).alias("score"),
    )
    return scored.withColumn("decision", F.when(F.col("satisfied_rate") >= threshold, "MATCH").otherwise("NO_MATCH"))


def priorities(gaps: DataFrame, by: list[str], requirement: str, unlock: str, item: str) -> DataFrame:
    """Rank of the gaps of each pair: explicit requirements first, then kind of gap, more unlocked, id. Satisfied ones have no rank."""
    order = [F.when(F.col(requirement) == "EXPLICIT_LEVEL", 0).otherwise(1), F.when(F.col("gap") == "LEARN", 0).when(F.col("gap") == "LEVEL_GAP", 1).otherwise(2), F.desc(unlock), F.col(item)]
    return gaps.where("gap <> 'SATISFIED'").withColumn("priority", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def attain(own: Column, required: Column) -> Column:
    """1 for a negligible requirement, else own over required, 1 at most."""
    return F.when(required <= 0.02, 1.0).otherwise(F.least(F.lit(1.0), own / required))


def five_dimension_score(skill: Column, task: Column, experience: Column, degree: Column, other: Column) -> Column:
    return 0.34 * skill + 0.26 * task + 0.16 * experience + 0.14 * degree + 0.10 * other


#: Rounds whose parts are read side by side before they are written as one table.
KEPT = 32


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level) of a DAG: the longest path from a node without prerequisites. `edges` are (id, needs). A cycle raises.

    Kahn's rounds as joins: each takes all pending nodes none of whose needs is pending, and is written before the next. There are
    as many rounds as the graph is deep.
    """
    pending, out, level = settle(nodes.select("id").distinct()), None, 0
    edges = settle(edges.select("id", "needs"))
    while not pending.isEmpty():
        blocked = edges.join(pending.select(F.col("id").alias("needs")), "needs", "left_semi").select("id")
        ready = settle(pending.join(blocked, "id", "left_anti"))
        if ready.isEmpty():
            raise ValueError("the development graph has a cycle")
        placed = ready.withColumn("level", F.lit(level))
        out = placed if out is None else out.unionByName(placed)
        level += 1
        out = settle(out) if level % KEPT == 0 else out
        pending = settle(pending.join(ready, "id", "left_anti"))
    return out if out is not None else pending.withColumn("level", F.lit(0))


def prerequisite_closure(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(goal, id): each wanted node with all it needs, directly or not, by joins until nothing new comes. A goal that needs itself raises."""
    edges = settle(edges.select("id", "needs"))
    reached = settle(wanted.select(F.col("id").alias("goal"), "id"))
    frontier, rounds = reached, 0
    while True:
        step = settle(frontier.join(edges, "id").select("goal", F.col("needs").alias("id")).distinct())
        if not step.where("goal = id").isEmpty():
            raise ValueError("the prerequisites have a cycle")
        frontier = settle(step.join(reached, ["goal", "id"], "left_anti"))
        if frontier.isEmpty():
            return reached
        reached, rounds = reached.unionByName(frontier), rounds + 1
        reached = settle(reached) if rounds % KEPT == 0 else reached


def micro_prf(rows: DataFrame, predicted: str, gold: str) -> DataFrame:
    """One row (tp, fp, fn, precision, recall, f1) over rows with two arrays; without predictions or gold the ratio is 1 if nothing
    was missed or wrong, else 0."""
    sums = rows.agg(
        F.coalesce(F.sum(F.size(F.array_intersect(predicted, gold))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.size(F.array_except(predicted, gold))), F.lit(0)).alias("fp"), F.coalesce(F.sum(F.size(F.array_except(gold, predicted))), F.lit(0)).alias("fn")
    )
    ratio = lambda wrong, other: F.when(F.col("tp") + F.col(wrong) > 0, F.col("tp") / (F.col("tp") + F.col(wrong))).otherwise(F.when(F.col(other) == 0, 1.0).otherwise(0.0))
    both = sums.withColumn("precision", ratio("fp", "fn")).withColumn("recall", ratio("fn", "fp"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return both.withColumn("f1", f1)
