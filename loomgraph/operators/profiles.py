"""Profiles of jobs: what tasks, skills and skill points a scope of jobs asks for at a level."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The least that an observation weighs in a confidence, the least demand that is shown, the least share of a point.
LEAST_WEIGHT, LEAST_DEMAND, LEAST_POINT = 1e-6, 1e-4, 0.01


def task_tilts(edges: DataFrame, tilts: DataFrame) -> DataFrame:
    """(task, tilt): the mean tilt of the skills that a task needs, weighted by its edges to them. A skill without a tilt counts 1."""
    needed = edges.where("relation = 'task_skill'").join(tilts.toDF("dst", "tilt"), "dst", "left")
    summed = needed.groupBy(F.col("src").alias("task")).agg(F.sum(F.coalesce("tilt", F.lit(1.0)) * F.col("effective")).alias("a"), F.sum("effective").alias("b"))
    return summed.select("task", F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(1.0).alias("tilt"))


def job_profile(scopes: DataFrame, edges: DataFrame, tilts: DataFrame, lam: float) -> DataFrame:
    """(scope, kind, parent, id, demand, forward_share, confidence) of tasks, skills and skill points.

    scopes (scope, job); edges (relation, src, dst, base, delta, confidence) with relations job_skill, job_task, task_skill, skill_skillpoint; an edge's
    effective weight is base + lam * delta; tilts (skill, tilt) of the level.

    Demand is the mean over the scope's jobs of effective weight times tilt (of a task: `task_tilts`), jobs without the edge counting 0;
    demands up to 0.0001 are left out. forward_share is what of it the overlay brings, 1 at most; confidence the mean weighted by tilted weight. A skill's
    demand is dealt to its points by their weights, 0.01 at least each; a point's forward share is its skill's plus its own edge's, its
    confidence the mean of both. Edges are summed by scope before anything is joined to names.
    """
    told = edges.withColumn("effective", F.col("base") + lam * F.col("delta")).withColumn("overlay", lam * F.col("delta"))
    members = scopes.where("job IS NOT NULL").distinct()
    counts = members.groupBy("scope").agg(F.count("*").alias("n_jobs"))
    level = tilts.select(F.col("skill").alias("dst"), "tilt").unionByName(task_tilts(told, tilts).toDF("dst", "tilt").withColumn("dst", F.concat(F.lit("task:"), "dst")))
    own = told.where("relation IN ('job_skill', 'job_task')").withColumn("kind", F.when(F.col("relation") == "job_task", "task").otherwise("skill"))
    key = F.when(F.col("kind") == "task", F.concat(F.lit("task:"), "dst")).otherwise(F.col("dst"))
    tilted = own.withColumn("key", key).join(level.withColumnRenamed("dst", "key"), "key", "left").withColumn("v", F.col("effective") * F.coalesce("tilt", F.lit(1.0)))
    weight = F.greatest("v", F.lit(LEAST_WEIGHT))
    summed = tilted.join(members, tilted.src == members.job).groupBy("scope", "kind", F.col("dst").alias("id")).agg(F.sum("v").alias("total"), F.sum("overlay").alias("overlay"), (F.sum(F.col("confidence") * weight) / F.sum(weight)).alias("confidence"))
    items = summed.join(counts, "scope").withColumn("demand", F.col("total") / F.col("n_jobs"))
    forward = F.when(F.col("demand") > 1e-6, F.least(F.lit(1.0), F.col("overlay") / F.col("n_jobs") / F.col("demand"))).otherwise(0.0)
    items = items.withColumn("forward_share", forward).where(F.col("demand") > LEAST_DEMAND).select("scope", "kind", F.lit(None).cast("string").alias("parent"), "id", "demand", "forward_share", "confidence")
    points = told.where("relation = 'skill_skillpoint'").withColumn("w", F.greatest("effective", F.lit(LEAST_POINT)))
    sums = points.groupBy("src").agg(F.sum("w").alias("all"))
    kids = points.join(sums, "src").select(F.col("src").alias("skill"), F.col("dst").alias("point"), (F.col("w") / F.col("all")).alias("part"), F.when(F.col("effective") > 0, F.col("overlay") / F.col("effective")).otherwise(0.0).alias("own"), F.col("confidence").alias("sure"))
    skills = items.where("kind = 'skill'")
    dealt = skills.join(kids, skills.id == kids.skill).select("scope", F.lit("skillpoint").alias("kind"), F.col("skill").alias("parent"), F.col("point").alias("id"), (F.col("demand") * F.col("part")).alias("demand"), F.least(F.lit(1.0), F.col("forward_share") + F.col("own")).alias("forward_share"), ((F.col("confidence") + F.col("sure")) / 2).alias("confidence"))
    return items.unionByName(dealt)
