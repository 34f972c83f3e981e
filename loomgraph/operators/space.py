"""Jobs as vectors of tasks: neighbours on measured dimensions, and jobs dealt to cells of two attributes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from loomgraph.operators.order_stats import values_at
from loomgraph.sources.interim import settle


def unit_vectors(jobs: DataFrame, measured: DataFrame, inferred: DataFrame | None = None) -> DataFrame:
    """(job, task, value, inferred): unit vectors of the jobs that have any, as rows of what isn't zero.

    measured, inferred (job, task, weight): only tasks that a measured edge has are dimensions, so an inferred edge to another task changes
    no distance. Weights of repeated edges add up; edges of other jobs, null tasks and weights of 0 or null don't count. `inferred` tells
    the jobs of which an inferred edge counts.
    """
    edges = measured.select("job", "task", "weight", F.lit(False).alias("inferred"))
    if inferred is not None:
        known = measured.where("weight <> 0").select("task").distinct()
        edges = edges.unionByName(inferred.select("job", "task", "weight", F.lit(True).alias("inferred")).join(known, "task", "left_semi"))
    summed = edges.where("task IS NOT NULL AND weight <> 0").groupBy("job", "task").agg(F.sum("weight").alias("weight"), F.max("inferred").alias("inferred"))
    kept = summed.join(jobs.select("job").distinct(), "job", "left_semi")
    norms = kept.groupBy("job").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"), F.max("inferred").alias("inferred"))
    return kept.drop("inferred").join(norms.where("norm > 1e-12"), "job").select("job", "task", (F.col("weight") / F.col("norm")).alias("value"), "inferred")


#: Jobs of one side and of the other that one task compares; jobs and tasks of one product of matrices within it.
ASKED, HELD, TILE, DIMENSIONS = 4096, 16_384, 256, 4096


def _matrix(jobs: np.ndarray, tasks: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Values, and where there are any, of jobs by tasks; rows of tasks outside the shape are left out."""
    inside = (tasks >= 0) & (tasks < shape[1])
    matrix, there = np.zeros(shape), np.zeros(shape, np.float32)
    matrix[jobs[inside], tasks[inside]] = values[inside]
    there[jobs[inside], tasks[inside]] = 1
    return matrix, there


def _nearest(k: int, digits: int):
    def nearest(asked: pa.Table, held: pa.Table) -> pa.Table:
        """The k jobs of `held` nearest to each of `asked`, of those that share a task with it; ties to the smaller name."""
        kind, found = (asked if len(asked) else held).schema.field("job").type, []
        if len(asked) and len(held):
            sides, shared_tasks = [], np.intersect1d(*[t["task"].to_numpy().astype(str) for t in (asked, held)])
            for t in (asked, held):
                names, jobs = np.unique(t["job"].to_numpy(), return_inverse=True)
                tasks = t["task"].to_numpy().astype(str)
                at = np.searchsorted(shared_tasks, tasks).clip(max=max(0, len(shared_tasks) - 1))
                ours = shared_tasks[at] == tasks if len(shared_tasks) else np.zeros(len(tasks), bool)
                sides.append((names, jobs[ours], at[ours], t["value"].to_numpy()[ours]))
            (own, own_jobs, own_tasks, own_values), (others, other_jobs, other_tasks, other_values) = sides
            for first in range(0, len(own), TILE):
                tile = (own_jobs >= first) & (own_jobs < first + TILE)
                n = min(TILE, len(own) - first)
                dots, both = np.zeros((n, len(others))), np.zeros((n, len(others)), np.float32)
                for low in range(0, len(shared_tasks), DIMENSIONS):
                    width = min(DIMENSIONS, len(shared_tasks) - low)
                    a, a_there = _matrix(own_jobs[tile] - first, own_tasks[tile] - low, own_values[tile], (n, width))
                    b, b_there = _matrix(other_jobs, other_tasks - low, other_values, (len(others), width))
                    dots += a @ b.T
                    both += a_there @ b_there.T
                scale = 10.0**digits
                distances = np.floor(np.maximum(0.0, 1 - dots) * scale + 0.5) / scale
                distances[both == 0] = np.inf
                distances[own[first : first + n, None] == others[None, :]] = np.inf
                for job, line, shares in zip(own[first : first + n], distances, both):
                    most = np.partition(line, min(k, len(line)) - 1)[min(k, len(line)) - 1]
                    near = np.flatnonzero(line <= most)
                    for i in near[np.argsort(line[near], kind="stable")][:k]:
                        if np.isfinite(line[i]):
                            found.append((job, others[i], float(line[i]), int(shares[i])))
        columns = zip(*found) if found else ([], [], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(columns, (kind, kind, pa.float64(), pa.int64()))], ["job", "other", "distance", "shared"])

    return nearest


def neighbours(vectors: DataFrame, k: int, digits: int = 9, asked: int = ASKED, held: int = HELD) -> DataFrame:
    """(job, rank, other, distance, shared): the k nearest others of each job by cosine distance, with how many tasks both have.

    Jobs that share no task are at distance 1 and aren't listed. Rounded to `digits`, ties go by name. All pairs of jobs are compared, in
    products of matrices: blocks of `asked` jobs meet blocks of `held`, each two in one task, which leaves k rows a job. No pair is a row
    of a join; time grows with the square of the jobs, what is shuffled with the blocks, and a task's memory not at all.
    """
    kept = settle(vectors.where("job IS NOT NULL").select("job", F.col("task").cast("string").alias("task"), "value"), "vectors")
    jobs = kept.select("job").distinct().count()
    parts, blocks = (max(1, -(-jobs // n)) for n in (asked, held))
    number = lambda n: F.pmod(F.xxhash64("job"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = kept.select("*", number(parts).alias("part"), every(blocks).alias("block"))
    right = kept.toDF("job", "task", "value").select("*", every(parts).alias("part"), number(blocks).alias("block"))
    kind = vectors.schema["job"].dataType.simpleString()
    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_nearest(k, digits), f"job {kind}, other {kind}, distance double, shared long")
    told = settle(found, "nearest")  # all its columns: a caller that drops some would have them pruned below the blocks too
    place = F.row_number().over(Window.partitionBy("job").orderBy("distance", "other"))
    return told.withColumn("rank", place).where(F.col("rank") <= k).select("job", "rank", "other", "distance", "shared")


def rings(distances: DataFrame, by: str = "cluster", value: str = "distance", shares: tuple[float, ...] = (0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(by, n, r25, r50, …): radii within which these shares of a cluster lie: the value at rank ceil(share n), found by counting."""
    ranks = {f"r{round(100 * s)}": F.greatest(F.lit(0), F.ceil(F.lit(s) * F.col("n") - 1e-9) - 1) for s in shares}
    return values_at(distances, value, [by], ranks)


def post_cells(posts: DataFrame, jobs: DataFrame, per_column: int = 2, per_cell: int = 5, floor: float = 0.04) -> DataFrame:
    """(column, band, rank, job, posts): what jobs are drawn in each cell of column and band, most posts first, at most `per_cell`.

    posts (job, kind, value, share): shares of a job's `column` values and `band` values. jobs (job, posts). A job's columns are those with
    `floor` of it or more; in each it is dealt to its `per_column` largest bands, with posts * share of the column * share of the band: only
    the two distributions are known, so they are multiplied. Ties go by name. Jobs without posts, and null values, are left out.
    """
    told = posts.where("value IS NOT NULL AND share IS NOT NULL")
    columns = told.where((F.col("kind") == "column") & (F.col("share") >= floor)).select("job", F.col("value").alias("column"), F.col("share").alias("a"))
    place = F.row_number().over(Window.partitionBy("job").orderBy(F.desc("share"), "value"))
    bands = told.where("kind = 'band'").withColumn("nth", place).where(F.col("nth") <= per_column).select("job", F.col("value").alias("band"), F.col("share").alias("b"))
    cells = columns.join(bands, "job").join(jobs.where("posts > 0").select("job", F.col("posts").alias("all")), "job").withColumn("posts", F.round(F.col("all") * F.col("a") * F.col("b"), 6))
    order = F.row_number().over(Window.partitionBy("column", "band").orderBy(F.desc("posts"), "job"))
    return cells.withColumn("rank", order).where(F.col("rank") <= per_cell).select("column", "band", "rank", "job", "posts")


# Fixed value: bins of a cluster's distribution along a dimension.
RADIAL_BINS = 14


def cluster_model(jobs: DataFrame, most: float, bins: int = RADIAL_BINS) -> DataFrame:
    """(cluster, place, posts, dim, centre, spread) for each cluster and dimension: place by posts (most first, ties by name), the mean of the
    vectors weighted by posts, and how many posts lie in each of `bins` equal steps from 0 to `most` (values beyond are in the outer ones).

    jobs (job, cluster, posts, vector): rows with a null cluster or vector, or without posts, are left out; null components count for nothing.
    Components are summed by cluster, dimension and step where they are; no cluster's vectors are gathered.
    """
    kept = jobs.where("cluster IS NOT NULL AND vector IS NOT NULL AND posts > 0")
    totals = kept.groupBy("cluster").agg(F.sum("posts").alias("posts"))
    ordered = totals.withColumn("place", F.row_number().over(Window.orderBy(F.desc("posts"), "cluster")))  # a row for each cluster
    parts = kept.select("cluster", F.col("posts").alias("w"), F.posexplode("vector").alias("dim", "v")).where("v IS NOT NULL").withColumn("v", F.col("v").cast("double"))
    step = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col("v") / most * (bins - 1) + 0.5))).cast("int")
    stepped = parts.groupBy("cluster", "dim", step.alias("bin")).agg(F.sum("w").alias("w"), F.sum(F.col("v") * F.col("w")).alias("vw"))
    told = stepped.groupBy("cluster", "dim").agg((F.sum("vw") / F.sum("w")).alias("centre"), F.map_from_entries(F.collect_list(F.struct("bin", "w"))).alias("m"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.col("m")[b], F.lit(0)).cast("long"))
    return told.join(ordered, "cluster").select("cluster", "place", "posts", "dim", "centre", spread.alias("spread"))


def scoped_stacks(rows: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, stack, jobs, posts, rank): what stacks the jobs of a scope have, by how many jobs, then posts, then name.

    rows (scope columns, job, stack, posts): a job counts once for a stack, its posts add up; null stacks go.
    """
    counted = rows.where("stack IS NOT NULL").groupBy(*scope, "stack", "job").agg(F.sum("posts").alias("posts")).groupBy(*scope, "stack").agg(F.count("*").alias("jobs"), F.coalesce(F.sum("posts"), F.lit(0)).alias("posts"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("jobs"), F.desc("posts"), "stack")))
