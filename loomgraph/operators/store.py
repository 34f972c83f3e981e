"""Upkeep of a store of entries: decisions on candidates, versioned state, taxonomy operations, refinement to a fixpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.functions.text import norm_name
from loomgraph.sources.interim import settle

# Which array of the store a candidate of a kind goes to.
ARRAYS = {"new_job": "new_jobs", "new_task": "new_tasks", "implied_task": "new_tasks", "new_skill": "new_skills", "capability_gap": "new_skills", "skillpoint": "skillpoints"}


def decide(candidates: DataFrame, taxonomy: DataFrame, entries: DataFrame) -> DataFrame:
    """`candidates` (cand, kind, name, status, map_to, merge_into) with norm, array, decision and target.

    taxonomy (code, name), entries (id, array, name). In this order a candidate is

    * reject: its status says so.
    * strengthen: it is mapped to a code of the taxonomy (target: the code).
    * merge: into an entry whose id it names, or an entry of its array with its normalised name (target: the id); an id that
      isn't there counts as none.
    * skip: a kind that has no array, or a name that is empty once normalised.
    * new: else, the first candidate (by cand) of an array and name; the others merge into what that one becomes (target: null).

    Of several entries of one name the one with the smallest id is meant. Names are counted before they meet the entries: a name that a third of all
    candidates has is a row for each task. Null statuses and names are allowed; repeated rows are decided alike, but for one new row.
    """
    array = F.create_map(*[F.lit(x) for pair in ARRAYS.items() for x in pair])[F.col("kind")]
    rows = candidates.withColumns({"array": array, "norm": F.nullif(norm_name(F.col("name")), F.lit(""))})
    codes = taxonomy.where("code IS NOT NULL").groupBy(F.col("code").alias("map_to")).agg(F.lit(True).alias("_mapped"))
    ids = entries.where("id IS NOT NULL").groupBy(F.col("id").alias("merge_into")).agg(F.lit(True).alias("_there"))
    named = entries.groupBy("array", norm_name(F.col("name")).alias("norm")).agg(F.min("id").alias("_same"))
    asked = rows.where("norm IS NOT NULL AND array IS NOT NULL").groupBy("array", "norm").agg(F.min(F.when(F.coalesce(F.col("status") != "reject", F.lit(True)), F.struct("cand"))).alias("_first"))
    known = asked.join(named, ["array", "norm"], "left").select("array", "norm", "_same")
    out = rows.join(codes, "map_to", "left").join(ids, "merge_into", "left").join(known, ["array", "norm"], "left")
    strengthens = F.col("_mapped").isNotNull()
    merges = F.col("_there").isNotNull() | F.col("_same").isNotNull()
    decision = F.when(F.col("status") == "reject", "reject").when(strengthens, "strengthen").when(F.col("_there").isNotNull(), "merge").when(F.col("array").isNull() | F.col("norm").isNull(), "skip").when(merges, "merge").otherwise("new")
    target = F.when(strengthens, F.col("map_to")).when(F.col("_there").isNotNull(), F.col("merge_into")).otherwise(F.col("_same"))
    out = out.withColumn("decision", decision).withColumn("target", F.when(F.col("decision").isin("strengthen", "merge"), target))
    firsts = out.where("decision = 'new'").groupBy("array", "norm").agg(F.min("cand").alias("_founder"))
    out = out.join(firsts, ["array", "norm"], "left")
    joins = (F.col("decision") == "new") & (F.col("cand") > F.col("_founder"))
    return out.withColumn("decision", F.when(joins, "merge").otherwise(F.col("decision"))).select(*candidates.columns, "array", "norm", "decision", "target")


class VersionedTable:
    """A table as a log of versions below a path: each holds the rows that it changed, and `read` takes each key's last one.

    Writing a version again replaces it, so a failed or repeated run does no harm. A row with `gone` true ends its key.
    """

    def __init__(self, spark, path: str, key: list[str]):
        self.spark, self.path, self.key = spark, path, key

    def write(self, changes: DataFrame, version: int) -> None:
        """`changes`: the key, other columns and `gone`; one row for each key."""
        changes.write.mode("overwrite").parquet(f"{self.path}/version={version}")

    def log(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(self.path)

    def read(self, version: int | None = None) -> DataFrame:
        """The state as of a version (the last one, if none is given), by one aggregation over the log up to it."""
        rows = self.log() if version is None else self.log().where(F.col("version") <= version)
        others = [c for c in rows.columns if c not in self.key and c != "version"]
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*others), "version").alias("r"))
        return last.select(*self.key, "r.*").where("NOT gone").drop("gone")


def mutate(state: DataFrame, operations: DataFrame, prefix: str = "T") -> DataFrame:
    """What a batch of operations changes in a taxonomy: rows (code, name, definition, gone) for a `VersionedTable`.

    state (code, name, definition), operations (seq, op, code, other, name, definition):

    * merge: `other` into `code`: its definition is added behind `；`, it goes. Several into one are added by seq. Both must be there and
      differ; an entry that another merge of the batch takes away takes none in, and goes into the first that asks for it.
    * modify: name and definition of `code` where given; of several the last that gives one. It is done before merges.
    * add: a new entry, unless an entry has its exact name; of several adds of one name the first. Codes go on behind the highest number.

    Batches are worked one after the other; within one the kinds are worked in the order modify, merge, add. Null names are never added.
    """
    given = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq")))
    edits = operations.where("op = 'modify'").groupBy("code").agg(given("name").alias("_name"), given("definition").alias("_definition"))
    edited = state.join(edits, "code", "left").select("code", F.coalesce("_name", "name").alias("name"), F.coalesce("_definition", "definition").alias("definition"), (F.col("_name").isNotNull() | F.col("_definition").isNotNull()).alias("changed"))
    present = edited.select("code", "definition")
    asked = operations.where("op = 'merge' AND code <> other").select("seq", F.col("code").alias("into"), F.col("other").alias("code"))
    asked = asked.join(present, "code").join(present.select(F.col("code").alias("into")), "into", "left_semi")
    first = asked.groupBy("code").agg(F.min(F.struct("seq", "into", "definition")).alias("m")).select("code", "m.*")
    taken = first.select(F.col("code").alias("into")).distinct()
    merges = first.join(taken, "into", "left_anti")
    texts = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("seq", "code", "definition"))), lambda x: x["definition"]), lambda d: F.coalesce(d != "", F.lit(False))), "；")
    gained = merges.groupBy(F.col("into").alias("code")).agg(texts.alias("_gained"))
    left = edited.join(gained, "code", "left").join(merges.select("code", F.lit(True).alias("_lost")), "code", "left")
    joined = F.when(F.coalesce("_gained", F.lit("")) == "", F.col("definition")).otherwise(F.concat_ws("；", F.nullif("definition", F.lit("")), "_gained"))
    changed = left.where("changed OR _gained IS NOT NULL OR _lost").select("code", "name", joined.alias("definition"), F.coalesce("_lost", F.lit(False)).alias("gone"))
    adds = operations.where("op = 'add' AND name IS NOT NULL").groupBy("name").agg(F.min(F.struct("seq", "definition")).alias("a")).join(left.where("_lost IS NULL").select("name").distinct(), "name", "left_anti")
    number = F.regexp_extract("code", rf"^{prefix}-(\d+)$", 1).try_cast("long")
    highest = state.agg(F.coalesce(F.max(number), F.lit(0)).alias("highest"))
    rank = F.row_number().over(Window.orderBy("a.seq", "name"))  # the names that one batch adds, not the table
    code = F.concat(F.lit(f"{prefix}-"), F.lpad((F.col("highest") + rank).cast("string"), 2, "0"))
    added = adds.crossJoin(F.broadcast(highest)).select(F.when(F.length((F.col("highest") + rank).cast("string")) > 2, F.concat(F.lit(f"{prefix}-"), (F.col("highest") + rank).cast("string"))).otherwise(code).alias("code"), "name", "a.definition", F.lit(False).alias("gone"))
    return changed.unionByName(added)


Propose = Callable[[DataFrame, DataFrame], DataFrame]


def refine(work: DataFrame, state: DataFrame, propose: Propose, supervise: Callable[[DataFrame, DataFrame], DataFrame], most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Propose, supervise and apply until nothing is left to look at: (state, log).

    work (item, …): what is looked at first. state (name, …). propose(work, state) gives (item, name) for items that the state doesn't
    cover; names that the state has, and repeats, are taken out. supervise(names, state) gives those of (name, support) that are
    approved. Approved names are added to the state. Looked at again are only items whose proposal was approved, so what a
    round looks at shrinks, and each item at most `most` times in all. An item whose proposals are all rejected, or that is covered, is done.
    log (item, attempt, name, approved) has every proposal.
    """
    log, left = None, work
    for attempt in range(1, most + 1):
        names = state.select("name").distinct()
        proposed = settle(propose(left, state).select("item", "name").where("name IS NOT NULL").distinct().join(names, "name", "left_anti"), "proposals")
        asked = proposed.groupBy("name").agg(F.count("*").alias("support"))
        approved = settle(supervise(asked, state).select("name").distinct().join(asked.select("name"), "name", "left_semi"), "approved")
        told = proposed.join(approved.withColumn("approved", F.lit(True)), "name", "left").select("item", F.lit(attempt).alias("attempt"), "name", F.coalesce("approved", F.lit(False)).alias("approved"))
        log = told if log is None else log.unionByName(told)
        state = settle(state.unionByName(approved, allowMissingColumns=True), "state")
        left = settle(left.join(told.where("approved").select("item").distinct(), "item", "left_semi"), "work")
        if left.isEmpty():
            break
    return state, log
