"""Seven checks of what a person claims against what their text tells, and experiences linked to what a job asks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.functions.text import char_ngrams
from loomgraph.operators.setsim import classes, in_reach, similar_sets
from loomgraph.sources.interim import at_hand, dealt, settle

# Fixed values.
BASIS = "测试集|评测集|验证集|基准|基线|同一批|对比组|口径|A/B|人工评测|个查询|条样本"
FIGURE = r"\d+(\.\d+)?\s*%|\d+(\.\d+)?\s*倍"
COUNT = r"([一-龥A-Za-z0-9-]{2,10})\s*(\d+)\s*(篇|项)"
UNMARKED = "[\\s　·、，。：；（）()／/]"
RISK, WATCH = 18, 8
CHECKS = ("claims", "proficiency", "timeline", "basis", "echo", "focus", "counts")


def character_pairs(text: Column) -> Column:
    return char_ngrams(F.regexp_replace(text, UNMARKED, ""), 2)


def echoes(lines: DataFrame, snippets: DataFrame, people: DataFrame, least: float = 0.3, grams=character_pairs) -> DataFrame:
    """(doc, echo, n_lines): the greatest similarity of a person's lines (doc, text) to snippets (job, text) of their job (people: doc, job),
    if it is `least` or more, and how many line and snippet pairs are.

    Sets are made of texts that differ, and only of those that can be similar to a snippet; lines and snippets alike in their sets are
    compared once, the join lists similar sets only, see `similar_sets`. Lines meet the texts found where they lie: few texts are
    like a snippet, but some are in every person's lines.
    """
    snippet_sets, snippet_of = classes(snippets, "job", grams(F.col("text")))
    snippet_sets = settle(snippet_sets, "sets")
    texts = in_reach(dealt(lines.select("text").distinct(), "text"), grams(F.col("text")), snippet_sets, least)
    line_sets, text_of = classes(settle(texts, "texts"), "text", grams(F.col("text")))
    pairs = settle(similar_sets(settle(line_sets, "sets"), snippet_sets, least), "echoes")
    asked = snippet_of.distinct().select(F.col("doc").alias("job"), F.col("set_id").alias("b"))
    by_job = pairs.join(asked, "b").groupBy("a", "job").agg(F.max("similarity").alias("similarity"), F.count("*").alias("n"))
    alike = settle(text_of.toDF("text", "a").join(pairs.select("a").distinct(), "a"), "alike")
    own = lines.join(at_hand(alike, "text"), "text").groupBy("doc", "a").agg(F.count("*").alias("copies")).join(people.select("doc", "job"), "doc")
    found = own.join(by_job, ["a", "job"])
    return found.groupBy("doc").agg(F.max("similarity").alias("echo"), F.sum(F.col("copies") * F.col("n")).alias("n_lines"))


def count_conflicts(lines: DataFrame, pattern: str = COUNT, thing: int = 1, number: int = 2, unit: int = 3) -> DataFrame:
    """(doc, n_conflicts): things that a person's lines count differently. One pattern names thing, number and unit."""
    at = F.explode(F.arrays_zip(*[F.regexp_extract_all("text", F.lit(pattern), F.lit(g)).alias(n) for g, n in ((thing, "thing"), (number, "number"), (unit, "unit"))]))
    told = lines.select("doc", at.alias("x")).groupBy("doc", "x.thing", "x.unit").agg(F.min(F.col("x.number").cast("decimal(38,0)")).alias("a"), F.max(F.col("x.number").cast("decimal(38,0)")).alias("b"))
    return told.groupBy("doc").agg(F.count_if(F.col("a") < F.col("b")).alias("n_conflicts"))


def _graded(n: Column) -> Column:
    return F.when(n == 0, "pass").when(n <= 2, "watch").otherwise("risk")


def audit(people: DataFrame, points: DataFrame, experiences: DataFrame, lines: DataFrame, snippets: DataFrame, noise: Sequence[str], basis: str = BASIS, figure: str = FIGURE, counts: tuple = (COUNT, 1, 2, 3), least: float = 0.3, grams=character_pairs) -> DataFrame:
    """One row for each of `people` (doc, years, job) with what seven checks count, their levels, how many are `risk` and `watch`, and a score.

    points (doc, name, listed, told, proficiency, anchors, category): a skill point, whether the skill list and whether an experience
    names it, its own rating, how many lines name it. experiences (doc, months, kind). lines (doc, text). snippets (job, text).

    * claims: listed points that no experience tells of. 0 pass, to 2 watch, else risk.
    * proficiency: points rated 0.7 or more that one line at most names. Likewise.
    * timeline: months of experiences other than competitions over declared years * 12 beyond 0.7 to 1.25: watch. No years: 1.
    * basis: lines with a figure but no word on what it is measured against. Likewise as claims.
    * echo: similarity to the job's postings of `least` or more, or 2 boilerplate phrases or more: watch.
    * focus: 5 categories or more, none of them with 0.4 of the points that have one: watch.
    * counts: a thing counted differently in two lines: watch.

    score = max(0, 100 - 18 risk - 8 watch). What isn't there (null, no rows) counts as nothing found. Each table is summed by
    person before it is joined.
    """
    lines, points = settle(lines.select("doc", "text"), "lines"), settle(points, "points")  # read several times below
    flagged = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    of_points = points.groupBy("doc").agg(
        flagged(F.col("listed") & ~F.coalesce("told", F.lit(False))).alias("n_listed_only"),
        flagged((F.col("proficiency") >= 0.7) & (F.coalesce("anchors", F.lit(0)) <= 1)).alias("n_overrated"),
        F.count("*").alias("n_points"),
    )
    by_category = points.where("category IS NOT NULL").groupBy("doc", "category").agg(F.count("*").alias("n"))
    of_categories = by_category.groupBy("doc").agg(F.count("*").alias("n_categories"), (F.max("n") / F.sum("n")).alias("focus"))
    of_months = experiences.where("kind IS NULL OR kind <> 'competition'").groupBy("doc").agg(F.sum("months").alias("months"))
    bare = F.regexp_like("text", F.lit(figure)) & ~F.regexp_like("text", F.lit(basis))
    phrases = F.size(F.filter(F.array(*map(F.lit, noise)), lambda p: F.contains("text", p))) if noise else F.lit(0)
    of_lines = lines.groupBy("doc").agg(flagged(bare).alias("n_unbacked"), F.coalesce(F.sum(phrases), F.lit(0)).alias("n_boilerplate"))
    out = people.select("doc", "years", "job")
    for found in (of_points, of_categories, of_months, of_lines, echoes(lines, snippets, people, least, grams), count_conflicts(lines, *counts)):
        out = out.join(found, "doc", "left")
    zero = ("n_listed_only", "n_overrated", "n_points", "n_categories", "months", "n_unbacked", "n_boilerplate", "n_conflicts")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero}).withColumns({"echo": F.coalesce("echo", F.lit(0.0)), "focus": F.coalesce("focus", F.lit(0.0))})
    ratio = F.when(F.col("years") > 0, F.col("months") / (F.col("years") * 12)).otherwise(1.0)
    watch = lambda c: F.when(c, "watch").otherwise("pass")
    levels = {
        "claims": _graded(F.col("n_listed_only")),
        "proficiency": _graded(F.col("n_overrated")),
        "timeline": watch((ratio > 1.25) | (ratio < 0.7)),
        "basis": _graded(F.col("n_unbacked")),
        "echo": watch((F.col("echo") >= least) | (F.col("n_boilerplate") >= 2)),
        "focus": watch((F.col("n_categories") >= 5) & (F.col("focus") < 0.4)),
        "counts": watch(F.col("n_conflicts") > 0),
    }
    out = out.withColumn("month_ratio", ratio).withColumns({f"{c}_level": levels[c] for c in CHECKS})
    number = lambda level: sum((F.when(F.col(f"{c}_level") == level, 1).otherwise(0) for c in CHECKS), F.lit(0))
    out = out.withColumns({"risk": number("risk"), "watch": number("watch")})
    return out.withColumn("score", F.greatest(F.lit(0), 100 - RISK * F.col("risk") - WATCH * F.col("watch"))).drop("n_lines", "years", "job", "n_points")


def link_experiences(claims: DataFrame, required: DataFrame, most: int = 6, least: float = 0.08) -> DataFrame:
    """(doc, experience, coverage, hits): which part of a job's requirement each experience covers.

    claims (doc, experience, job, skill, owned), required (job, skill, required). Skills required at `least` or more count, a skill by the
    share of it that is owned; coverage is their sum over all that the job requires, 1 at most. hits lists the `most` required first.
    An experience without such a skill has coverage 0 and no hits. What jobs require is of the taxonomy and goes to every executor: a join by
    job and skill would deal all claims by a few keys.
    """
    total = required.groupBy("job").agg(F.sum("required").alias("total"))
    owned = claims.groupBy("doc", "experience", "job", "skill").agg(F.max("owned").alias("owned"))
    asked = required.where(F.col("required") >= least).join(total, "job")
    met = owned.join(F.broadcast(asked), ["job", "skill"])
    part = F.col("required") * F.least(F.lit(1.0), F.col("owned") / F.greatest(F.col("required"), F.lit(0.05)))
    hit = F.struct((-F.col("required")).alias("order"), "skill", F.round("required", 3).alias("required"), F.round("owned", 3).alias("owned"))
    found = met.groupBy("doc", "experience").agg(F.least(F.lit(1.0), F.sum(part) / F.max("total")).alias("coverage"), F.slice(F.array_sort(F.collect_list(hit)), 1, most).alias("hits"))
    every = claims.select("doc", "experience").distinct()
    hits = F.transform(F.coalesce("hits", F.array().cast(found.schema["hits"].dataType)), lambda h: F.struct(h["skill"].alias("skill"), h["required"].alias("required"), h["owned"].alias("owned")))
    return every.join(found, ["doc", "experience"], "left").select("doc", "experience", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), hits.alias("hits"))
