"""What comes in: strata of postings, units of papers, decisions of a judge, names that are too long, forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.functions.text import sentences

# Fixed values.
JOINTS = "的与及和、，,；;/"
KINDS = ("new_job", "new_task", "implied_task", "new_skill", "capability_gap", "skillpoint")
TAXONOMIES = ("jobs", "tasks", "skills")
NO_REASON = "粒度不符或与现有体系重复（未说明）"


def part_key(part: Column) -> Column:
    """A part of a function type with full-width characters as ASCII and runs of dots as `等`."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    return F.regexp_replace(F.translate(F.trim(part), wide + "　", "".join(chr(ord(c) - 0xFEE0) for c in wide) + " "), r"\.{2,}|…+", "等")


def strata(rows: DataFrame, types: str, mapping: DataFrame) -> DataFrame:
    """The rows with `stratum`: that of the first part of `types` (parts divided by `or`) that `mapping` (part, stratum) knows, null if none is.

    Of several strata of a part the smallest counts. Distinct values of `types` are resolved, not rows; null and empty ones have none.
    """
    known = mapping.where("part IS NOT NULL AND stratum IS NOT NULL").groupBy(part_key(F.col("part")).alias("_part")).agg(F.min("stratum").alias("stratum"))
    parts = rows.select(F.col(types).alias("_types")).where("_types IS NOT NULL").distinct().select("_types", F.posexplode(F.split("_types", r"\s+or\s+")).alias("_at", "_raw"))
    first = parts.withColumn("_part", part_key(F.col("_raw"))).where("_part <> ''").join(known, "_part").groupBy("_types").agg(F.min_by("stratum", "_at").alias("stratum"))
    return rows.join(first, F.col(types) == F.col("_types"), "left").drop("_types")


def paper_units(title: Column, keywords: Column, abstract: Column, evidence: Column) -> Column:
    """The units of a paper that mentions are looked for in: title, keywords, sentences of the abstract, evidence; empty ones and
    repeats left out, the first kept. Null parts are empty."""
    none = F.array().cast("array<string>")
    named = F.when(F.coalesce(title, F.lit("")) != "", F.array(F.concat(F.lit("标题："), title))).otherwise(none)
    words = F.when(F.size(F.coalesce(keywords, none)) > 0, F.array(F.concat(F.lit("关键词："), F.array_join(keywords, "; ")))).otherwise(none)
    told = F.transform(F.coalesce(evidence, none), lambda e: F.trim(e))
    units = F.concat(named, words, F.coalesce(sentences(abstract), none), told)
    return F.array_distinct(F.filter(units, lambda u: u.isNotNull() & (u != "")))


def validated(decisions: DataFrame, candidates: DataFrame, kinds: Sequence[str] = KINDS, taxonomies: Sequence[str] = TAXONOMIES) -> DataFrame:
    """(index, final_kind, name_zh, name_en, status, taxonomy, code, merge_into, reject_reason, reason) of the decisions on candidates that are there.

    decisions (index, status, final_kind, name_zh, name_en, taxonomy, code, merge_into, reject_reason, reason), all text; candidates (index, kind, name_zh,
    name_en). A status other than keep and reject is keep, an unknown kind the candidate's own, an empty name the candidate's; a mapping needs a known taxonomy and
    a code, and where there is one nothing is merged; a rejection without a reason says so. An index that is no number or
    no candidate's goes. Of several candidates of one index the one with the smallest name counts; repeated decisions stay.
    """
    bare = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    asked = candidates.where("index IS NOT NULL").groupBy("index").agg(F.min(F.struct("name_zh", "name_en", "kind")).alias("own"))
    rows = decisions.withColumn("index", F.trim("index").try_cast("long")).join(asked, "index")
    status = F.lower(bare("status"))
    kind = F.lower(bare("final_kind"))
    mapped = F.lower(bare("taxonomy")).isin(*taxonomies) & bare("code").isNotNull()
    rejected = F.coalesce(status == "reject", F.lit(False))
    reason = F.coalesce(bare("reject_reason"), F.when(rejected, F.lit(NO_REASON)).otherwise(F.lit("")))
    return rows.select(
        "index",
        F.when(kind.isin(*kinds), kind).otherwise(F.col("own.kind")).alias("final_kind"),
        F.coalesce(bare("name_zh"), "own.name_zh").alias("name_zh"),
        F.coalesce(bare("name_en"), "own.name_en").alias("name_en"),
        F.when(rejected, "reject").otherwise("keep").alias("status"),
        F.when(mapped, F.lower(bare("taxonomy"))).alias("taxonomy"),
        F.when(mapped, bare("code")).alias("code"),
        F.when(~F.coalesce(mapped, F.lit(False)), bare("merge_into")).alias("merge_into"),
        reason.alias("reject_reason"),
        F.coalesce(bare("reason"), F.lit("")).alias("reason"),
    )


def fitted_name(name: Column, most: int = 20) -> Column:
    """A name of at most `most` characters: the longest end behind a joint that leaves four characters or more, else the last ones
    without joints before them, else the first ones."""
    end = F.right(name, F.lit(most))
    joint = F.regexp_instr(F.substring(end, 1, most - 4), F.lit(f"[{JOINTS}]"))
    last = F.regexp_replace(end, f"^[{JOINTS} ]+", "")
    cut = F.when(joint > 0, F.substring(end, joint + 1, F.lit(most))).when(last != "", last).otherwise(F.substring(name, 1, most))
    return F.when(F.length(name) <= most, name).otherwise(cut)


def forecasts(rows: DataFrame, jobs: DataFrame, skills: DataFrame) -> DataFrame:
    """(quarter, job, skill, uni, cov, signal, last_share, n_hist) of forecasts by names: codes from jobs and skills (name, code), `signal` what
    covariates add. Rows whose job or skill has no code, or whose forecasts are no finite numbers, go; missing shares and numbers count 0.

    rows: text columns forecast_quarter, job, skill, p50_uni, p50_cov, last_share, n_hist_quarters, such as a CSV reader gives.
    """
    finite = lambda c: F.trim(c).try_cast("double")
    coded = lambda names, to: names.where("name IS NOT NULL").groupBy(F.col("name").alias(f"_{to}")).agg(F.min("code").alias(f"{to}_code"))
    told = rows.select(F.trim("forecast_quarter").alias("quarter"), F.trim("job").alias("_job"), F.trim("skill").alias("_skill"), finite("p50_uni").alias("uni"), finite("p50_cov").alias("cov"), finite("last_share").alias("share"), finite("n_hist_quarters").alias("n"))
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    kept = told.where(good("uni") & good("cov")).join(coded(jobs, "job"), "_job").join(coded(skills, "skill"), "_skill")
    number = lambda c: F.when(good(c), F.col(c)).otherwise(0.0)
    return kept.select("quarter", F.col("job_code").alias("job"), F.col("skill_code").alias("skill"), F.round("uni", 6).alias("uni"), F.round("cov", 6).alias("cov"), F.round(F.col("cov") - F.col("uni"), 6).alias("signal"), F.round(number("share"), 6).alias("last_share"), number("n").cast("int").alias("n_hist"))
