"""Evidence of overlay entities: contribution, noisy-OR strength, roll-up, merging of sources, participation and promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.plans import params as P


def decay(date: Column, as_of: Column, half_life: Column) -> Column:
    """0.5 ** (age / half life); a missing date counts half, a future one has age 0."""
    age = F.greatest(F.datediff(as_of, date), F.lit(0))
    return F.when(date.isNull(), F.lit(P.UNKNOWN_DECAY)).otherwise(F.pow(F.lit(0.5), age / half_life))


def contribution(source: Column, tier: Column, confidence: Column, date: Column, as_of: Column) -> Column:
    """Source weight * confidence weight * decay: postings and tiered papers by their own weights (an unknown tier: the least), else news."""
    tier_weight = F.create_map(*[F.lit(x) for pair in P.TIER_WEIGHT.items() for x in pair])
    confidence_weight = F.create_map(*[F.lit(x) for pair in P.CONFIDENCE_WEIGHT.items() for x in pair])
    tiered = tier.isNotNull() & (tier != "")
    weight = F.when(source == "jd", P.JD_WEIGHT).when(tiered, F.coalesce(tier_weight[tier], F.lit(P.TIER_WEIGHT[""]))).otherwise(P.NEWS_WEIGHT)
    half_life = F.when(source == "jd", P.JD_HALF_LIFE).when(tiered, P.PAPER_HALF_LIFE).otherwise(P.NEWS_HALF_LIFE)
    return weight * F.coalesce(confidence_weight[confidence], F.lit(P.CONFIDENCE_WEIGHT["low"])) * decay(date, as_of, half_life)


def noisy_or(contrib: Column) -> Column:
    """1 - product(1 - c) over positive contributions; 0 without any."""
    return F.coalesce(1 - F.product(F.when(contrib > 0, 1 - contrib)), F.lit(0.0))


def known_by(date: Column, end: Column) -> Column:
    """Evidence counts up to the window's end; undated evidence always."""
    return date.isNull() | (date <= end)


def roll_up(evidence: DataFrame, by: str, digits: int = 4) -> DataFrame:
    """(by, n, strength, max_contrib, first_seen, last_seen, tiers) of evidence rows with `contrib`."""
    return evidence.groupBy(by).agg(
        F.count("*").alias("n"),
        F.round(noisy_or(F.col("contrib")), digits).alias("strength"),
        F.round(F.max("contrib"), digits).alias("max_contrib"),
        F.min("date").alias("first_seen"),
        F.max("date").alias("last_seen"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("tier") != "", F.col("tier")))), ",").alias("tiers"),
    )


def merge_same_name(entries: DataFrame, name: Column, source_order: list[str]) -> DataFrame:
    """One row per normalised name: the entry of the first source in order (then longest definition, then id) stands for it;
    sources and the earliest birth are gathered."""
    position = F.array_position(F.array(*map(F.lit, source_order)), F.col("source"))
    rank = F.struct(F.when(position == 0, 10_000).otherwise(position).alias("a"), (-F.length("definition")).alias("b"), F.col("id").alias("c"))
    return (
        entries.withColumn("norm", name)
        .groupBy("norm")
        .agg(F.min_by("id", rank).alias("id"), F.min_by("definition", rank).alias("definition"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min("born").alias("born"), F.count("*").alias("merged"))
    )


def participation(rolled: DataFrame) -> DataFrame:
    """Adds participates, pruned (weak single evidence) and dormant."""
    return rolled.withColumn("participates", F.col("strength") >= P.PARTICIPATE).withColumn("pruned", (F.col("strength") < P.MIN_STRENGTH) & (F.col("n") <= 1)).withColumn("dormant", F.col("strength") < P.PARTICIPATE)


def promotions(evidence: DataFrame, rolled: DataFrame, by: str, jobs: bool = False) -> DataFrame:
    """(by, strength, jd_docs) of the entities strong enough and confirmed by enough required postings."""
    strength, docs = (P.PROMOTE_JOBS, P.PROMOTE_DOCS_JOBS) if jobs else (P.PROMOTE, P.PROMOTE_DOCS)
    confirmed = evidence.where("source = 'jd' AND grade = 'require'").groupBy(by).agg(F.countDistinct("doc_id").alias("jd_docs"))
    return rolled.join(confirmed, by).where((F.col("strength") >= strength) & (F.col("jd_docs") >= docs)).select(by, "strength", "jd_docs")


def upsert(state: DataFrame, batch: DataFrame, key: list[str], order: str) -> DataFrame:
    """State after an idempotent upsert by key: the latest row of each key by `order`; a batch delivered twice changes nothing."""
    latest = Window.partitionBy(*key).orderBy(F.desc(order))
    return state.unionByName(batch).withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r").distinct()


def mint_codes(names: DataFrame, existing: DataFrame, prefix: str) -> DataFrame:
    """Next sequential codes for new names, in the order of their names: max + 1 on. Names are counted by their first two characters, and each is
    numbered among those that begin like it."""
    last = existing.agg(F.coalesce(F.max(F.regexp_extract("id", r"-(\d+)$", 1).cast("int")), F.lit(0)).alias("last"))
    begun = names.withColumn("_begin", F.substring("name", 1, 2))
    before = F.sum("_c").over(Window.orderBy("_begin").rowsBetween(Window.unboundedPreceding, -1))
    counts = begun.groupBy("_begin").agg(F.count("*").alias("_c")).select("_begin", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_begin").orderBy("name"))
    numbered = begun.withColumn("_n", number).join(counts, "_begin").crossJoin(F.broadcast(last))
    return numbered.select("name", F.format_string(f"{prefix}-%03d", F.col("last") + F.col("_before") + F.col("_n")).alias("id"))
