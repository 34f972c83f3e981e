"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.llm.shared import settle

#: Possessive form of the word rule: the matcher never steps back.
_WORDS = r"[^\x20\x09-\x0D]++"
#: Steps of the ranking variable at which words are summed before the exact cut.
STEPS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...], budget: float, cap: float) -> DataFrame:
    """Adds `target` to one row per source (source, source_size): shares by weight, none above cap * source_size.

    The level is the water line over capacity per weight: with sources in that order, each prefix counted as full
    gives a level, and the largest of them is where every source is at its cap or at level * weight. One row per
    source passes the single-partition windows, never rows of documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    full = F.lit(cap) * F.col("source_size")
    by_ratio = Window.orderBy((F.col("full") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.lit(budget) * F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    return (
        sources.withColumn("weight", weight)
        .withColumn("full", full)
        .withColumn("level", level)
        .withColumn("target", F.least("full", F.col("weight") * F.max("level").over(everything)))
        .select("source", "source_size", "target")
    )


def inclusion_odds(size: Column) -> Column:
    """A document's own odds of inclusion: they grow with the square root of its words, so fragments are the last to be repeated."""
    return F.sqrt(1 + size)


def _uniform(id_col: Column, content: Column, seed: int) -> Column:
    """Uniform in (0, 1) from the id and a digest of the text, the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(":"), content))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**48))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    budget: float = 1.5,
    cap: float = 2.0,
    seed: int = 1,
    odds_col: str | None = None,
) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken), one row per row of `docs`.

    A source's rate is target / source_size. The whole part of it is certain: that many copies of every document.
    The rest is a Pareto sample of a fixed size in words: documents are ranked by u / (1 - u) divided by their odds of inclusion,
    and the smallest ranks are taken up to the document that comes nearest the rest of the target. A document's odds are
    p / (1 - p) of its source times its own (`inclusion_odds` of its size, or `odds_col`: positive, null: 1).

    Ranks are cut exactly without sorting a source: words are summed by source and step of the rank, and only
    the rows of the step that holds the cut are ordered, by rank, id, size and digest of the text: rows that tie in all of these are
    equal, so every order of the input gives the same result. A null text has size 0; the null source
    is a source; a source of size 0 has target 0. Repeated rows are documents of their own. Empty table: empty result.
    """
    size = word_count(F.col(text_col))
    odds = F.coalesce(F.col(odds_col).cast("double"), F.lit(1.0)) if odds_col else inclusion_odds(size)
    content = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    sized = settle(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), odds.alias("odds"), _uniform(F.col(id_col), content, seed).alias("u"), content.alias("digest")),
        "sizes",
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, budget, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = settle(
        targets.withColumn("certain", F.floor(rate))
        .withColumn("rest", F.greatest(F.col("target") - F.col("certain") * F.col("source_size"), F.lit(0.0)))
        .withColumn("p", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0)),
        "targets",
    )

    def by_source(rows: DataFrame, other: DataFrame) -> DataFrame:
        other = other.withColumnRenamed("source", "its_source")
        return rows.join(other, rows.source.eqNullSafe(other.its_source)).drop("its_source")

    inclusion = F.col("odds") * F.col("p") / (1 - F.col("p"))
    rank = F.when(F.col("p") > 0, F.col("u") / (1 - F.col("u")) / inclusion)
    step = F.when(F.col("rank").isNotNull(), F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * STEPS), F.lit(STEPS - 1)))
    ranked = by_source(sized, targets).withColumn("rank", rank).withColumn("step", step)
    sums = ranked.where("p > 0").groupBy("source", "step").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
    running = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        sums.withColumn("up_to", F.sum("words").over(running))
        .where("up_to >= rest")
        .groupBy("source")
        .agg(F.min(F.struct("step", (F.col("up_to") - F.col("words")).alias("before"))).alias("cut"))
        .select("source", F.col("cut.step").alias("cut_step"), F.col("cut.before").alias("before"))
    )
    bounds = settle(_left_by_source(targets, cut), "cuts")
    placed = by_source(sized, bounds).withColumn("rank", rank).withColumn("step", step)
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, 0)
    at_cut = placed.where("step = cut_step").withColumn("up_to", F.col("before") + F.sum("size").over(order))
    nearest = 2 * F.col("rest") >= 2 * F.col("up_to") - F.col("size")
    at_cut = at_cut.withColumn("extra", (nearest & (F.col("up_to") - F.col("size") < F.col("rest"))).cast("int")).drop("up_to")
    away = placed.where("step IS NULL OR cut_step IS NULL OR step <> cut_step")
    away = away.withColumn("extra", F.coalesce((F.col("step") < F.coalesce("cut_step", F.lit(STEPS))).cast("int"), F.lit(0)))
    copies = (F.col("certain") + F.col("extra")).cast("int")
    return at_cut.unionByName(away).select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def _left_by_source(targets: DataFrame, cut: DataFrame) -> DataFrame:
    cut = cut.withColumnRenamed("source", "cut_source")
    return targets.join(cut, targets.source.eqNullSafe(cut.cut_source), "left").drop("cut_source")


#: The same mix for DuckDB, with one running sum over each source's ranks.
MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(text, '')) AS digest,
    (CAST('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
    2.0::DOUBLE * source_size AS "full" FROM totals),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum("full") OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY "full" / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least("full", weight * max(level) OVER ()) AS target FROM levels),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS certain FROM targets),
rests AS (SELECT *, greatest(target - certain * source_size, 0) AS rest FROM rates),
ranked AS (
  SELECT s.doc_id, s.size, s.digest, r.*,
    CASE WHEN rest > 0 THEN u / (1 - u) / (sqrt(1.0::DOUBLE + s.size) * (rest / source_size) / (1 - rest / source_size)) END AS rank
  FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up_to FROM ranked)
SELECT doc_id, size, source_size, target,
  (size * (certain + CASE WHEN rank IS NOT NULL AND up_to - size < rest AND 2 * rest >= 2 * up_to - size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
"""
