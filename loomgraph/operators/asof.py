"""Strengths of overlay entities recomputed from their raw evidence at the end of every window at once, and signal series of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.operators import overlay
from loomgraph.sources.interim import settle

#: Window ends are distinct days; so many are a century and more.
MOST_ENDS = 40_000
#: Rows of evidence of one task, which become as many times more as there are window ends.
PART = 50_000


def parts_of(evidence: DataFrame) -> int:
    """Parts to which evidence is dealt by entity: as many as its rows ask for, so that no task's table of entities and ends grows with the input."""
    return max(1, -(-evidence.count() // PART))


def window_ends(windows: DataFrame, end: str = "end_date") -> list:
    """The distinct days on which windows end, in order; a table of days, so its size is bounded by the calendar."""
    days = [r[0] for r in windows.select(F.col(end).cast("date")).where(F.col(end).isNotNull()).distinct().limit(MOST_ENDS + 1).collect()]
    if len(days) > MOST_ENDS:
        raise ValueError(f"more than {MOST_ENDS} window ends")
    return sorted(days)


def strengths_at(evidence: DataFrame, windows: DataFrame, by: list[str], digits: int | None = 4, end: str = "end_date", parts: int | None = None) -> DataFrame:
    """(by, end_date, n, strength, max_contrib, first_seen, last_seen) of each entity at each window end that knows of it.

    `evidence` has date, source, tier and confidence beside `by`, a row each; a row counts at the ends from its date on, an undated
    one at all, at the weight of an unknown age. Strength is 1 - product(1 - contribution), each contribution decayed to that end.

    Rows alike in entity, day and kind are counted first: a hot entity is as many rows as it has days and kinds. These are dealt by the
    entity, the first of `by`, and go to the ends that they count at where they are: the shuffle carries a row for each entity, day and
    kind, never one for each end, and whatever groups the result by that entity as well needs none. Nothing is joined or recomputed window by window.
    Repeated rows count again; a null entity is an entity; no evidence or no windows give no rows.
    """
    days = window_ends(windows, end)
    kinds = evidence.groupBy(*by, "date", "source", "tier", "confidence").agg(F.count("*").alias("n"))
    if parts is None:
        kinds = settle(kinds, "kinds")
        parts = parts_of(kinds)
    kinds = kinds.repartition(parts, by[0])
    ends = F.array(*[F.lit(d) for d in days]) if days else F.array().cast("array<date>")
    rows = kinds.withColumn("end_date", F.explode(ends)).where("date IS NULL OR end_date >= date")
    contrib = overlay.contribution(F.col("source"), F.col("tier"), F.col("confidence"), F.col("date"), F.col("end_date"))
    summed = rows.withColumn("c", contrib).groupBy(*by, "end_date").agg(
        F.sum("n").alias("n"),
        F.sum(F.when((F.col("c") > 0) & (F.col("c") < 1), F.col("n") * F.log1p(-F.col("c")))).alias("logs"),
        F.max("c").alias("most"),
        F.min("date").alias("first_seen"),
        F.max("date").alias("last_seen"),
    )
    strength = F.when(F.col("most") >= 1, 1.0).otherwise(F.coalesce(1 - F.exp("logs"), F.lit(0.0)))
    rounded = lambda c: c if digits is None else F.round(c, digits)
    return summed.select(*by, "end_date", "n", rounded(strength).alias("strength"), rounded(F.col("most")).alias("max_contrib"), "first_seen", "last_seen")


def signal_series(strengths: DataFrame, demand: DataFrame, entity: str = "entity", layer: str = "layer", parts: int | None = None) -> DataFrame:
    """(entity, layer, end_date, paper, news, jd, gap) of every entity at every end at which any of the three is known.

    `strengths` (entity, layer, end_date, source, strength): of several rows of one source the strongest counts. `demand` (entity,
    layer, end_date, value): shares of postings, taken relative to the layer's peak over all ends, so that they are on the scale of strengths.
    gap is what papers and news say beyond the postings: max(0, 0.7 paper + 0.3 news - jd). A source that says nothing counts 0.
    """
    of = lambda source: F.coalesce(F.max(F.when(F.col("source") == source, F.col("strength"))), F.lit(0.0))
    keys = [entity, layer, "end_date"]
    ahead = strengths.groupBy(*keys).agg(of("papers").alias("paper"), of("news").alias("news"))
    peaks = demand.groupBy(layer).agg(F.max("value").alias("peak"))
    value = demand.groupBy(*keys).agg(F.max("value").alias("value"))
    share = F.when(F.col("peak") > 0, F.col("value") / F.col("peak")).otherwise(F.col("value"))
    # layers are few; dealt as the strengths are, rows of one entity are together: no shuffle of a row for each entity and end
    posted = value.join(F.broadcast(peaks), layer).select(*keys, F.lit(None).cast("double").alias("paper"), F.lit(None).cast("double").alias("news"), share.alias("jd"))
    posted = posted.repartition(parts, entity) if parts else posted
    both = ahead.select(*keys, "paper", "news", F.lit(None).cast("double").alias("jd")).unionByName(posted)
    joined = both.groupBy(*keys).agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("paper", "news", "jd")])
    return joined.withColumn("gap", F.greatest(F.lit(0.0), 0.7 * F.col("paper") + 0.3 * F.col("news") - F.col("jd")))


def freshness(series: DataFrame, entity: str = "entity") -> DataFrame:
    """(entity, freshness): what papers and news say at the entity's last end, relative to the most they ever said; null if never."""
    said = 0.7 * F.col("paper") + 0.3 * F.col("news")
    rows = series.groupBy(entity).agg(F.max_by(said, "end_date").alias("last"), F.max(said).alias("peak"))
    return rows.select(entity, F.when(F.col("peak") > 0, F.col("last") / F.col("peak")).alias("freshness"))


def latest_window(postings: DataFrame, evidence: DataFrame, day: str = "date", today: Column | None = None) -> DataFrame:
    """One row (window): the last month of postings, else that of evidence, else today's."""
    last = lambda rows: rows.agg(F.date_format(F.max(day), "yyyy-MM").alias("m"))
    both = last(postings).select(F.col("m").alias("a")).crossJoin(last(evidence).select(F.col("m").alias("b")))
    return both.select(F.coalesce("a", "b", F.date_format(F.current_date() if today is None else today, "yyyy-MM")).alias("window"))
