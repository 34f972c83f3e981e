"""Names of items brought to their canonical form: aliases, folded spellings, retired names, names that stand for several."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from loomgraph.functions.text import fold_key
from loomgraph.operators.learning import remap


@dataclass(frozen=True)
class Registry:
    """canonicals (canonical, category), aliases (name, canonical, category), retired (id, target), expansions (name, targets array).

    Of several rows of one name the one with the smallest values counts; a retired canonical that is replaced by a retired one ends at the last.
    """

    canonicals: DataFrame
    aliases: DataFrame
    retired: DataFrame
    expansions: DataFrame


def _replaced(rows: DataFrame, column: str, registry: Registry) -> DataFrame:
    """The rows with a retired name in `column` replaced by the one that came after it."""
    ends = remap(registry.retired.select("id", "target").where("id IS NOT NULL AND target IS NOT NULL")).toDF(column, "_after")
    return rows.join(ends, column, "left").withColumn(column, F.coalesce("_after", column)).drop("_after")


def resolve(names: DataFrame, registry: Registry) -> DataFrame:
    """(name, canonical, category, layer) of each distinct name: by exact alias (`l2`), else by folded spelling of a canonical (`l1`), else
    itself without a category (`keep`).

    A canonical is its own alias. Of canonicals with one folded spelling the smallest counts. Names that fold to nothing are only found as aliases.
    """
    distinct = names.select("name").where("name IS NOT NULL").distinct()
    own = registry.canonicals.select(F.col("canonical").alias("name"), "canonical", "category", F.lit(1).alias("order"))
    told = registry.aliases.select("name", "canonical", "category", F.lit(0).alias("order")).unionByName(own).where("name IS NOT NULL AND canonical IS NOT NULL")
    exact = told.groupBy("name").agg(F.min(F.struct("order", "canonical", F.coalesce("category", F.lit("")).alias("category"))).alias("l2"))
    spelled = registry.canonicals.where("canonical IS NOT NULL").withColumn("key", fold_key(F.col("canonical"))).where("key <> ''")
    folded = spelled.groupBy("key").agg(F.min(F.struct("canonical", F.coalesce("category", F.lit("")).alias("category"))).alias("l1"))
    joined = distinct.join(exact, "name", "left").withColumn("key", fold_key(F.col("name"))).join(folded, "key", "left")
    layer = F.when(F.col("l2").isNotNull(), "l2").when(F.col("l1").isNotNull(), "l1").otherwise("keep")
    out = joined.select("name", F.coalesce("l2.canonical", "l1.canonical", "name").alias("canonical"), F.coalesce("l2.category", "l1.category", F.lit("")).alias("category"), layer.alias("layer"))
    known = _replaced(out.where("layer <> 'keep'"), "canonical", registry)
    return known.select(*out.columns).unionByName(out.where("layer = 'keep'"))


def normalised(rows: DataFrame, registry: Registry, keys: list[str], name: str = "name", place: str = "place") -> DataFrame:
    """(keys, canonical, place): each key's items in canonical form, once, at the place of the first; places run from 0 without gaps.

    A name whose folded spelling has an expansion stands for its targets, in their order, and isn't resolved further. Names are resolved once
    each, not once for each row; null names go.
    """
    used = rows.where(F.col(name).isNotNull()).select(*keys, F.col(name).alias("name"), F.col(place).alias("_at"))
    key = fold_key(F.col("name"))
    several = registry.expansions.where("size(targets) > 0").withColumn("_key", key).groupBy("_key").agg(F.min("targets").alias("targets"))
    asked = used.select("name").distinct().withColumn("_key", key).join(several, "_key", "left")
    spread = asked.where("targets IS NOT NULL").select("name", F.posexplode("targets").alias("_nth", "canonical"))
    spread = _replaced(spread, "canonical", registry).select("name", "_nth", "canonical")
    single = resolve(asked.where("targets IS NULL"), registry).select("name", F.lit(0).alias("_nth"), "canonical")
    meant = used.join(spread.unionByName(single), "name")
    first = meant.groupBy(*keys, "canonical").agg(F.min(F.struct("_at", "_nth")).alias("_first"))
    listed = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_first", "canonical"))).alias("_list"))
    return listed.select(*keys, F.posexplode("_list").alias("place", "_x")).select(*keys, F.col("_x.canonical").alias("canonical"), "place")


def backfill_stats(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """(by, n_raw, n_canonical, n_merged, n_distinct) of rows before and after normalisation."""
    raw = before.where("name IS NOT NULL").groupBy(by).agg(F.count("*").alias("n_raw"))
    now = after.groupBy(by, "canonical").agg(F.count("*").alias("n")).groupBy(by).agg(F.sum("n").alias("n_canonical"), F.count("*").alias("n_distinct"))
    joined = raw.join(now, by, "full").fillna(0, ["n_raw", "n_canonical", "n_distinct"])
    return joined.select(by, "n_raw", "n_canonical", (F.col("n_raw") - F.col("n_canonical")).alias("n_merged"), "n_distinct")
