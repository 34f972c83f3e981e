"""Posting sources and sinks: CSV months, JSON lines, JDBC tables, window-partitioned graph slices, packed summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from loomgraph.functions.text import packed_map

# Columns of a posting.
POSTING_COLUMNS = ("jobid", "job", "funtype", "salary", "place", "work_year", "degree", "company", "opentime", "job_information", "_table", "techstack", "level", "level_source")
POSTING_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in POSTING_COLUMNS])


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Posting CSVs: header, quoted fields with line ends, doubled quotes, UTF-8 with or without a byte order mark. Columns are
    taken by name; those a file lacks are empty strings, others are dropped."""
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)
    named = {c.lstrip("﻿"): c for c in raw.columns}
    return raw.select(*[(F.coalesce(F.col(f"`{named[c]}`"), F.lit("")) if c in named else F.lit("")).alias(c) for c in POSTING_COLUMNS])


def union_months(parts: list[DataFrame]) -> DataFrame:
    """One schema over all sources, missing columns empty, with the month of `opentime` (`unknown` where it has none)."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    month = F.regexp_extract(F.coalesce("opentime", F.lit("")), r"^\d{4}-\d{2}", 0)
    return out.na.fill("").withColumn("month", F.when(month == "", "unknown").otherwise(month))


def write_months(rows: DataFrame, path: str) -> None:
    """Parquet by month; a rerun replaces the months it has and leaves the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank and broken lines are left out."""
    parsed = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r"), "value")
    return parsed.where(F.col("r").isNotNull() & F.col("value").startswith("{")).select("r.*")


def read_table(spark: SparkSession, url: str, table: str, categories: DataFrame, category: str, limit_per_category: int = 0, order: str = "jobid", **options: str) -> DataFrame:
    """A database table over JDBC, cut to known categories by a semi join, and to the first rows of each by `order` if a limit is set."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return limit_categories(rows.join(categories.select(category), category, "left_semi"), category, limit_per_category, order)


def limit_categories(rows: DataFrame, category: str, limit: int, order: str) -> DataFrame:
    from loomgraph.operators.sampling import per_group_limit

    return per_group_limit(rows, [category], [order], limit) if limit else rows


def last_wins(log: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of an append-only log with the last of each key by `order`."""
    others = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("r")).select(key, "r.*")


def write_slice(edges: DataFrame, path: str, window: str, layer: str, force: bool = False) -> None:
    """Edges of one window and layer. An existing slice stays unless `force` is set; other slices are never touched."""
    rows = edges.withColumn("window", F.lit(window)).withColumn("layer", F.lit(layer))
    if not force and has_slice(edges.sparkSession, path, window, layer):
        raise ValueError(f"slice {window}/{layer} exists")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window", "layer").parquet(path)


def read_slices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)


def has_slice(spark: SparkSession, path: str, window: str, layer: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        found = read_slices(spark, path)
    except AnalysisException:  # nothing was written there yet
        return False
    return not found.where((F.col("window").cast("string") == window) & (F.col("layer") == layer)).isEmpty()


def list_slices(spark: SparkSession, path: str) -> DataFrame:
    """(window, sort_key) of the slices, months and quarters together; a quarter sorts with its last month."""
    window = F.col("window").cast("string")
    year = F.substring(window, 1, 4).cast("int")
    quarter = F.regexp_extract(window, r"-Q(\d)$", 1).try_cast("int")
    key = year * 12 + F.coalesce(quarter * 3, F.substring(window, 6, 2).try_cast("int"))
    return read_slices(spark, path).select(window.alias("window"), key.alias("sort_key")).distinct().where("sort_key IS NOT NULL").orderBy("sort_key", "window")


def summary_rows(vectors: DataFrame, names: DataFrame, variants: DataFrame) -> DataFrame:
    """One row per related posting that isn't a near copy: codes as names `a|b`, maps as `k:v;k:v`.

    `vectors` has jd_key, it_related, skills (array), levels (map); `names` is code -> name; `variants` lists near copies' jd_key.
    """
    kept = vectors.where("it_related").join(variants.select("jd_key"), "jd_key", "left_anti")
    lookup = names.agg(F.map_from_entries(F.collect_list(F.struct("code", "name"))).alias("m"))  # a taxonomy, not documents
    named = lambda code: F.coalesce(F.try_element_at(F.col("m"), code), code)
    return kept.join(F.broadcast(lookup)).select("jd_key", F.array_join(F.transform("skills", named), "|").alias("skills"), packed_map(F.col("levels")).alias("levels"))


def to_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def envelope(edges: DataFrame, window: str, relation: str, version: str = "1.0") -> DataFrame:
    """One JSON document: header fields, number of edges and the edges sorted. For a slice of a taxonomy-sized graph."""
    packed = edges.agg(F.count("*").alias("total"), F.array_sort(F.collect_list(F.struct("src", "dst", "weight"))).alias("edges"))
    return packed.select(F.to_json(F.struct(F.lit(version).alias("schema_version"), F.lit(window).alias("window"), F.lit(relation).alias("relation"), "total", "edges")).alias("json"))


def timeline_mapping(rows: DataFrame, date: Column) -> DataFrame:
    """Rows in order of date, undated last, then of file."""
    return rows.withColumn("_d", F.coalesce(F.nullif(date, F.lit("")), F.lit("9999"))).orderBy("_d", "source_file").drop("_d")
