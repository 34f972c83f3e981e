"""Whole-text sources: news with header lines, papers with bracketed headers, metadata-first selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, folder, text) of each file below `path`."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    name = F.col("_metadata.file_path")
    return raw.select(F.regexp_extract(name, r"([^/]+)$", 1).alias("source_file"), F.regexp_extract(name, r"([^/]+)/[^/]+$", 1).alias("folder"), F.col("value").alias("text"))


def _header(text: Column, field: str) -> Column:
    """Value of a `field: value` line before the first separator or blank line."""
    head = F.regexp_extract(text, r"(?s)\A(.*?)(?:\n-{3,}\s*\n|\n\s*\n|\z)", 1)
    return F.nullif(F.trim(F.regexp_extract(head, rf"(?im)^{field}\s*[:：]\s*(.*?)\s*$", 1)), F.lit(""))


def _body(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"(?s)(?:\n-{3,}\s*\n|\n\s*\n)(.*)\z", 1))


def parse_news(files: DataFrame, min_chars: int = 200) -> DataFrame:
    """(doc_id, title, source, pub_date, crawled_at, body, source_file): the publication date, else the crawl date; the title, else
    the body's first line; the source, else the folder. Files with bodies shorter than `min_chars` are left out."""
    body = _body(F.col("text"))
    published, crawled = (F.regexp_extract(F.coalesce(_header(F.col("text"), f), F.lit("")), r"\d{4}-\d{2}-\d{2}", 0) for f in ("published", "crawled"))
    title = F.coalesce(_header(F.col("text"), "title"), F.trim(F.substring_index(body, "\n", 1)))
    rows = files.select(
        F.md5("text").alias("doc_id"), title.alias("title"), F.coalesce(_header(F.col("text"), "source"), F.col("folder")).alias("source"),
        F.coalesce(F.nullif(published, F.lit("")), F.nullif(crawled, F.lit(""))).alias("pub_date"), F.nullif(crawled, F.lit("")).alias("crawled_at"), body.alias("body"), "source_file",
    )
    return rows.where(F.length("body") >= min_chars)


def paper_date(name: Column) -> Column:
    """First day of the month in a `YYMM.NNNNN` file name; null for others."""
    stamp = F.regexp_extract(name, r"(\d{2})(\d{2})\.\d{4,5}", 0)
    year, month = F.substring(stamp, 1, 2).try_cast("int"), F.substring(stamp, 3, 2).try_cast("int")
    return F.when(month.between(1, 12), F.make_date(2000 + year, month, F.lit(1)))


def abstract_of(text: Column, most: int = 1500, least: int = 200) -> Column:
    """The paragraph after an abstract marker, else the first paragraph of `least` characters or more; cut at `most`."""
    marked = F.trim(F.regexp_extract(text, r"(?is)(?:^|\n)\s*(?:abstract|摘\s*要)\s*[:：.\-—]?\s*\n?(.+?)(?:\n\s*\n|\n\s*(?:keywords?|index terms|关键词|1\.?\s+introduction)\b|\z)", 1))
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: F.length(p) >= least)
    return F.substring(F.coalesce(F.nullif(marked, F.lit("")), F.try_element_at(paragraphs, F.lit(1))), 1, most)


def keywords_of(text: Column, most: int = 12) -> Column:
    line = F.regexp_extract(text, r"(?im)^\s*(?:keywords?|index terms|关键词)\s*[:：\-—]\s*(.+)$", 1)
    return F.slice(F.filter(F.transform(F.split(line, "[,;，；、]"), lambda k: F.trim(k)), lambda k: k != ""), 1, most)


def parse_papers(files: DataFrame) -> DataFrame:
    """(title, tier, pub_date, abstract, keywords, file_md5, source_file): tier from the folder, date from a header or the file name;
    of files with one name and content the first folder's stays."""
    tier = F.regexp_extract("folder", "^([SABC])(?:$|[^A-Za-z])", 1)
    told = F.regexp_extract("text", r"(?m)^\[date\]\s*(\d{4}-\d{2}-\d{2})", 1).try_cast("date")
    title = F.trim(F.regexp_extract("text", r"(?m)^\[title\]\s*(.+)$", 1))
    rows = files.select(
        "source_file", "folder", F.md5("text").alias("file_md5"), title.alias("title"), tier.alias("tier"), F.coalesce(told, paper_date(F.col("source_file"))).alias("pub_date"), abstract_of(F.col("text")).alias("abstract"), keywords_of(F.col("text")).alias("keywords")
    )
    others = [c for c in rows.columns if c not in ("source_file", "file_md5")]
    return rows.groupBy("source_file", "file_md5").agg(F.min_by(F.struct(*others), F.col("folder")).alias("r")).select("source_file", "file_md5", "r.*").drop("folder")


def selected_files(mapping: DataFrame, listing: DataFrame, slack: int = 5) -> DataFrame:
    """Files to parse: those in both the mapping and the listing, or the whole listing if they differ in more than `slack` names."""
    both = mapping.select("source_file", F.lit(1).alias("m")).join(listing.select("source_file", F.lit(1).alias("l")), "source_file", "full_outer")
    apart = both.agg(F.count_if(F.col("m").isNull() | F.col("l").isNull()).alias("apart"))
    return both.join(F.broadcast(apart)).where(F.col("l").isNotNull() & (F.col("m").isNotNull() | (F.col("apart") > slack))).select("source_file")
