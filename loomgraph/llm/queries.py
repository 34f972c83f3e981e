"""The corpus operators as queries over the driver's tables, with SQL where it can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.llm.ann import search
from loomgraph.llm.bytebpe import encode_documents, read_ranks, token_digests
from loomgraph.llm.filteraudit import AUDIT_SQL, audit_filters
from loomgraph.llm.htmltext import extract
from loomgraph.llm.langid import identify
from loomgraph.llm.lexical import SEARCH_SQL, search_items
from loomgraph.llm.mixing import MIX_SQL, mix_sources
from loomgraph.llm.packing import pack_documents
from loomgraph.llm.quality import QUALITY_SQL, quality
from loomgraph.llm.shared import shared_dir
from loomgraph.llm.simhash import simhash_components
from loomgraph.llm.suffixdedup import remove_repeats
from loomgraph.llm.urlfilter import JUDGE_SQL, PAGE_RULES, SPAM_PATTERNS, judge_urls
from loomgraph.llm.warc import ROUND_TRIP_SQL, archive_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return archive_round_trip(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, PAGE_RULES, SPAM_PATTERNS).select("page_id", "host", "path", "rule", "verdict")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return token_digests(encode_documents(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_QUERIES = (
    op1_simhash, op2_warc, op3_quality, op4_url_filter, op5_suffix_dedup, op6_langid, op7_ann, op8_html, op9_packing, op10_mixing,
    op11_filter_audit, op12_byte_bpe, op13_lexical,
)


def queries() -> dict[str, Query]:
    return {query.__name__: query for query in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": ROUND_TRIP_SQL, "op3_quality": QUALITY_SQL, "op4_url_filter": JUDGE_SQL, "op10_mixing": MIX_SQL, "op11_filter_audit": AUDIT_SQL, "op13_lexical": SEARCH_SQL}
