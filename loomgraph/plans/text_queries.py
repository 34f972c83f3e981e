"""Text operators over `documents`, `pages`, `conversations` and `benchmark`."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from loomgraph.functions import text as T
from loomgraph.operators import mentions, mining
from loomgraph.plans.registry import registry
from loomgraph.sources.interim import settle
from loomgraph.sources.tables import load

QUERIES, ORACLES, query = registry()


def documents(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")


_FP = "md5(trim(regexp_replace(coalesce(source, '') || chr(10) || coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))"


@query("text_fingerprint", f"SELECT doc_id, {_FP} AS fingerprint FROM documents")
def text_fingerprint(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.fingerprint(F.col("source"), F.col("text")).alias("fingerprint"))


_KEY = "md5(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))"


def _key():
    return F.md5(F.trim(F.regexp_replace("text", r"\s+", " ")))


@query("dedup_exact_keep_first", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_KEY}")
def dedup_exact_keep_first(spark, sf_dir):
    return mining.keep_first(documents(spark, sf_dir).select("doc_id", "text"), _key(), "doc_id").select("doc_id")


@query("dup_stats", f"WITH g AS (SELECT count(*) AS n FROM documents GROUP BY {_KEY}) SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_distinct, count(*) FILTER (n > 1) AS groups, sum(n - 1)::BIGINT AS extra, max(n) AS largest FROM g")
def dup_stats(spark, sf_dir):
    return mining.duplicate_stats(documents(spark, sf_dir), _key())


@query("norm_names", "SELECT p_partkey, lower(regexp_replace(p_name || '-' || p_brand, '[\\s、，,.;·\\-_（）()]', '', 'g')) AS norm, regexp_replace(lower(p_brand || ' (' || p_type || ')'), '[^a-z0-9一-鿿]', '', 'g') AS fold FROM part")
def norm_names(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    return part.select("p_partkey", T.norm_name(F.concat("p_name", F.lit("-"), "p_brand")).alias("norm"), T.fold_key(F.concat("p_brand", F.lit(" ("), "p_type", F.lit(")"))).alias("fold"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TOKENS = f"list_filter(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9+#.]{{1,17}}'), lambda t: lower(regexp_replace(t, '[.+#]+$', '')))), lambda t: length(t) >= 2 AND regexp_matches(t, '[a-z]') AND NOT list_contains([{_STOP}], t))"


@query("doc_freq_tokens", f"SELECT token, count(*) AS df FROM (SELECT unnest({_TOKENS}) AS token FROM documents) GROUP BY token HAVING count(*) >= 3")
def doc_freq_tokens(spark, sf_dir):
    return mining.document_frequency(documents(spark, sf_dir), T.english_tokens(F.col("text"))).where("df >= 3")


@query("english_tokens", f"SELECT item_id, len({_TOKENS})::INT AS n_tokens, array_to_string(list_sort({_TOKENS}), ' ') AS tokens FROM benchmark")
def english_tokens(spark, sf_dir):
    tokens = T.english_tokens(F.col("text"))
    return load(spark, sf_dir, "benchmark").select("item_id", F.size(tokens).alias("n_tokens"), F.array_join(F.array_sort(tokens), " ").alias("tokens"))


@query("ngram_df", "SELECT gram, count(*) AS df FROM (SELECT DISTINCT p_partkey, substr(p_name, i::INT, 3) AS gram FROM part, range(1, 40) t(i) WHERE i <= length(p_name) - 2) GROUP BY gram")
def ngram_df(spark, sf_dir):
    return mining.document_frequency(load(spark, sf_dir, "part"), T.char_ngrams(F.col("p_name"), 3)).withColumnRenamed("token", "gram")


_WORDS = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"


@query("apriori_ngrams", f"""WITH w AS (SELECT conv_id, turn, {_WORDS} AS w FROM conversations), g AS (
  SELECT DISTINCT conv_id, turn, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM w, range(1, 5) t(k), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) WHERE len(w) >= k)
SELECT gram, k::INT AS size, count(*) AS df FROM g GROUP BY gram, k HAVING count(*) >= 20""")
def apriori_ngrams(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").withColumn("doc", F.struct("conv_id", "turn"))
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    return mining.frequent_ngrams(rows, "doc", words, 20, 4)


@query("candidate_pool", f"""WITH w AS (SELECT conv_id, turn, {_WORDS} AS w FROM conversations), g AS (
  SELECT DISTINCT conv_id, turn, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM w, range(1, 4) t(k), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) WHERE len(w) >= k),
f AS (SELECT gram, k, count(*) AS df FROM g GROUP BY gram, k HAVING count(*) >= 5), n AS (SELECT greatest(1, floor(0.05 * count(*))) AS top FROM conversations),
l AS (SELECT part, max(df) AS d FROM (SELECT regexp_replace(gram, ' [^ ]*$', '') AS part, df FROM f UNION ALL SELECT regexp_replace(gram, '^[^ ]* ', ''), df FROM f) GROUP BY part),
v AS (SELECT DISTINCT unnest({_WORDS}) AS w FROM benchmark)
SELECT gram, k::INT AS size, f.df FROM f CROSS JOIN n LEFT JOIN l ON gram = part WHERE k >= 2 AND f.df <= top AND (d IS NULL OR f.df > 1.2::DOUBLE * d) AND string_split(gram, ' ')[1] NOT IN (FROM v)""")
def candidate_pool(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").withColumn("doc", F.struct("conv_id", "turn"))
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    grams = mining.frequent_ngrams(rows, "doc", words, 5, 3)
    top = rows.agg(F.greatest(F.lit(1), F.floor(0.05 * F.count("*"))).alias("top"))
    pool = mining.reduce_substrings(grams, 1.2).join(F.broadcast(top)).where("size >= 2 AND df <= top").drop("top")
    known = load(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("w")).where("w <> ''").distinct()
    return pool.join(known, F.substring_index("gram", " ", 1) == F.col("w"), "left_anti")


_SENTENCES = "list_transform(list_filter(list_transform(regexp_extract_all(text, '[^。；;！？!?\\n]*[。；;！？!?]|[^。；;！？!?\\n]+'), lambda s: trim(regexp_replace(s, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))), lambda s: length(s) >= 4), lambda s: substr(s, 1, 200))"


@query("sentence_split", f"SELECT doc_id, i::INT AS pos, s[i] AS sentence FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)")
def sentence_split(spark, sf_dir):
    rows = documents(spark, sf_dir)
    return rows.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos") + 1)


_HEADS = {"legal": "(?i:.*(?:licen[sc]e|copyright).*)", "body": "(?i:[a-z ]{1,20}[.])"}


@query("section_split", f"""WITH l AS (SELECT doc_id, i, x[i] AS line, len(x) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i)),
k AS (SELECT *, CASE WHEN regexp_full_match(trim(line), '{_HEADS["legal"]}') THEN 'legal' WHEN regexp_full_match(trim(line), '{_HEADS["body"]}') THEN 'body' END AS kind FROM l),
f AS (SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS now FROM k),
s AS (SELECT doc_id, sum(CASE WHEN kind IS NULL AND coalesce(now, '') <> 'legal' THEN length(line) + (i < n)::INT ELSE 0 END) AS kept, sum(CASE WHEN kind IS NULL AND coalesce(now, '') <> 'legal' THEN length(regexp_replace(line, '\\s', '', 'g')) ELSE 0 END) AS solid FROM f GROUP BY doc_id)
SELECT doc_id, CASE WHEN solid = 0 THEN length(text) ELSE kept END::BIGINT AS n_kept FROM s JOIN documents USING (doc_id)""")
def section_split(spark, sf_dir):
    kept = T.sections(F.col("text"), _HEADS, "legal")
    return documents(spark, sf_dir).select("doc_id", F.length(kept).cast("long").alias("n_kept"))


@query("evidence_collect", f"""WITH s AS (SELECT doc_id, i, s[i] AS sentence FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)),
t AS (SELECT token AS term FROM (SELECT unnest({_TOKENS}) AS token FROM documents) GROUP BY token HAVING count(*) BETWEEN 5 AND 20 AND regexp_matches(token, '^[a-z0-9]+$')),
w AS (SELECT DISTINCT doc_id, i, sentence, unnest(string_split_regex(lower(sentence), '[^a-z0-9]+')) AS term FROM s), h AS (SELECT term, doc_id, arg_min(sentence, i) AS sentence FROM w JOIN t USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS r FROM h) SELECT term, doc_id, sentence FROM r WHERE r <= 3""")
def evidence_collect(spark, sf_dir):
    rows = documents(spark, sf_dir)
    terms = mining.document_frequency(rows, T.english_tokens(F.col("text"))).where("df BETWEEN 5 AND 20 AND token RLIKE '^[a-z0-9]+$'").withColumnRenamed("token", "term")
    return mining.first_sentences(rows, "doc_id", T.sentences(F.col("text")), terms, 3)


@query("evidence_pool")
def evidence_pool(spark, sf_dir):
    """evidence_collect for all terms in 5 to a twentieth of the documents, a band that grows with the table; tested by brute force."""
    rows = documents(spark, sf_dir)
    top = rows.agg(F.floor(0.05 * F.count("*")).alias("top"))
    terms = mining.document_frequency(rows, T.english_tokens(F.col("text"))).join(F.broadcast(top)).where("df >= 5 AND df <= top AND token RLIKE '^[a-z0-9]+$'")
    return mining.first_sentences(rows, "doc_id", T.sentences(F.col("text")), terms.drop("top").withColumnRenamed("token", "term"), 3)


_DICTIONARY = {"NA": ["the", "and"], "NB": ["der", "und"], "NC": ["les", "par"], "ND": ["token", "gnu general"]}


def _hit(column: str, words: list[str]) -> str:
    return " OR ".join(f"regexp_matches(lower({column}), '(^|[^a-z0-9]){w}([^a-z0-9]|$)')" for w in words)


@query("keyword_scan_tier", "SELECT doc_id, array_to_string(list_sort(codes), ',') AS codes, tier FROM (SELECT doc_id, " + " || ".join(f"CASE WHEN ({_hit('head', w)}) THEN ['{c}'] ELSE [] END" for c, w in _DICTIONARY.items()) + " AS in_title, " + " || ".join(f"CASE WHEN ({_hit('body', w)}) THEN ['{c}'] ELSE [] END" for c, w in _DICTIONARY.items())
       + " AS in_body, CASE WHEN len(in_title) > 0 THEN in_title ELSE in_body END AS codes, CASE WHEN len(in_title) > 0 THEN 1 WHEN len(in_body) > 0 THEN 2 ELSE 0 END AS tier FROM (SELECT doc_id, string_split(text, chr(10))[1] AS head, text AS body FROM documents))")
def keyword_scan_tier(spark, sf_dir):
    found = mentions.scan(F.substring_index("text", "\n", 1), F.col("text"), _DICTIONARY, head=None)
    return documents(spark, sf_dir).select("doc_id", found.alias("f")).select("doc_id", F.array_join(F.array_sort("f.codes"), ",").alias("codes"), F.col("f.tier").alias("tier"))


_NAMES = ("red", "red widget", "widget", "ring", "small ring", "small", "brand#1")


@query("longest_match_suppression", f"""WITH t AS (SELECT p_partkey, concat_ws(' ', p_name, lower(p_type), lower(p_brand)) AS t FROM part), n AS (SELECT unnest({list(_NAMES)}) AS name),
h AS (SELECT p_partkey, name, unnest([i FOR i IN range(1, length(t) + 1) IF substr(t, i, length(name)) = name AND NOT regexp_matches(substr(' ' || t, i, 1), '[a-z0-9_-]') AND NOT regexp_matches(substr(t, i + length(name), 1), '[a-z_-]')]) AS s FROM t, n)
SELECT p_partkey, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (free), '') AS names FROM t LEFT JOIN (SELECT *, NOT EXISTS (SELECT 1 FROM h o WHERE o.p_partkey = h.p_partkey AND o.s <= h.s AND o.s + length(o.name) >= h.s + length(h.name) AND length(o.name) > length(h.name)) AS free FROM h) USING (p_partkey) GROUP BY p_partkey""")
def longest_match_suppression(spark, sf_dir):
    """Names found in part descriptions, without those inside a longer one."""
    text = F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand"))
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(mentions.longest_mentions(text, list(_NAMES)), ",").alias("names"))


@query("bigram_jaccard", """WITH b AS (SELECT item_id, list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i::INT, 2))) AS g FROM (SELECT item_id, regexp_replace(lower(text), '[[:punct:]\\s]', '', 'g') AS t FROM benchmark))
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(a.g || b.g)), 6) AS jaccard FROM b a JOIN b b ON b.item_id = a.item_id + 1""")
def bigram_jaccard(spark, sf_dir):
    items = load(spark, sf_dir, "benchmark")
    pairs = items.select(F.col("item_id").alias("a"), F.col("text").alias("x")).join(items.select(F.col("item_id").alias("b"), F.col("text").alias("y")), F.col("b") == F.col("a") + 1)
    return pairs.select("a", "b", F.round(T.bigram_jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


_TF = f"""w AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+#._-]*'), lambda t: regexp_replace(t, '[._-]+$', '')), lambda t: length(t) >= 2) AS w FROM conversations),
tf AS (SELECT conv_id * 1000 + turn AS doc, token, count(*) AS tf FROM (SELECT conv_id, turn, unnest(w) AS token FROM w) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
raw AS (SELECT doc, token, (1 + ln(tf)) * ln(((SELECT count(*) FROM w) + 1) / (df + 0.5::DOUBLE)) AS x FROM tf JOIN df USING (token)), v AS (SELECT doc, token, x / sqrt(sum(x * x) OVER (PARTITION BY doc)) AS weight FROM raw)"""


def _tfidf(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), "text")
    return mining.tfidf(rows, "doc", T.tfidf_tokens(F.col("text")))


@query("tfidf_top_terms", f"WITH {_TF}, r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY round(weight, 6) DESC, token) AS r FROM v) SELECT doc, token, round(weight, 6) AS weight FROM r WHERE r <= 5")
def tfidf_top_terms(spark, sf_dir):
    rows = _tfidf(spark, sf_dir).withColumn("weight", F.round("weight", 6))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("weight"), "token"))).where(F.col("_r") <= 5).drop("_r")


@query("tfidf_cosine_topk", f"WITH {_TF}, s AS (SELECT a.doc AS query, b.doc, sum(a.weight * b.weight) AS score FROM v a JOIN v b ON a.token = b.token AND a.doc <> b.doc WHERE a.doc // 1000 % 50 = 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM s) SELECT query, doc, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def tfidf_cosine_topk(spark, sf_dir):
    vectors = settle(_tfidf(spark, sf_dir), "tfidf")
    return mining.sparse_cosine_top_k(vectors, "doc", vectors.where("doc div 1000 % 50 = 0"), 5).withColumn("score", F.round("score", 6))


@query("json_props", "SELECT event_type, (props->>'$.k')::INT // 10 AS bucket, count(*) AS n, max((props->>'$.k')::INT) AS most FROM events GROUP BY ALL")
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return load(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type", F.floor(F.col("k") / 10).alias("bucket")).agg(F.count("*").alias("n"), F.max("k").alias("most"))


@query("packed_map_roundtrip", "SELECT p_brand, string_agg(p_type || ':' || n, ';' ORDER BY p_type) AS packed, count(*) AS n_keys FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand")
def packed_map_roundtrip(spark, sf_dir):
    counts = load(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "n"))).alias("m"))
    packed = counts.select("p_brand", T.packed_map(F.col("m")).alias("packed"))
    return packed.select("p_brand", T.packed_map(T.unpacked_map(F.col("packed"))).alias("packed"), F.size(T.unpacked_map(F.col("packed"))).cast("long").alias("n_keys"))


@query("unsourced_metrics", "SELECT doc_id, len(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?(?:%|倍)')) AS n_metrics FROM documents WHERE regexp_matches(text, '[0-9]+(?:\\.[0-9]+)?(?:%|倍)') AND NOT regexp_matches(text, 'basis|compared|vs')")
def unsourced_metrics(spark, sf_dir):
    figure = r"[0-9]+(?:\.[0-9]+)?(?:%|倍)"
    rows = documents(spark, sf_dir).where(F.regexp_like("text", F.lit(figure)) & ~F.regexp_like("text", F.lit("basis|compared|vs")))
    return rows.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(figure), F.lit(0))).cast("long").alias("n_metrics"))


@query("readable_ratio", "SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE round(length(regexp_replace(text, '[^\\pL\\pN\\pP\\s]', '', 'g'))::DOUBLE / length(text), 6) END AS ratio FROM documents")
def readable_ratio(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.round(T.readable_ratio(F.col("text")), 6).alias("ratio"))


@query("snippet_clip", "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS snippet, substr(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 1, 60) AS head FROM documents")
def snippet_clip(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.clip(F.col("text"), 80).alias("snippet"), T.collapse(F.col("text"), 60).alias("head"))
