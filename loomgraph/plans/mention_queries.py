"""Mentions of dictionaries in `documents`, and items that résumés list."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import mentions as M
from loomgraph.plans.registry import registry
from loomgraph.plans.resumes import RESUME_SQL, resumes
from loomgraph.sources.tables import load

QUERIES, ORACLES, query = registry()

_SPLIT = "[^\\pL\\pN]+"


def dictionary(spark, sf_dir):
    """All runs of two to four words of the benchmark's items, in lower case: some 20,000 names at scale 0.1."""
    words = load(spark, sf_dir, "benchmark").select(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("w"))

    def runs(n: int):
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))

    return words.select(F.explode(F.concat(runs(2), runs(3), runs(4))).alias("name")).distinct()


_DICTIONARY = f"""words AS (SELECT list_filter(string_split_regex(lower(text), '{_SPLIT}'), lambda w: w <> '') AS w FROM benchmark),
dictionary AS (SELECT DISTINCT array_to_string(w[i:i + n - 1], ' ') AS name FROM words, unnest([2, 3, 4]) AS s(n), unnest(range(1, len(w) - n + 2)) AS p(i))"""
#: Each occurrence is looked for behind the one before; ASCII names in lower case and free of letters and digits, others as written.
_HITS = f"""WITH RECURSIVE {_DICTIONARY},
folded AS (SELECT doc_id, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
cased AS (SELECT name, regexp_matches(name, '^[\\x00-\\x7F]*$') AS ascii, length(name) AS size FROM dictionary),
placed AS (SELECT doc_id, name, ascii, size, CASE WHEN ascii THEN low ELSE text END AS hay, instr(CASE WHEN ascii THEN low ELSE text END, name) AS pos FROM folded JOIN cased ON contains(CASE WHEN ascii THEN low ELSE text END, name)
    UNION ALL SELECT doc_id, name, ascii, size, hay, CASE WHEN instr(substr(hay, pos + 1), name) > 0 THEN pos + instr(substr(hay, pos + 1), name) ELSE 0 END FROM placed WHERE pos > 0),
hits AS (SELECT doc_id, name, pos - 1 AS start, pos - 1 + size AS "end" FROM placed WHERE pos > 0 AND NOT (ascii AND (regexp_matches(substr(hay, pos + size, 1), '[a-z0-9]') OR pos > 1 AND regexp_matches(substr(hay, pos - 1, 1), '[a-z0-9]'))))"""


@query("dictionary_mentions", _HITS + """ SELECT h.doc_id, h.name, h.start::INT AS start, h."end"::INT AS "end",
NOT EXISTS (SELECT 1 FROM hits o WHERE o.doc_id = h.doc_id AND o.start <= h.start AND o."end" >= h."end" AND o."end" - o.start > h."end" - h.start) AS outermost FROM hits h""")
def dictionary_mentions(spark, sf_dir):
    """Every occurrence of every name in all documents, and whether a longer one covers it."""
    return M.mentions(load(spark, sf_dir, "documents"), "doc_id", "text", dictionary(spark, sf_dir)).withColumnsRenamed({"doc": "doc_id", "outer": "outermost"})


@query("mention_totals", _HITS + " SELECT name, count(*) AS n_hits, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM hits GROUP BY name")
def mention_totals(spark, sf_dir):
    """Per name, summed for each document first, so that a name which every document repeats is a row a document."""
    found = M.mentions(load(spark, sf_dir, "documents"), "doc_id", "text", dictionary(spark, sf_dir))
    by_doc = found.groupBy("name", "doc").agg(F.count("*").alias("n"))
    return by_doc.groupBy("name").agg(F.sum("n").alias("n_hits"), F.count("*").alias("n_docs"), F.min("doc").alias("first_doc"))


@query("listed_mentions", f"""WITH {RESUME_SQL}, items AS (SELECT DISTINCT candidate, text, trim(unnest(string_split(regexp_extract(text, '(?m)^Skills: (.*)$', 1), ','))) AS item FROM resumes)
SELECT candidate, item, (instr(text, item) - 1)::INT AS start, (instr(text, item) - 1 + length(item))::INT AS "end", 'explicit_technical_skill' AS kind FROM items WHERE item <> ''
UNION ALL SELECT candidate, line, (instr(text, line) - 1)::INT, (instr(text, line) - 1 + length(line))::INT, 'explicit_technical_skill'
FROM (SELECT candidate, text, unnest(['Experience', regexp_extract(text, '\\nExperience\\n([^\\n]*)', 1)]) AS line FROM resumes)""")
def listed_mentions(spark, sf_dir):
    """What résumés list under `Skills`. The two lines after the heading's count too, here a heading and an order's line."""
    return M.listed_mentions(resumes(spark, sf_dir), "candidate", "text", headings=("Skills",), refused=("Certificates",)).withColumnRenamed("doc", "candidate")


@query("first_points", f"""WITH {RESUME_SQL}, points AS (SELECT DISTINCT p_brand AS skill, p_name AS name FROM part WHERE length(p_name) >= 2),
found AS (SELECT candidate, name, instr(lower(text), lower(name)) - 1 AS start FROM resumes, (SELECT DISTINCT name FROM points) WHERE contains(lower(text), lower(name)))
SELECT candidate, skill, min(start)::INT AS start, count(*) AS points FROM found JOIN points USING (name) GROUP BY ALL""")
def first_points(spark, sf_dir):
    points = load(spark, sf_dir, "part").select(F.col("p_brand").alias("skill"), F.col("p_name").alias("name"))
    return M.first_points(resumes(spark, sf_dir), "candidate", "text", points).withColumnRenamed("doc", "candidate")


@query("trimmed_names", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name) || ' ' || lower(p_type), '^(?:small |large |red |hot )+', ''), '(?: standard| promo| economy)+$', '') AS name FROM part")
def trimmed_names(spark, sf_dir):
    name = F.concat_ws(" ", F.lower("p_name"), F.lower("p_type"))
    return load(spark, sf_dir, "part").select("p_partkey", M.without_context(name, ("small ", "large ", "red ", "hot "), (" standard", " promo", " economy")).alias("name"))


_SIGNALS = "concat('技能：', p_name, '、', p_type, ', ', p_name, ' ；任务: ', p_brand, '，', p_name, ';技术栈：', p_type)"


@query("stated_signals", f"""WITH s AS (SELECT p_partkey, p_name, p_type, p_brand FROM part), x AS (SELECT p_partkey, '技能' AS kind, p_name AS name, 0 AS place FROM s UNION ALL SELECT p_partkey, '技能', p_type, 1 FROM s UNION ALL SELECT p_partkey, '技能', p_name, 2 FROM s UNION ALL SELECT p_partkey, '任务', p_brand, 1000 FROM s UNION ALL SELECT p_partkey, '任务', p_name, 1001 FROM s)
SELECT * FROM x WHERE kind = '技能' AND name IN (SELECT p_name FROM part WHERE p_size > 25) OR kind = '任务' AND name IN (SELECT p_brand FROM part WHERE p_size > 48)""")
def stated_signals(spark, sf_dir):
    parts = load(spark, sf_dir, "part")
    names = parts.where("p_size > 25").selectExpr("'技能' AS kind", "p_name AS name").unionByName(parts.where("p_size > 48").selectExpr("'任务' AS kind", "p_brand AS name"))
    return M.signals(parts.selectExpr("p_partkey", f"{_SIGNALS} AS t"), "p_partkey", "t", names).withColumnRenamed("doc", "p_partkey")


@query("mention_evidence", """WITH u AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INT AS place, unnest(string_split(text, chr(10))) AS unit FROM documents),
p AS (SELECT doc_id, unit, min(place) AS place FROM u GROUP BY ALL), n AS (SELECT unnest(['der', 'und', 'les', 'par', 'token', 'que']) AS name, unnest(['G', 'G', 'F', 'F', 'T', 'F']) AS code),
h AS (SELECT DISTINCT doc_id, place, unit, code FROM p JOIN n ON regexp_matches(lower(unit), '(^|[^a-z0-9])' || name || '([^a-z0-9]|$)')),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, code ORDER BY place, unit) AS nth FROM h)
SELECT doc_id, code, count(*) AS n, md5(string_agg(unit, chr(10) ORDER BY nth)) AS digest, 'medium' AS confidence FROM k WHERE nth <= 5 GROUP BY doc_id, code""")
def mention_evidence(spark, sf_dir):
    """The first five lines of each document that mention each code."""
    units = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("place", "unit"))
    names = spark.createDataFrame([("der", "G"), ("und", "G"), ("les", "F"), ("par", "F"), ("token", "T"), ("que", "F")], "name string, code string")
    found = M.mention_evidence(units, names)
    return found.select(F.col("doc").alias("doc_id"), "code", F.size("units").cast("long").alias("n"), F.md5(F.array_join("units", "\n").cast("binary")).alias("digest"), "confidence")
