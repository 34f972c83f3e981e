"""Mentions of a dictionary's names in texts, and items that texts list under a heading."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.functions.automaton import Dictionary, marked_again
from loomgraph.sources.interim import at_hand, dealt, settle

#: Bytes of names that one automaton takes; a larger dictionary is searched in several passes.
NAMES_BYTES = 32 << 20

# Fixed values of listed items.
HEADINGS = ("专业技能", "技能", "技术栈", "技能清单", "专业能力", "技术能力")
NOT_SKILLS = ("资格证书", "证书", "语言能力")
TECHNICAL = ("编程", "开发", "算法", "数据库", "机器学习", "深度学习", "计算机视觉", "数据分析", "数据建模", "建模", "容器", "云平台", "操作系统", "网络", "打印", "切割", "渲染", "仿真", "测试", "固件", "嵌入式")
SELF_CLAIMS = ("丰富的", "较强", "良好", "优秀", "能力", "经验", "阅读", "写作", "表达", "沟通", "责任", "抗压", "学习能力", "团队", "意识")
_TECHNICAL_ASCII = re.compile(r"[A-Za-z][A-Za-z0-9+#._/-]*")
_SEPARATORS = re.compile("[，,、；;|｜]+")
LONGEST_ITEM = 80

# Fixed values of names cut out of running text: words before and after them that are no part of them.
CONTEXT_BEFORE = ("熟悉", "掌握", "精通", "了解", "具备", "具有", "熟练", "负责", "要求", "需要", "使用", "进行", "参与", "协助", "完成", "独立", "深入", "擅长", "相关", "良好", "优秀", "以及", "任职", "优先", "较强的", "扎实的", "基本的", "一定的", "本科", "大专", "有", "善于", "能够")
CONTEXT_AFTER = ("经验", "能力", "要求", "相关", "工作", "背景", "优先", "人员", "知识", "技能", "水平", "意识", "精神", "思维", "学历", "的")


def dictionaries(names: DataFrame, name: str = "name", rule: str = "word", limit: int = NAMES_BYTES) -> Iterator[tuple[Dictionary, bool]]:
    """The names of a table as one dictionary, or as several of about `limit` bytes each, and whether it is the last.

    The driver holds one at a time.
    """
    kept = names.select(F.col(name).alias("name")).where("name <> ''").distinct()
    total = kept.agg(F.coalesce(F.sum(F.octet_length("name")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // limit))
    if blocks > 1:
        kept = settle(kept, "names")
    for block in range(blocks):
        part = kept.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block) if blocks > 1 else kept
        yield Dictionary([r.name for r in part.collect()], rule), block == blocks - 1


def with_hits(docs: DataFrame, text: str, names: DataFrame, name: str = "name", rule: str = "word", limit: int = NAMES_BYTES) -> DataFrame:
    """The rows with `hits`: every occurrence of every name in the text, overlapping ones too, in one pass over it.

    A hit's `outer` is false where a longer one covers it. Places count characters from 0. A dictionary of up to `limit` bytes
    (some million names) goes to the executors as it is; of a larger one they get part after part, and the rows with what is
    found so far are an interim table between. Nothing is shuffled. Null and empty texts and names give no hits; names that
    the table repeats count once; equal rows are treated alike.
    """
    rows, several = docs, False
    for dictionary, last in dictionaries(names, name, rule, limit):
        hits = dictionary.found(F.col(text))
        rows = rows.withColumn("hits", F.concat("hits", hits) if several else hits)
        if not last:
            rows, several = settle(rows, "hits"), True
            dictionary.sent.destroy()
    return rows.withColumn("hits", marked_again(F.col("hits"))) if several else rows


def mentions(docs: DataFrame, doc: str, text: str, names: DataFrame, name: str = "name", rule: str = "word", limit: int = NAMES_BYTES) -> DataFrame:
    """(doc, name, start, end, outer): a row for each occurrence, see `with_hits`."""
    rows = with_hits(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")), "text", names, name, rule, limit)
    return rows.select("doc", F.inline("hits"))


def scan(title: Column, body: Column, words: dict[str, list[str]], cap: int = 4, head: int | None = 4000) -> Column:
    """Struct (codes, tier): codes whose words are in the title (tier 1), else in the body or its head (tier 2), else none (0).

    Codes go by the place of their first word; at most `cap`. The table of words is a literal of the taxonomy's size.
    """
    codes = {w: sorted(c for c, own in words.items() if w in own) for own in words.values() for w in own}
    dictionary = Dictionary(codes)
    of_word = F.create_map(*[x for w, own in codes.items() for x in (F.lit(w), F.array(*map(F.lit, own)))])

    def found(text: Column) -> Column:
        places = F.flatten(F.transform(dictionary.found(text), lambda h: F.transform(of_word[h["name"]], lambda c: F.struct(h["start"].alias("at"), c.alias("code")))))
        return F.slice(F.array_distinct(F.transform(F.array_sort(places), lambda p: p["code"])), 1, cap)

    in_title, in_body = found(title), found(F.substring(body, 1, head) if head else body)
    tier = F.when(F.size(in_title) > 0, 1).when(F.size(in_body) > 0, 2).otherwise(0)
    return F.struct(F.when(F.size(in_title) > 0, in_title).otherwise(in_body).alias("codes"), tier.alias("tier"))


def longest_mentions(text: Column, names: list[str], rule: str = "tech") -> Column:
    """Names of a literal list that the text mentions outside a longer mention, by name."""
    free = F.filter(Dictionary(names, rule).found(text), lambda h: h["outer"])
    return F.array_sort(F.array_distinct(F.transform(free, lambda h: h["name"])))


def first_points(docs: DataFrame, doc: str, text: str, points: DataFrame) -> DataFrame:
    """(doc, skill, start, points) of each skill in each text: its first point's place and how many of its points are there.

    `points` (skill, name) may have a name under several skills. Names of one character aren't looked for. Any place counts.
    """
    named = points.where("length(name) >= 2 AND skill IS NOT NULL").select("skill", "name").distinct()
    found = mentions(docs, doc, text, named, rule="any").groupBy("doc", "name").agg(F.min("start").alias("start"))
    return dealt(found, "doc").join(at_hand(named, "name", NAMES_BYTES), "name").groupBy("doc", "skill").agg(F.min("start").alias("start"), F.count("*").alias("points"))


def mention_kind(item: Column) -> Column:
    any_of = lambda words: F.regexp_like(item, F.lit("|".join(words)))
    technical = F.regexp_like(item, F.lit(_TECHNICAL_ASCII.pattern)) | any_of(TECHNICAL)
    return F.when(technical, "explicit_technical_skill").when(any_of(SELF_CLAIMS), "explicit_self_claim").otherwise("explicit_unclassified_claim")


def listed_items(text: str, headings: Sequence[str], refused: Sequence[str]) -> list[tuple[str, int, int]]:
    """(item, start, end) of what a text lists under its headings: the rest of the heading's line and the two lines after it."""
    lines, out, seen = text.splitlines(), [], set()
    for i, line in enumerate(lines):
        first = line.strip()
        if not any(first == h or first.startswith((f"{h}：", f"{h}:")) for h in headings) or any(r in first for r in refused):
            continue
        block = "\n".join(lines[i : i + 3])
        heading = next(h for h in headings if h in first)
        block = block[block.find(heading) + len(heading) :].lstrip(" ：:\r\n\t")
        for item in (part.strip() for own in block.splitlines() for part in _SEPARATORS.split(own)):
            start = text.find(item) if 0 < len(item) <= LONGEST_ITEM else -1
            if start >= 0 and (item, start) not in seen:
                seen.add((item, start))
                out.append((item, start, start + len(item)))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def listed_mentions(docs: DataFrame, doc: str, text: str, headings: Sequence[str] = HEADINGS, refused: Sequence[str] = NOT_SKILLS) -> DataFrame:
    """(doc, item, start, end, kind) of the items that texts list under a heading of their own line.

    An item stands at its first place in the text. Headings that also name a certificate or a language list nothing. Items over
    80 characters, empty ones and repeats are left out; null texts and texts without a heading give no rows.
    """

    def search(texts: pa.Array) -> pa.Array:
        found = [[dict(zip(("item", "start", "end"), x)) for x in listed_items(t.as_py() or "", headings, refused)] for t in texts]
        return pa.array(found, pa.list_(pa.struct([("item", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    found = F.arrow_udf(search, "array<struct<item: string, start: int, end: int>>")(F.col(text))
    return docs.select(F.col(doc).alias("doc"), F.inline(found)).withColumn("kind", mention_kind(F.col("item")))


def without_context(name: Column, before: Sequence[str] = CONTEXT_BEFORE, after: Sequence[str] = CONTEXT_AFTER) -> Column:
    """A name without the context words around it, taken off until none is left; one that is context only becomes empty.

    A pass takes the first word of `before` that the name begins with, then the first of `after` that it ends with.
    """

    def strip(value: str) -> str:
        while True:
            start = next((len(w) for w in before if value.startswith(w)), 0)
            rest = value[start:]
            end = next((len(w) for w in after if rest.endswith(w)), 0)
            if not start + end:
                return value
            value = rest[: len(rest) - end]

    return F.arrow_udf(lambda names: pa.array([None if n.as_py() is None else strip(n.as_py()) for n in names], pa.string()), "string")(name)


# How a sentence states its signals, and how many units of a paper a mention keeps.
SIGNAL = r"(技能|任务|技术栈)\s*[:：]\s*([^；;]+)"
STACK = "技术栈"
MOST_UNITS = 5


def signals(rows: DataFrame, doc: str, text: str, names: DataFrame) -> DataFrame:
    """(doc, kind, name, place) of the names that sentences state as `技能：a、b；任务：c`, in their order, as often as they are stated.

    names (kind, name): only what is there counts; stacks are codes and are left out. Null texts and names give no rows.
    """
    fields = F.arrays_zip(F.regexp_extract_all(text, F.lit(SIGNAL), F.lit(1)).alias("kind"), F.regexp_extract_all(text, F.lit(SIGNAL), F.lit(2)).alias("list"))
    told = rows.select(F.col(doc).alias("doc"), F.posexplode(fields).alias("_field", "x")).where(F.col("x.kind") != STACK)
    split = told.select("doc", "_field", F.col("x.kind").alias("kind"), F.posexplode(F.split("x.list", "[、,，]")).alias("_at", "raw")).withColumn("name", F.trim("raw"))
    known = names.select("kind", "name").distinct()
    return split.join(at_hand(known, "name", NAMES_BYTES), ["kind", "name"]).select("doc", "kind", "name", (F.col("_field") * 1000 + F.col("_at")).alias("place"))


def mention_evidence(units: DataFrame, names: DataFrame, most: int = MOST_UNITS, rule: str = "word") -> DataFrame:
    """(doc, code, units, confidence): the first `most` units of each document that mention each code, as evidence of medium confidence.

    units (doc, place, unit), names (code, name). A unit counts once for a code however many of its names it holds; equal units
    of a document count once, at the first place. Units are cut to the first ones before they are gathered.
    """
    placed = units.where("unit IS NOT NULL").groupBy("doc", "unit").agg(F.min("place").alias("place"))
    hit = with_hits(placed, "unit", names, rule=rule).select("doc", "place", "unit", F.explode(F.array_distinct(F.transform("hits", lambda h: h["name"]))).alias("name"))
    coded = hit.join(names.select("code", "name").where("code IS NOT NULL").distinct(), "name").groupBy("doc", "code", "place", "unit").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("doc", "code").orderBy("place", "unit"))
    kept = coded.withColumn("nth", nth).where(F.col("nth") <= most)
    listed = kept.groupBy("doc", "code").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "unit"))), lambda x: x["unit"]).alias("units"))
    return listed.withColumn("confidence", F.lit("medium"))
