"""Candidates against jobs: skill vectors, coverage, experience and degree, staged learning paths, plans, remapping of retired items."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.functions.text import char_ngrams
from loomgraph.operators.matching import attain
from loomgraph.sources.interim import settle


def skill_vector(owned: DataFrame, edges: DataFrame, floor: float = 0.05) -> DataFrame:
    """(candidate, skill, value): the mean proficiency of the points a candidate holds, weighted by the edges skill -> point.

    The edges are of the taxonomy and go to every executor: a join by point would deal all candidates by a few points.
    """
    weight = F.greatest("weight", F.lit(floor))
    linked = owned.join(F.broadcast(edges.select(F.col("src").alias("skill"), F.col("dst").alias("point"), weight.alias("w"))), "point")
    return linked.groupBy("candidate", "skill").agg((F.sum(F.col("proficiency") * F.col("w")) / F.sum("w")).alias("value"))


def coverage(asked: DataFrame, by: list[str], weight: str, required: str, own: str) -> DataFrame:
    """(by, coverage): share of the weight that is attained."""
    got = attain(F.coalesce(own, F.lit(0.0)), F.coalesce(required, F.lit(0.0)))
    return asked.groupBy(*by).agg(F.sum(F.col(weight) * got).alias("num"), F.sum(weight).alias("den")).select(*by, F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(0.0).alias("coverage"))


def experience_score(years: Column, target: Column) -> Column:
    """1 at the target, a slow decline down to .82 beyond it, a loss of each missing year's share below it."""
    return F.when(years >= target, F.greatest(F.lit(0.82), 1 - (years - target) / 26)).otherwise(F.greatest(F.lit(0.0), 1 - (target - years) / F.greatest(target, F.lit(3))))


def degree_score(have: Column, want: Column) -> Column:
    """1 if none is wanted, else have over want, 1 at most."""
    return F.when(want <= 0, 1.0).otherwise(F.least(F.lit(1.0), have / want))


def staged_path(items: DataFrame, points: DataFrame, owned: DataFrame, an_item: int = 6, a_stage: int = 6) -> DataFrame:
    """(candidate, stage, step, point) from items (candidate, skill, gap) and points (skill, point, score, stage).

    Items by gap, each with its `an_item` best points that the candidate doesn't hold; a stage takes the first `a_stage` distinct ones.
    """
    ranked = items.withColumn("i", F.row_number().over(Window.partitionBy("candidate").orderBy(F.desc("gap"), "skill")))
    offered = ranked.join(points, "skill").join(owned.select("candidate", "point"), ["candidate", "point"], "left_anti")
    best = offered.withColumn("k", F.row_number().over(Window.partitionBy("candidate", "skill").orderBy(F.desc("score"), "point"))).where(F.col("k") <= an_item)
    first = best.groupBy("candidate", "stage", "point").agg(F.min(F.struct("i", "k")).alias("at"))
    step = F.row_number().over(Window.partitionBy("candidate", "stage").orderBy("at", "point"))
    return first.withColumn("step", step).where(F.col("step") <= a_stage).select("candidate", "stage", "step", "point")


def path_plan(gaps: DataFrame, nodes: DataFrame, achieved: DataFrame) -> DataFrame:
    """(candidate, skill, status, steps): NONE for a satisfied requirement, VERIFY_FIRST where evidence is missing, GRAPH_UNAVAILABLE for a
    skill without development nodes, else PLANNED with its nodes (skill, node, level) in topological order, without achieved ones.

    A gap stays one row: its skill's nodes are at hand on every executor, and what a candidate has achieved is one array."""
    graphs = nodes.groupBy("skill").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "node"))), lambda x: x["node"]).alias("graph"))
    own = achieved.groupBy("candidate").agg(F.collect_set("node").alias("own"))
    open_ = F.col("gap").isin("LEARN", "LEVEL_GAP") & F.col("candidate").isNotNull()
    steps = F.when(open_, F.filter("graph", lambda n: ~F.coalesce(F.array_contains("own", n), F.lit(False))))
    status = F.when(F.col("gap") == "SATISFIED", "NONE").when(F.col("gap") == "EVIDENCE_INSUFFICIENT", "VERIFY_FIRST").when(F.col("graph").isNull(), "GRAPH_UNAVAILABLE").otherwise("PLANNED")
    joined = gaps.join(own, "candidate", "left").join(F.broadcast(graphs), "skill", "left").withColumn("status", status)
    none = F.array().cast("array<string>")
    return joined.select("candidate", "skill", "status", F.when(F.col("status") == "PLANNED", F.coalesce(steps, none)).otherwise(none).alias("steps"))


def resolve_terms(asked: DataFrame, terms: DataFrame) -> DataFrame:
    """(skill, status, term): the first term of the skill's graph, in its order, that equals one of the skill's points without regard to case.

    `asked` is (skill, points array), `terms` (skill, pos, term)."""
    graph = terms.groupBy("skill").agg(F.array_sort(F.collect_list(F.struct("pos", F.lower("term").alias("term")))).alias("graph"))
    joined = asked.join(graph, "skill", "left")
    wanted = F.transform("points", lambda p: F.lower(p))
    hits = F.filter("graph", lambda g: F.array_contains(wanted, g["term"]))
    term = F.when(F.size(hits) > 0, F.element_at(hits, 1)["term"])
    status = F.when(F.coalesce(F.size("points"), F.lit(0)) <= 0, "NO_SKILL_POINTS").when(F.col("graph").isNull(), "NO_GRAPH").when(term.isNotNull(), "MATCHED").otherwise("NO_MATCH")
    return joined.select("skill", status.alias("status"), F.when(status == "MATCHED", term).alias("term"))


def remap(retired: DataFrame) -> DataFrame:
    """(id, target) with chains followed to their end, by pointer jumping: each round doubles what is followed, so as many rounds as the
    number of rows has binary digits reach every end. Ids in a cycle, or that lead to one, keep themselves.

    `retired` is (id, target), one target an id."""
    state = settle(retired.select("id", "target", F.lit(False).alias("done")))
    for _ in range(state.count().bit_length() + 1):
        onward = state.select(F.col("id").alias("target"), F.col("target").alias("next"), F.col("done").alias("sure"))
        joined = state.join(onward, "target", "left")
        ended = F.col("done") | F.col("next").isNull()
        state = settle(joined.select("id", F.when(ended, F.col("target")).otherwise(F.col("next")).alias("target"), (ended | F.col("sure")).alias("done")))
        if state.where("NOT done").isEmpty():
            break
    return state.select("id", F.when(F.col("done"), F.col("target")).otherwise(F.col("id")).alias("target"))


def soft_matches(predicted: list[str], gold: list[str], least: int = 3) -> tuple[int, int, int]:
    """(tp, fp, fn) of two lists of normalised names, matched one to one in the order of `gold`: equal, or one of `least` or more characters
    is part of the other."""
    free = list(predicted)
    hits = 0
    for g in gold:
        found = next((p for p in free if p == g or len(g) >= least and g in p or len(p) >= least and p in g), None)
        if found is not None:
            free.remove(found)
            hits += 1
    return hits, len(free), len(gold) - hits


def soft_prf(rows: DataFrame, predicted: str, gold: str) -> DataFrame:
    """One row (tp, fp, fn) over rows with two arrays of names: lower case, letters, digits and Chinese characters only. Null arrays are empty."""
    norm = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.regexp_replace(F.lower(x), r"[^a-z0-9\u4e00-\u9fff]", ""))

    def count(p: pa.Array, g: pa.Array) -> pa.Array:
        found = [soft_matches(x.as_py(), y.as_py()) for x, y in zip(p, g)]
        return pa.array([dict(zip(("tp", "fp", "fn"), f)) for f in found], pa.struct([(n, pa.int64()) for n in ("tp", "fp", "fn")]))

    counted = rows.select(F.arrow_udf(count, "tp long, fp long, fn long")(norm(predicted), norm(gold)).alias("c"))
    return counted.agg(*[F.coalesce(F.sum(f"c.{n}"), F.lit(0)).alias(n) for n in ("tp", "fp", "fn")])


def common_substring(a: Column, b: Column) -> Column:
    """Length of the longest common substring of two short strings."""
    at = lambda i: F.array_max(F.transform(F.sequence(F.lit(1), F.length(a) - i + 1), lambda n: F.when(F.contains(b, F.substring(a, i, n)), n).otherwise(0)))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.array_max(F.transform(F.sequence(F.lit(1), F.length(a)), at)))


def near_names(names: DataFrame, top: int = 2) -> DataFrame:
    """(name, near, score, rank): names with at least half of their characters in common, or a common substring of 4 or more.

    Names meet that share one of their rarest characters, so many that half of them in common includes one (a name of n characters is
    filed under n - ceil(n / 2) + 1), or four characters in a row; each pair is scored once. Names are taken once each, null ones go."""
    kept = names.select("name").where("name IS NOT NULL").distinct()
    chars = kept.select("name", F.array_distinct(F.split("name", "")).alias("cs"))
    held = chars.select(F.explode("cs").alias("c")).groupBy("c").agg(F.count("*").alias("held"))
    ordered = chars.select("name", F.explode("cs").alias("c")).join(held, "c").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("held", "c"))).alias("o"))
    rare = ordered.select("name", F.explode(F.slice("o", F.lit(1), (F.size("o") - F.ceil(F.size("o") / 2) + 1).cast("int"))).alias("x")).select("name", F.concat(F.lit("c"), "x.c").alias("key"))
    runs = kept.select("name", F.explode(F.array_distinct(char_ngrams(F.col("name"), 4))).alias("g")).select("name", F.concat(F.lit("g"), "g").alias("key"))
    filed = rare.unionByName(runs)
    pairs = filed.join(filed.toDF("near", "key"), "key").where("name <> near").select("name", "near").distinct()
    sets = lambda c: F.array_distinct(F.split(c, ""))
    both = F.size(F.array_intersect(sets("name"), sets("near")))
    scored = pairs.withColumn("share", both / F.greatest(F.size(sets("name")), F.size(sets("near")))).withColumn("lcs", common_substring(F.col("name"), F.col("near")))
    scored = scored.where("share >= 0.5 OR lcs >= 4").withColumn("score", F.round(F.greatest("share", F.col("lcs") / 8), 3))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "near"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("name", "near", "score", "rank")


def source_mix(base: Column, effective: Column) -> Column:
    """Struct (jd, overlay, confidence, status) of an edge from its base and effective weight."""
    delta = F.greatest(F.lit(0.0), effective - base)
    total = F.when(base + delta == 0, 1.0).otherwise(base + delta)
    confidence = F.when(base > 0, F.least(F.lit(0.98), 0.62 + F.sqrt(base) * 0.36)).otherwise(0.55)
    return F.struct(F.round(base / total, 6).alias("jd"), F.round(delta / total, 6).alias("overlay"), F.round(confidence, 6).alias("confidence"), F.when(base <= 0, "candidate").when(delta > 1e-6, "strengthening").otherwise("active").alias("status"))


def uniform(key: Column) -> Column:
    """Pseudo-random number in [0, 1) that depends on the key alone."""
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") / F.lit(float(2**48))


def band(u: Column, shares: list[Column]) -> Column:
    """First band whose cumulative share is above u; the last one if none is."""
    out, upto = None, F.lit(0.0)
    for i, share in enumerate(shares):
        upto = upto + share
        out = F.when(u < upto, i) if out is None else out.when(u < upto, i)
    return out.otherwise(len(shares) - 1)


def month_span(span: Column, now: Column) -> Column:
    """Months of `2019.03-2021.05` (ends included); an open end (`至今`, `now`) is the month `now` (yyyy.MM). Null if it doesn't parse."""
    number = lambda text: F.substring(text, 1, 4).cast("int") * 12 + F.substring(text, 6, 2).cast("int")
    begin = F.regexp_extract(span, r"^\s*(\d{4}[./]\d{2})\s*[-~]", 1)
    end = F.regexp_extract(span, r"[-~]\s*(\d{4}[./]\d{2}|至今|now)\s*$", 1)
    till = F.when(end.isin("至今", "now"), now).otherwise(end)
    return F.when((begin != "") & (end != ""), number(F.nullif(till, F.lit(""))) - number(F.nullif(begin, F.lit(""))) + 1)


def dormancy(strength: DataFrame, key: str, window: str, value: str, least: float = 0.15) -> DataFrame:
    """Adds `state`: dormant below the least strength, revived when it was dormant in the window before, else active. Nothing is dropped."""
    asleep = F.col(value) < least
    before = F.lag(asleep).over(Window.partitionBy(key).orderBy(window))
    return strength.withColumn("state", F.when(asleep, "dormant").when(F.coalesce(before, F.lit(False)), "revived").otherwise("active"))


def calendar_holes(seen: DataFrame, calendar: DataFrame, key: str, window: str) -> DataFrame:
    """(key, holes, prefix): windows of the calendar that a key lacks, and how many it has before the first of them."""
    windows = calendar.agg(F.array_sort(F.collect_set(window)).alias("windows"))  # one row, as long as the calendar
    expected = seen.select(key).distinct().join(F.broadcast(windows)).select(key, F.posexplode("windows").alias("pos", window))
    marked = expected.join(seen.select(key, window).distinct().withColumn("has", F.lit(True)), [key, window], "left")
    return marked.groupBy(key).agg(F.count_if(F.col("has").isNull()).alias("holes"), F.coalesce(F.min(F.when(F.col("has").isNull(), F.col("pos"))), F.count("*")).cast("long").alias("prefix"))
