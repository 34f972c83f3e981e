"""Audit of how filters interact: every order of them over counts of which documents fail which filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from loomgraph.llm.shared import WORD_PATTERN

#: Orders grow with the factorial of the filters; 40,320 for eight.
MOST_FILTERS = 8
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def single_swaps(n: int) -> Iterator[int]:
    """Places i, one for each order after the first: swapping the items at i and i + 1 visits every order of n once.

    The largest item walks from end to end; at each of its stops at an end the others take one step of their own walk.
    """
    if n < 2:
        return
    down = True
    inner = single_swaps(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + down  # the largest stands first after a walk down, so the others are one place further
        down = not down


class Walk:
    """The steps of one order after the other over cells: how many documents fail exactly the filters of a mask."""

    def __init__(self, cells: np.ndarray, filters: str):
        """cells: a row for each mask (bit i: filter i fails), with all, good and toxic documents."""
        self.cells, self.filters, n = cells, filters, len(filters)
        self.masks = np.arange(1 << n)
        self.order = list(range(n))
        self.steps = [self.step(i) for i in range(n)]
        self.visited, self.since, self.shapley = 0, [0] * n, [0] * n

    def step(self, at: int) -> tuple[int, ...]:
        own, before = 1 << self.order[at], sum(1 << f for f in self.order[:at])
        fails, earlier = self.masks & own > 0, self.masks & before > 0
        removed = self.cells[fails & ~earlier].sum(axis=0)
        kept = self.cells[~fails & ~earlier, 0].sum()
        return tuple(map(int, (kept, removed[0], self.cells[fails & earlier, 0].sum(), self.cells[own, 0], removed[1], removed[2])))

    def settle(self, at: int) -> None:
        """Adds what a step has removed in all orders since it last changed."""
        self.shapley[self.order[at]] += self.steps[at][1] * (self.visited - self.since[at])
        self.since[at] = self.visited

    def orders(self) -> Iterator[tuple[str, list[tuple[int, ...]]]]:
        for swap in [*single_swaps(len(self.filters)), None]:
            yield "".join(self.filters[f] for f in self.order), list(self.steps)
            self.visited += 1
            if swap is not None:
                for at in (swap, swap + 1):
                    self.settle(at)
                self.order[swap], self.order[swap + 1] = self.order[swap + 1], self.order[swap]
                for at in (swap, swap + 1):
                    self.steps[at] = self.step(at)
        for at in range(len(self.order)):
            self.settle(at)


def every_order(cells: DataFrame, filters: str) -> DataFrame:
    """A row for each part, order and step from cells (part, mask, good, toxic, n).

    A part's cells are counts, at most four for each mask, so a group is bounded whatever the table's size.
    """
    if not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")

    def audit(rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((1 << len(filters), 3), np.int64)
        for mask, good, toxic, n in rows[["mask", "good", "toxic", "n"]].itertuples(index=False):
            counts[mask] += np.array([1, good, toxic], np.int64) * n
        walk = Walk(counts, filters)
        out = [(order, at + 1, *step) for order, steps in walk.orders() for at, step in enumerate(steps)]
        table = pd.DataFrame(out, columns=["filter_order", "step", *COUNTS])
        table["shapley"] = [walk.shapley[filters.index(order[step - 1])] for order, step in zip(table["filter_order"], table["step"])]
        return table.assign(part=rows["part"].iloc[0])

    kinds = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in (*COUNTS, "shapley"))
    return cells.groupBy("part").applyInPandas(audit, kinds)


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions of a text (not null), in the order of their bits."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words).cast("long")
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.char_length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_cells(docs: DataFrame, labels: DataFrame, conditions=text_conditions, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): documents that fail exactly a mask's filters. The highest bit: a copy of an earlier text.

    Only the id, a digest of the text (SHA-256) and the mask of a row are shuffled, counted by their values first, so a text
    that a third of all rows hold is a few rows for each task. Of a text's rows those with the smallest id are the first;
    which rows those are is told from the least id in each count and how many rows have it, without going back to the rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    failing = conditions(text)
    mask = sum((F.when(c, 1 << bit).otherwise(0) for bit, c in enumerate(failing.values())), F.lit(0))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    repeats = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("m"))
    marks = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marked = repeats.join(marks, "doc_id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})
    counted = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("m").alias("n"), F.min("doc_id").alias("least"), F.min_by("m", "doc_id").alias("n_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("m")).otherwise(0)).alias("n_null")
    )
    least = F.min("least").over(Window.partitionBy("digest"))
    first = F.coalesce(F.when(F.col("least") == F.col("of_all"), F.col("n_least")), F.lit(0)) + F.col("n_null")
    told = counted.withColumn("of_all", least).withColumn("first", first)
    copy = 1 << len(failing)
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("first").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(copy)).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
    cells = told.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    return cells.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each of five filters does at each step of each of their 120 orders, by part (the language; null: empty string).

    A: under 200 words. B: fewer distinct words than half. C: over 3 % capital letters A-Z. D: any of #$%&*|. E: the same text
    as a row with a smaller id, wherever in the table. A null text is empty. Rows of one id and text don't make each other
    fail E; a row without an id neither fails E nor makes another fail. Repeated rows count as often as they are there. A
    document is good (toxic) if any row of `labels` with its id says so; labels without an id say nothing. An empty table
    gives no rows. Further columns aren't read. Only counts leave the tasks that read the texts.
    """
    return every_order(failure_cells(docs, labels), "ABCDE")


AUDIT_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '{WORD_PATTERN}') AS words FROM texts),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
failing AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
    FROM split LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failing GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step::INT AS step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS own,
    list_sum([1 << (ascii(substr(filter_order, k, 1)) - 65) FOR k IN range(1, step)] || [0])::BIGINT AS before
    FROM orders, unnest([1, 2, 3, 4, 5]) AS s(step)),
counted AS (SELECT part, filter_order, step, own,
    sum(n * (mask & (own | before) = 0)::INT)::BIGINT AS kept,
    sum(n * (mask & own > 0 AND mask & before = 0)::INT)::BIGINT AS removed,
    sum(n * (mask & own > 0 AND mask & before > 0)::INT)::BIGINT AS redundant,
    sum(n * (mask = own)::INT)::BIGINT AS unique_fails,
    sum(good * (mask & own > 0 AND mask & before = 0)::INT)::BIGINT AS good_lost,
    sum(toxic * (mask & own > 0 AND mask & before = 0)::INT)::BIGINT AS toxic_lost
    FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM counted
"""
