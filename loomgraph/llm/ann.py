"""Approximate nearest neighbours with an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.llm.shared import settle

#: Vectors that codebooks are fitted on, at most.
SAMPLE = 16_384
#: Rows to a cell that the number of centroids is set for, and the most centroids of a half: a sixteenth of the sample.
CELL_ROWS, MOST_CENTROIDS = 64, 1024
#: Share of the nearest rows of the trial queries that the rows to visit must hold, and the number of trial queries.
RECALL, TRIALS = 0.95, 200
#: Vectors and queries of one block.
ROWS_PER_BLOCK, QUERIES_PER_BLOCK = 16_384, 16_384
#: Queries whose distances to a cell are computed at once.
TOGETHER = 256


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0)


def _centroids(rows: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means from evenly spaced rows; a centroid that loses its rows stays where it was."""
    centres = rows[np.linspace(0, len(rows) - 1, min(count, len(rows))).astype(int)].copy()
    for _ in range(rounds):
        nearest = _squared(rows, centres).argmin(1)
        sizes = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0][:, None]
    return centres


def traverse(first: np.ndarray, second: np.ndarray, held: np.ndarray, wanted: int) -> Iterator[tuple[int, int]]:
    """Cells (i, j) in order of first[i] + second[j] until they hold `wanted` rows; empty cells are passed over.

    The heap holds one frontier of the sorted distances: a pair goes in when its predecessors in both halves are out.
    """
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[one], second[two]
    heap, next_in_row = [(a[0] + b[0], 0, 0)], np.zeros(len(a) + 1, np.int64)
    while heap and wanted > 0:
        _, i, j = heapq.heappop(heap)
        cell = int(one[i]), int(two[j])
        if held[cell]:
            wanted -= int(held[cell])
            yield cell
        next_in_row[i] = j + 1
        if j + 1 < len(b) and (i == 0 or next_in_row[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if i + 1 < len(a) and next_in_row[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks of the two halves of a vector."""

    first: np.ndarray
    second: np.ndarray

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.first), len(self.second)

    def halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        split = self.first.shape[1]
        return _squared(rows[:, :split], self.first), _squared(rows[:, split:], self.second)

    def cells(self, rows: np.ndarray) -> np.ndarray:
        one, two = self.halves(rows)
        return (one.argmin(1) * len(self.second) + two.argmin(1)).astype(np.int32)

    @staticmethod
    def fit(sample: np.ndarray, rows: int) -> MultiIndex:
        """Codebooks from the sample, with so many centroids that the cells hold about CELL_ROWS of all `rows`."""
        half, count = max(sample.shape[1] // 2, 1), min(MOST_CENTROIDS, max(2, math.isqrt(rows // CELL_ROWS)))
        return MultiIndex(_centroids(sample[:, :half], count), _centroids(sample[:, half:], count))


@dataclass(frozen=True)
class Blocks:
    """How cells are dealt to blocks of ROWS_PER_BLOCK rows: neighbouring cells share a block, a larger cell has several."""

    first: np.ndarray
    parts: np.ndarray

    @staticmethod
    def of(held: np.ndarray) -> Blocks:
        first, parts = np.zeros(len(held), np.int32), np.maximum(1, -(-held // ROWS_PER_BLOCK)).astype(np.int32)
        block, room = 0, ROWS_PER_BLOCK
        for cell, n in enumerate(held.tolist()):
            if n > room:
                block, room = block + 1, ROWS_PER_BLOCK
            first[cell] = block
            if n > ROWS_PER_BLOCK:
                block, room = block + int(parts[cell]), ROWS_PER_BLOCK
            else:
                room -= n
        return Blocks(first, parts)


def usable(vector: Column) -> Column:
    """Neither null nor zero, without null and non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest_in_block(queries: np.ndarray, query_ids: np.ndarray, visits: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, row_cells: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the k nearest rows of each query among the cells it visits, ties to the smaller id.

    `visits` has a row (query's place, cell) for each visit. Distances are computed cell by cell, to the rows of visited cells only: by
    matrix product to choose rows within rounding of the k-th, then exactly to rank those.
    """
    order = np.argsort(row_cells, kind="stable")
    rows, row_ids, row_cells = rows[order], row_ids[order], row_cells[order]
    visits = visits[np.argsort(visits[:, 1], kind="stable")]
    kth = np.full((len(queries), k), np.inf)
    slack = lambda limit: limit + 1e-9 * (1 + limit)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for cell in np.unique(visits[:, 1]):
        at = slice(*np.searchsorted(row_cells, [cell, cell + 1]))
        asking = visits[slice(*np.searchsorted(visits[:, 1], [cell, cell + 1])), 0]
        if at.start == at.stop:
            continue
        for begin in range(0, len(asking), TOGETHER):
            some = asking[begin : begin + TOGETHER]
            rough = _squared(queries[some], rows[at])
            rough[query_ids[some][:, None] == row_ids[at]] = np.inf
            kth[some] = np.partition(np.concatenate([kth[some], rough], axis=1), k - 1, axis=1)[:, :k]
            limit = slack(kth[some].max(axis=1))
            who, which = np.nonzero((rough <= limit[:, None]) & np.isfinite(rough))
            found.append((some[who], which + at.start, rough[who, which]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    who, which, rough = (np.concatenate(c) for c in zip(*found))
    near = rough <= slack(kth.max(axis=1))[who]
    who, which = who[near], which[near]
    exact = np.sqrt(((rows[which] - queries[who]) ** 2).sum(1))
    order = np.lexsort((row_ids[which], exact, who))
    who, which, exact = who[order], which[order], exact[order]
    starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, np.int64)
    place = np.arange(len(who)) - np.repeat(starts, np.diff(np.r_[starts, len(who)]))
    best = place < k
    return query_ids[who[best]], row_ids[which[best]], exact[best]


def _rows_needed(index: MultiIndex, held: np.ndarray, trials: np.ndarray, nearest: list[tuple[int, int]]) -> int:
    """How many rows the cells must hold that a query visits, so that the trial queries meet RECALL of their nearest rows.

    `nearest` names pairs (trial, cell of one of its nearest rows) over the whole table.
    """
    one, two = index.halves(trials)
    grid, total = held.reshape(index.shape), int(held.sum())
    needed = []
    for row in range(len(trials)):
        wanted = [c for t, c in nearest if t == row]
        left, up_to = set(wanted), 0
        for a, b in traverse(one[row], two[row], grid, total if left else 0):
            cell = a * index.shape[1] + b
            up_to += int(held[cell])
            if cell in left:
                needed += [up_to] * wanted.count(cell)
                left.discard(cell)
            if not left:
                break
    return int(np.quantile(needed, RECALL, method="higher")) if needed else total


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for each query row, by Euclidean distance.

    Codebooks are fitted on SAMPLE rows (by hash of the id), the number of cells grows with the table, and every row is indexed. TRIALS
    other rows, which no codebook has seen (unless the table has hardly more), are compared with all rows, which tells how many rows a query must
    visit for a recall of RECALL in this very table; each query visits cells until they hold that many. Null and unusable vectors, rows with a null id and
    vectors whose length isn't the sample's most frequent one take no part. Of equal vectors the k + 1 smallest ids are kept, which
    is all a query can return; repeated rows count once. Fewer than k others: all of them.

    Cells are dealt to blocks of ROWS_PER_BLOCK rows. A row is in one block, a query goes to the blocks of the cells it visits and
    leaves at most k rows in each; only a block that more than QUERIES_PER_BLOCK queries visit is handed out more than once.
    """
    spark = vectors.sparkSession
    chosen = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    good = chosen.where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE + TRIALS).select("vec_id", "vector").toArrow()
    lengths = np.diff(sample["vector"].combine_chunks().offsets.to_numpy()) if len(sample) else np.zeros(0, int)
    if not len(lengths):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = int(np.bincount(lengths).argmax())
    sample = sample.filter(pa.array(lengths == width))
    alike = Window.partitionBy("vector").orderBy("vec_id")
    fitting = good.where(F.size("vector") == width)
    kept = fitting.dropDuplicates(["vec_id", "vector"]).withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k + 1)
    kept = settle(kept.select("vec_id", "vector"), "vectors")
    fitted = sample[TRIALS:] if len(sample) > 2 * TRIALS else sample
    index = MultiIndex.fit(_matrix(fitted["vector"]), kept.count())
    trial_ids, trials = sample["vec_id"][:TRIALS].to_numpy(), _matrix(sample["vector"][:TRIALS])
    shared = spark.sparkContext.broadcast(index)
    cell_of = F.arrow_udf(lambda v: pa.array(shared.value.cells(_matrix(v)), pa.int32()), "int")
    indexed = settle(kept.withColumn("cell", cell_of("vector")), "index")
    held = np.zeros(index.shape[0] * index.shape[1], np.int64)
    for r in indexed.groupBy("cell").count().collect():  # MOST_CENTROIDS ** 2 rows at most
        held[r.cell] = r["count"]

    def nearest_to_trials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                ids, cells = batch.column("vec_id").to_numpy(), batch.column("cell").to_numpy()
                visits = np.stack([np.arange(len(trials)), np.zeros(len(trials), np.int64)], axis=1)
                trial, row, score = nearest_in_block(trials, trial_ids, visits, _matrix(batch.column("vector")), np.arange(len(ids)), np.zeros(len(ids), np.int64), k + 1)
                own = ids[row] != trial
                yield pa.RecordBatch.from_arrays([pa.array(trial[own]), pa.array(cells[row[own]]), pa.array(score[own]), pa.array(ids[row[own]])], ["trial", "cell", "score", "vec_id"])

    tried = indexed.mapInArrow(nearest_to_trials, "trial long, cell int, score double, vec_id long")
    closest = tried.withColumn("n", F.row_number().over(Window.partitionBy("trial").orderBy("score", "vec_id"))).where(F.col("n") <= k)
    number = {int(t): at for at, t in enumerate(trial_ids)}
    needed = [(number[r.trial], r.cell) for r in closest.select("trial", "cell").collect()]  # TRIALS * k rows at most
    visited = max(_rows_needed(index, held, trials, needed), 4 * k + 1)
    plan = spark.sparkContext.broadcast((held, Blocks.of(held)))

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and block that it visits, with the cells it visits there."""
        held, blocks = plan.value
        grid = held.reshape(index.shape)
        for batch in batches:
            if not len(batch):
                continue
            one, two = shared.value.halves(_matrix(batch.column("vector")))
            rows, to, cells = [], [], []
            for row in range(len(batch)):
                here: dict[int, list[int]] = {}
                for a, b in traverse(one[row], two[row], grid, visited):
                    cell = a * grid.shape[1] + b
                    for block in range(blocks.first[cell], blocks.first[cell] + blocks.parts[cell]):
                        here.setdefault(block, []).append(cell)
                rows += [row] * len(here)
                to += list(here)
                cells += list(here.values())
            taken = batch.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(to, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], ["vec_id", "vector", "block", "cells"])

    def nearest(asked_here: pa.Table, rows: pa.Table) -> pa.Table:
        query, row, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(asked_here) and len(rows):
            cells = asked_here["cells"].combine_chunks()
            visits = np.stack([np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy())), cells.flatten().to_numpy().astype(np.int64)], axis=1)
            query, row, score = nearest_in_block(_matrix(asked_here["vector"]), asked_here["vec_id"].to_numpy(), visits, _matrix(rows["vector"]), rows["vec_id"].to_numpy(), rows["cell"].to_numpy(), k)
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(row, pa.int64()), "score": pa.array(score, pa.float64())})

    block_of = F.arrow_udf(lambda c, h: pa.array(plan.value[1].first[c.to_numpy()] + h.to_numpy() % plan.value[1].parts[c.to_numpy()], pa.int32()), "int")
    asked = fitting.where("is_query").select("vec_id", "vector").dropDuplicates(["vec_id", "vector"])
    routed = settle(asked.mapInArrow(routes, "vec_id long, vector array<double>, block int, cells array<int>"), "routed")
    handed = routed.groupBy("block").agg(F.ceil(F.count("*") / QUERIES_PER_BLOCK).cast("int").alias("parts"))
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    dealt = indexed.withColumn("block", block_of("cell", salt)).join(handed, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asking = routed.join(handed, "block").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
    found = (
        asking.select("block", "part", "vec_id", "vector", "cells")
        .groupBy("block", "part")
        .cogroup(dealt.select("block", "part", "vec_id", "vector", "cell").groupBy("block", "part"))
        .applyInArrow(nearest, "query_id long, vec_id long, score double")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
