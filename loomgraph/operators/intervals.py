"""Overlaps of intervals: all overlapping pairs without comparing all pairs."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def overlapping(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), start: str = "start", end: str = "end") -> DataFrame:
    """(keys, a, b, overlap): pairs of a row of `a` and a row of `b` with equal keys whose half-open intervals share a point.

    `a` and `b` are structs of all columns of the rows, `overlap` is the length they share. Starts and ends are whole numbers. Rows
    without length, with a null end or a null key pair with nothing; repeated rows pair again.

    Intervals are filed by size: one of at most 2 ** k in the cells of that width that it touches, two at most. Shorter ones of the
    other side are filed there too, for each larger size that occurs, so a pair meets where the longer of the two is filed and
    nowhere else. It is taken in the cell that holds the later start, once. What covers everything costs one row, not one for each
    cell, and short intervals never meet in the cells of long ones.
    """
    sides = []
    for rows in (a, b):
        length = F.col(end) - F.col(start)
        size = F.when(length == 1, 0).otherwise(F.length(F.bin(length - 1))).cast("int")
        sides.append(rows.where(length > 0).select(*keys, F.struct(*rows.columns).alias("row"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"), size.alias("own")))
    occurring = [sorted(r.own for r in side.select("own").distinct().collect()) for side in sides]  # at most 64 sizes
    filed = []
    for side, name, other, sizes in zip(sides, "ab", "ba", reversed(occurring)):
        larger = F.array(*[F.lit(x) for x in sizes]) if sizes else F.array().cast("array<int>")
        # of two as long a is at home and b comes to it
        larger = F.filter(larger, lambda x: x > F.col("own")) if name == "a" else F.filter(larger, lambda x: x >= F.col("own"))
        placed = side.select("*", F.lit(name).alias("at"), F.col("own").alias("size")).unionByName(side.select("*", F.lit(other).alias("at"), F.explode(larger).alias("size")))
        filed.append(placed.withColumn("cell", F.explode(F.expr("sequence(shiftright(s, size), shiftright(e - 1, size))"))))
    one, other = (rows.select(*keys, "at", "size", "cell", *[F.col(c).alias(f"{c}_{n}") for c in ("row", "s", "e")]) for rows, n in zip(filed, "ab"))
    pairs = one.join(other, [*keys, "at", "size", "cell"]).where("s_a < e_b AND s_b < e_a AND shiftright(greatest(s_a, s_b), size) = cell")
    return pairs.select(*keys, F.col("row_a").alias("a"), F.col("row_b").alias("b"), F.expr("least(e_a, e_b) - greatest(s_a, s_b)").alias("overlap"))


def _pairs(a: list[tuple], b: list[tuple]) -> list[tuple[int, int, int]]:
    """(place in a, place in b, overlap) of overlapping half-open intervals, in one pass in the order of starts."""
    order = sorted((start, end, side, i) for side, own in enumerate((a, b)) for i, (start, end) in enumerate(own) if start is not None and end is not None and end > start)
    open_, out = ([], []), []
    for start, end, side, i in order:
        other = open_[1 - side]
        other[:] = [x for x in other if x[0] > start]
        out += [(*((i, j) if side == 0 else (j, i)), min(end, till) - start) for till, j in other]
        open_[side].append((end, i))
    return out


def within(a: Column, b: Column) -> Column:
    """Overlapping pairs of two arrays of a row, of structs with a start and an end: structs of the places in both (from 0) and the length they share.

    For what one text holds: nothing is shuffled. Null arrays hold nothing; intervals without length or with a null end pair with nothing.
    """

    def each(ones: pa.Array, others: pa.Array) -> pa.Array:
        out = [[dict(zip(("a", "b", "overlap"), x)) for x in _pairs(*([(s["start"], s["end"]) for s in own.as_py() or ()] for own in both))] for both in zip(ones, others)]
        return pa.array(out, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("overlap", pa.int64())])))

    spans = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return F.arrow_udf(each, "array<struct<a: int, b: int, overlap: bigint>>")(spans(a), spans(b))


def longest(a: Column, b: Column) -> Column:
    """For each struct of the first array the longest overlap with one of the second, 0 if there is none; see `within`."""

    def each(ones: pa.Array, others: pa.Array) -> pa.Array:
        out = []
        for both in zip(ones, others):
            one, other = ([(s["start"], s["end"]) for s in own.as_py() or ()] for own in both)
            most = [0] * len(one)
            for i, _, shared in _pairs(one, other):
                most[i] = max(most[i], shared)
            out.append(most)
        return pa.array(out, pa.list_(pa.int64()))

    spans = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return F.arrow_udf(each, "array<bigint>")(spans(a), spans(b))
