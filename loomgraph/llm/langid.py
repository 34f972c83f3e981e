"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Most frequent n-grams of a profile and of a document.
PROFILE = 400
UNKNOWN = "und"
_BASE = 0x110000 + 1


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of a text's lower-case letters, a boundary (0) before and after each run of letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    points = np.where(_letters()[points], points, 0)
    points = np.r_[0, points, 0]
    points = points[(points != 0) | np.r_[True, points[:-1] != 0]]
    if len(points) < 3:
        return np.zeros(0, np.int64)
    one = points[points != 0]
    two = _BASE + points[:-1] * _BASE + points[1:]
    inner = points[1:-1] != 0
    three = 2 * _BASE * _BASE + (points[:-2] * _BASE + points[1:-1])[inner] * _BASE + points[2:][inner]
    return np.concatenate([one, two, three])


def top_grams(text: str | None, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code."""
    codes, counts = np.unique(grams(text), return_counts=True)
    return codes[np.argsort(-counts, kind="stable")[:size]]


@dataclass(frozen=True)
class Profiles:
    """Rank of each n-gram in each language's profile; `size` where a profile lacks it. Languages x `size` entries at most."""

    languages: tuple[str, ...]
    codes: np.ndarray
    ranks: np.ndarray
    size: int

    def distances(self, found: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's n-grams to each language; an n-gram a profile lacks costs `size`."""
        at = np.minimum(np.searchsorted(self.codes, found), max(len(self.codes) - 1, 0))
        known = self.codes[at] == found
        ranks = np.where(known[:, None], self.ranks[at], self.size)
        return np.where(ranks < self.size, np.abs(ranks - np.arange(len(found))[:, None]), self.size).sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = top_grams(text, self.size)
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0
        distances = self.distances(found)
        best = int(np.argmin(distances))
        return self.languages[best], float(1 - distances[best] / (self.size * len(found)))


def learn_profiles(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> Profiles:
    """Profiles from all rows with a language. Counts are summed by language and n-gram on the cluster; the driver gets each
    language's `size` most frequent n-grams (ties by code) and nothing that grows with the rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[np.ndarray]] = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                by_lang[lang].append(np.stack(np.unique(grams(text.as_py()), return_counts=True)))
            for lang, parts in by_lang.items():
                joined = np.concatenate(parts, axis=1)
                codes, inverse = np.unique(joined[0], return_inverse=True)
                counts = np.bincount(inverse, joined[1], len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "code", "n"])

    labelled = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = labelled.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))  # a group limit: each task cuts its own rows first
    top = counts.withColumn("place", place).where(F.col("place") <= size).select("lang", "code", (F.col("place") - 1).alias("rank")).toPandas()
    languages = tuple(sorted(top["lang"].unique()))
    codes = np.unique(top["code"].to_numpy(np.int64))
    ranks = np.full((len(codes), len(languages)), size, np.int64)
    ranks[np.searchsorted(codes, top["code"].to_numpy(np.int64)), [languages.index(x) for x in top["lang"]]] = top["rank"]
    return Profiles(languages, codes, ranks, size)


def predicted(profiles: Profiles, text: Column) -> Column:
    """Struct (lang_pred, score) of a text. Score is 1 - distance / largest possible distance."""
    shared = _active().broadcast(profiles)

    def predict(texts: pa.Array) -> pa.Array:
        found = [shared.value.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["lang_pred", "score"])

    return F.arrow_udf(predict, "lang_pred string, score double")(text)


def _active():
    from pyspark.sql import SparkSession

    return SparkSession.active().sparkContext


def held_out(id_col: Column, fold: int = 2, folds: int = 4) -> Column:
    """Fold of an id: crc32 of its text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row, from profiles of the rows that aren't held out.

    Null texts and texts without a letter are `und` with score 0, as is everything if no row has a language. Ties go to the
    first language by name. Repeated rows give repeated results; an empty table an empty one.
    """
    out = held_out(F.col(id_col))
    profiles = learn_profiles(docs.where(~out), text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), predicted(profiles, F.col(text_col)).alias("found"))
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score")
