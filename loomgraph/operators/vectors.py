"""Dense vectors: cosine and Euclidean neighbours of a small query set, projections and clusters of bounded groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


#: Queries and rows of one block, and queries of one product of matrices within it.
QUERIES, ROWS, TILE = 16_384, 16_384, 128


def usable(vector: Column) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~odd, F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def _stacked(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as a matrix, made of their components as they lie."""
    flat = pa.chunked_array([chunk.flatten() for chunk in vectors.chunks]).to_numpy().astype(np.float64)
    return flat.reshape(len(vectors), -1)


def _best(k: int, names: tuple[str, str]):
    key, vector = names

    def best(asked: pa.Table, rows: pa.Table) -> pa.Table:
        """The k rows of a block nearest to each of its queries; ties to the smaller key."""
        ids, found = rows[key].to_numpy(), [[], [], []]
        if len(asked) and len(rows):
            a, b = _stacked(asked[vector]), _stacked(rows[vector])
            lengths, own = np.sqrt((b**2).sum(1)), asked[key].to_numpy()
            for at in range(0, len(a), TILE):
                part = a[at : at + TILE]
                scores, norms = part @ b.T, np.sqrt((part**2).sum(1))[:, None] * lengths
                scores[norms <= 0] = 0.0
                norms[norms <= 0] = 1.0
                np.round(np.divide(scores, norms, out=scores), 6, out=scores)
                for query, line in zip(own[at : at + TILE], scores):
                    line[ids == query] = -np.inf
                    near = np.flatnonzero(line >= np.partition(line, max(len(line) - k, 0))[max(len(line) - k, 0)])
                    near = near[np.lexsort((ids[near], -line[near]))][:k]
                    near = near[np.isfinite(line[near])]
                    for column, values in zip(found, (np.full(len(near), query), ids[near], line[near])):
                        column.append(values)
        columns = [np.concatenate(c) if c else [] for c in found]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query", key, "score"])

    return best


def top_k_similar(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query, key, score) of the k nearest by cosine (6 digits; 0 if either norm is 0), for vectors of one length and integer keys.

    Vectors that are null, empty or have a null or infinite component, and rows without a key, take no part. Queries come in blocks of
    QUERIES and rows in blocks of ROWS, and each pair of blocks is compared in one task, a product of matrices for each TILE queries, which leaves
    k rows a query; nothing is broadcast. Rows go out once for each block of queries.
    """
    rows, queries = (df.where(F.col(key).isNotNull() & usable(F.col(vector))) for df in (rows, queries))
    parts, blocks = (max(1, -(-df.count() // n)) for df, n in ((queries, QUERIES), (rows, ROWS)))
    number = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(key, vector, number(parts).alias("part"), every(blocks).alias("block"))
    held = rows.select(key, vector, every(parts).alias("part"), number(blocks).alias("block"))
    found = asked.groupBy("part", "block").cogroup(held.groupBy("part", "block")).applyInArrow(_best(k, (key, vector)), f"query long, {key} long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Members of a group that the quadratic methods below take.
GROUP_LIMIT = 2000


def _matrix(group: pd.DataFrame, vector: str) -> np.ndarray:
    if len(group) > GROUP_LIMIT:
        raise ValueError(f"a group of {len(group)} is larger than {GROUP_LIMIT}")
    return np.stack(group[vector].to_numpy()).astype(np.float64)


def _distances(x: np.ndarray) -> np.ndarray:
    sq = (x**2).sum(1)
    return np.maximum(sq[:, None] + sq - 2 * x @ x.T, 0)


def affinity_exemplars(x: np.ndarray, quantile: float, damping: float = 0.6, rounds: int = 90) -> np.ndarray:
    """Exemplar of each row by affinity propagation on negative squared distances; the preference is a quantile of the upper triangle."""
    n = len(x)
    if n < 2:
        return np.zeros(n, int)
    similarity = -_distances(x)
    np.fill_diagonal(similarity, np.quantile(similarity[np.triu_indices(n, 1)], quantile))
    responsibility = np.zeros((n, n))
    availability = np.zeros((n, n))
    rows, last, calm = np.arange(n), None, 0
    for _ in range(rounds):
        both = availability + similarity
        best = both.argmax(1)
        first = both[rows, best]
        both[rows, best] = -np.inf
        second = both.max(1)
        fresh = similarity - first[:, None]
        fresh[rows, best] = similarity[rows, best] - second
        responsibility = damping * responsibility + (1 - damping) * fresh
        positive = np.maximum(responsibility, 0)
        positive[rows, rows] = responsibility[rows, rows]
        total = positive.sum(0)
        fresh = np.minimum(total[None, :] - positive, 0)
        fresh[rows, rows] = total - positive[rows, rows]
        availability = damping * availability + (1 - damping) * fresh
        chosen = tuple(np.flatnonzero(np.diag(responsibility + availability) > 0))
        calm = calm + 1 if chosen == last else 0
        last = chosen
        if calm >= 2 and chosen:
            break
    centres = np.array(last if last else (0,))
    owner = centres[similarity[:, centres].argmax(1)]
    owner[centres] = centres
    return owner


def search_clusters(x: np.ndarray, low: int = 3, high: int = 12, target: float = 7.5) -> np.ndarray:
    """The first preference that gives low..high clusters, else the one nearest to the target."""
    tried = []
    for q in (0.5, 0.25, 0.08, 0.0, 0.75, 0.92):
        owner = affinity_exemplars(x, q)
        count = len(np.unique(owner))
        if low <= count <= high:
            return owner
        tried.append((abs(count - target), len(tried), owner))
    return min(tried, key=lambda t: t[:2])[2]


def affinity_clusters(rows: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """(group, key, exemplar) within each bounded group."""

    def cluster(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key)
        owner = search_clusters(_matrix(part, vector))
        return pd.DataFrame({group: part[group], key: part[key], "exemplar": part[key].to_numpy()[owner]})

    rows = rows.where(usable(F.col(vector)))
    return rows.groupBy(group).applyInPandas(cluster, f"{group} {dict(rows.dtypes)[group]}, {key} {dict(rows.dtypes)[key]}, exemplar {dict(rows.dtypes)[key]}")


def classical_mds(distances: np.ndarray, dims: int = 2) -> np.ndarray:
    """Coordinates from the leading eigenvectors of the doubly centred squared distances; the largest entry of an axis is positive."""
    n = len(distances)
    centre = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * centre @ distances**2 @ centre)
    order = np.argsort(-values)[:dims]
    points = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    signs = np.sign(points[np.abs(points).argmax(0), np.arange(points.shape[1])])
    return points * np.where(signs == 0, 1, signs)


def smacof(distances: np.ndarray, start: np.ndarray, rounds: int = 160, tolerance: float = 2e-6) -> tuple[np.ndarray, float]:
    """Stress majorisation from a start; gives points and Kruskal's stress."""
    x, n, last = start.copy(), len(distances), np.inf
    stress = 0.0
    for step in range(rounds):
        now = np.sqrt(_distances(x))
        ratio = np.divide(distances, now, out=np.zeros_like(now), where=now > 1e-12)
        b = -ratio
        np.fill_diagonal(b, ratio.sum(1) - np.diag(ratio))
        x = b @ x / n
        if step % 4 == 3:
            now = np.sqrt(_distances(x))
            stress = float(np.sqrt(((now - distances) ** 2).sum() / max((distances**2).sum(), 1e-12)))
            if last - stress < tolerance:
                break
            last = stress
    return x, stress


def layout(rows: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """(group, key, x, y, stress): unit vectors, distance 1 - cosine, classical scaling refined by stress majorisation."""

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key)
        x = _matrix(part, vector)
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        unit = np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)
        distances = np.maximum(0, 1 - unit @ unit.T)
        np.fill_diagonal(distances, 0)
        points = classical_mds(distances) if len(part) > 2 else np.zeros((len(part), 2))
        points, stress = smacof(distances, points) if len(part) > 2 else (points, 0.0)
        return pd.DataFrame({group: part[group], key: part[key], "x": points[:, 0], "y": points[:, 1], "stress": stress})

    kinds = dict(rows.dtypes)
    rows = rows.where(usable(F.col(vector)))
    return rows.groupBy(group).applyInPandas(place, f"{group} {kinds[group]}, {key} {kinds[key]}, x double, y double, stress double")
