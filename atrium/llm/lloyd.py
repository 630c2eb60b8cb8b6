"""Plain Lloyd clustering in exact integers: every vector meets every centroid in each round."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared

BLOCK = 4096  # vectors compared at a time
FITS, MOST_DIMS = 1 << 25, 2000  # so many components below this have distances that fit 64 bits
LIMB = 40  # sums travel in digits of this many bits, so that no size of a component overflows


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of a block of vectors: 64-bit integers, or Python's where a component is large."""
    x = np.stack(vectors).astype(np.float64)
    if np.abs(x).max(initial=0) * scale < FITS and x.shape[1] <= MOST_DIMS:
        return np.floor(x * scale).astype(np.int64)
    exact = lambda v: math.floor(v * scale) if abs(v) < 1e300 else int(v) * scale
    return np.array([[exact(v) for v in row] for row in x.tolist()], object)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the lowest of those that tie, and its squared distance."""
    if v.dtype != centroids.dtype:
        v, centroids = v.astype(object), centroids.astype(object)
    d = np.stack([((v - c) ** 2).sum(axis=1) for c in centroids])
    at = d.argmin(axis=0)
    return at, d[at, np.arange(len(v))]


def as_block(centroids: list[list[int]]) -> np.ndarray:
    big = any(abs(x) >= FITS for c in centroids for x in c)
    return np.array(centroids, object if big else np.int64)


def blocks(parts: Iterator[pd.DataFrame], scale: int) -> Iterator[tuple[pd.Series, np.ndarray]]:
    """(id, v) in blocks; ids are text, as pandas would make numbers of doubles where one is null."""
    for pdf in parts:
        for i in range(0, len(pdf), BLOCK):
            yield pdf["id"].iloc[i : i + BLOCK], scaled(pdf["v"].iloc[i : i + BLOCK].to_numpy(), scale)


def digits(total: int) -> list[tuple[int, int]]:
    """(place, digit) of a whole number in base 2**LIMB, each with its sign; digits of several numbers can be added."""
    sign, rest, out = (-1 if total < 0 else 1), abs(total), []
    while rest or not out:
        out.append((len(out), sign * (rest & ((1 << LIMB) - 1))))
        rest >>= LIMB
    return out


def cluster_sums(vectors: DataFrame, centroids: list[list[int]], scale: int) -> dict[int, tuple[int, list[int]]]:
    """How many vectors each centroid is nearest to, and their sum: added up in each partition, then by a group-by.

    What reaches the driver is a number for each centroid and component.
    """
    given, dims = vectors.sparkSession.sparkContext.broadcast(as_block(centroids)), len(centroids[0])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((len(given.value), dims), object), np.zeros(len(given.value), np.int64)
        for _, v in blocks(parts, scale):
            at, _ = nearest(v, given.value)
            for c in np.unique(at):
                total[c] += v[at == c].sum(axis=0).astype(object)
                count[c] += (at == c).sum()
        rows = [(c, j, *d) for c in np.flatnonzero(count).tolist() for j, x in [(-1, int(count[c])), *enumerate(total[c])] for d in digits(int(x))]
        yield pd.DataFrame(rows, columns=["cluster", "component", "place", "digit"])

    sums = vectors.mapInPandas(run, "cluster int, component int, place int, digit long").groupBy("cluster", "component", "place").agg(F.sum("digit").alias("digit"))
    whole: dict[int, list[int]] = {}
    for r in sums.collect():
        whole.setdefault(r.cluster, [0] * (dims + 1))[r.component] += r.digit << (LIMB * r.place)
    given.unpersist()
    return {c: (x[-1], x[:-1]) for c, x in whole.items()}


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, dims: int) -> DataFrame:
    """(id, v): rows whose vector has dims components, none of them null, NaN or infinite."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(df[id_col].cast("string").alias("id"), df[vec_col].alias("v")).where((F.size("v") == dims) & finite)


def lloyd(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every whole vector; see whole_vectors().

    Vectors are floor(scale * x). Centroids start as the k vectors whose seed:id has the least SHA-256, and become the
    floor of their vectors' mean in each round; an empty one stays. Each round is one pass over the vectors without a
    shuffle of them: centroids are broadcast, k * dims numbers come back, and nothing but the last assignment is written.

    Others than whole vectors, null ones included, have no row. A null id is assigned but starts no centroid; rows that
    repeat an id count each, and of those the smaller vector comes first as a centroid. With fewer than k vectors there
    are fewer centroids. Vectors of any finite size are compared exactly; where a distance or an inertia is beyond a long
    it is null. An empty table, or one in which no id is left, gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    vectors = whole_vectors(df, id_col, vec_col, dims)
    first = vectors.where("id is not null").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "id"), 256), "v").limit(k).select("v").collect()
    if not first:
        vectors = vectors.where("false")
    centroids = scaled(np.array([r.v for r in first], np.float64), scale).tolist() if first else [[0] * dims]
    for _ in range(rounds if first else 0):
        for c, (n, total) in cluster_sums(vectors, centroids, scale).items():
            centroids[c] = [x // n for x in total]
    given = spark.sparkContext.broadcast(as_block(centroids))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, v in blocks(parts, scale):
            at, d = nearest(v, given.value)
            yield pd.DataFrame({"id": ids.to_numpy(), "cluster": at, "distance": pd.array([int(x) if x < 1 << 63 else None for x in d], "Int64")})

    assigned = Shared(spark).put(vectors.mapInPandas(run, "id string, cluster int, distance long"), "assigned")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("beyond")).collect()
    inertia = {r.cluster: None if r.beyond else int(r.s) for r in sums}
    total = None if None in inertia.values() else sum(inertia.values())
    long = lambda x: F.lit(x if x is not None and x < 1 << 63 else None).cast("long")
    of = lambda values: F.get(F.array(*values), F.col("cluster"))
    digest = [F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids]
    return assigned.select(F.col("id").cast(df.schema[id_col].dataType).alias("vec_id"), "cluster", "distance", of([long(inertia.get(c, 0)) for c in range(len(centroids))]).alias("cluster_inertia"), long(total).alias("inertia"), of(digest).alias("centroid_sha256"))
