"""Nearest neighbours by cosine with vantage-point trees.

Vectors are scaled to length one, where the Euclidean distance orders like the cosine and obeys the triangle inequality. A small
tree, built from a bounded sample, deals all vectors to regions, and a region too large for a task to parts by a hash. A query
is answered in its own region first; then it visits the regions that the tree can't prove to hold nothing nearer than the k-th
found so far. Inside a shard a tree of all its vectors is descended in the same way, many queries at once. ``relax`` scales the
bound, within shards and between them: with 1 the search is exact, above 1 it skips more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weftline.llm.common import broadcast_if_small
from weftline.session import settled

#: Vectors a shard is meant to hold, queries of a block, vectors of a leaf, and vectors of a sample that the regions come from.
SHARD, BLOCK, LEAF, SAMPLE = 8192, 32768, 64, 20_000
#: Rows of the small tables (regions, and regions with blocks of queries) up to which they are broadcast.
MOST_BROADCAST = 200_000
#: Room for rounding in distances: nothing this close to the bound is skipped.
SLACK = 1e-6
#: Room for rounding in fast cosines: whatever is this close to the k-th is judged by its exact score. Pairs judged at once.
NEAR, PAIRS = 1e-12, 100_000


@dataclass
class Node:
    point: int
    radius: float
    inner: Node | np.ndarray
    outer: Node | np.ndarray


def build(unit: np.ndarray, members: np.ndarray, rng: np.random.Generator) -> Node | np.ndarray:
    """A tree over ``unit[members]``. The vantage point is the one of a few that spreads the others most; the median distance splits."""
    if len(members) <= LEAF:
        return members
    trial = members[rng.integers(0, len(members), 5)]
    some = members[rng.integers(0, len(members), 64)]
    spread = np.sqrt(np.maximum(0, 2 - 2 * unit[trial] @ unit[some].T)).std(axis=1)
    point = int(trial[np.argmax(spread)])
    rest = members[members != point]
    far = np.sqrt(np.maximum(0, 2 - 2 * unit[rest] @ unit[point]))
    radius = float(np.median(far))
    inside = far <= radius
    if inside.all():  # all as far as the farthest: no distance splits them
        return members
    return Node(point, radius, build(unit, rest[inside], rng), build(unit, rest[~inside], rng))


class Search:
    """The k best points of a shard for a block of queries, by exact score and then number."""

    def __init__(self, points: np.ndarray, unit: np.ndarray, asked: np.ndarray, unit_asked: np.ndarray, k: int, relax: float) -> None:
        self.points, self.unit, self.asked, self.unit_asked, self.k, self.relax = points, unit, asked, unit_asked, k, relax
        self.score, self.point = np.full((len(asked), k), -np.inf), np.full((len(asked), k), -1, np.int64)

    def offer(self, q: np.ndarray, members: np.ndarray, fast: np.ndarray) -> None:
        """Members, with their fast cosines to each of the queries ``q``; those that may be among the k best are judged exactly."""
        floor = self.score[q, -1]
        if fast.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(fast, -self.k, axis=1)[:, -self.k])
        row, column = np.nonzero(fast >= floor[:, None] - NEAR)
        for i in range(0, len(row), PAIRS):
            self.judge(q[row[i : i + PAIRS]], members[column[i : i + PAIRS]])

    def judge(self, q: np.ndarray, point: np.ndarray) -> None:
        own = np.unique(q)
        who = np.concatenate([np.repeat(own, self.k), q])
        score = np.concatenate([self.score[own].ravel(), cosines(self.asked[q], self.points[point])])
        point = np.concatenate([self.point[own].ravel(), point])
        order = np.lexsort((point, -score, who))
        who, score, point = who[order], score[order], point[order]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        take = first[:, None] + np.arange(self.k)
        self.score[own], self.point[own] = score[take], point[take]

    def reach(self, q: np.ndarray) -> np.ndarray:
        """Distance within which something could still matter."""
        return reach(self.score[q, -1], self.relax)

    def visit(self, node: Node | np.ndarray, q: np.ndarray) -> None:
        if not len(q):
            return
        if isinstance(node, np.ndarray):
            for part in np.split(q, np.arange(0, len(q), 4096)[1:]):
                if len(node):
                    self.offer(part, node, self.unit_asked[part] @ self.unit[node].T)
            return
        cosine = self.unit_asked[q] @ self.unit[node.point]
        self.offer(q, np.array([node.point]), cosine[:, None])
        away = distances(cosine)
        near = away <= node.radius
        self.visit(node.inner, q[near])
        self.visit(node.outer, q[~near])
        # the other side: everything there is at least |away - radius| from the query
        gap = np.abs(away - node.radius)
        other = q[near]
        self.visit(node.outer, other[gap[near] <= self.reach(other)])
        other = q[~near]
        self.visit(node.inner, other[gap[~near] <= self.reach(other)])


def distances(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


def reach(kth: np.ndarray, relax: float) -> np.ndarray:
    return distances(np.maximum(kth, -1.0)) / relax + SLACK


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision, every row summed in the same order, so that equal vectors have equal scores."""
    dot, aa, bb = ((x * y).sum(axis=1) for x, y in ((a, b), (a, a), (b, b)))
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, relax: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best of the shard for each query, its own row left out. Ties go to the smaller id.

    Equal vectors are one point of the tree with its ids in order; the k + 1 smallest are enough, as one may be the query's own.
    """
    if not len(ids) or not len(query_ids):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    head = np.flatnonzero(np.r_[True, (vectors[1:] != vectors[:-1]).any(axis=1)])
    size = np.diff(np.r_[head, len(ids)])
    by_id = np.argsort(ids[head], kind="stable")  # points are numbered by their smallest id
    head, size = head[by_id], size[by_id]
    points = vectors[head]
    unit = points / np.sqrt((points * points).sum(axis=1))[:, None]
    asked = queries / np.sqrt((queries * queries).sum(axis=1))[:, None]
    # one more point than asked for, as a point may be only the query itself
    run = Search(points, unit, queries, asked, min(k + 1, len(points)), relax)
    run.visit(build(unit, np.arange(len(points)), np.random.default_rng(seed)), np.arange(len(queries)))
    who, place = np.nonzero(run.point >= 0)
    point = run.point[who, place]
    copies = np.minimum(size[point], k + 1)
    row = np.repeat(np.arange(len(who)), copies)
    at = head[point[row]] + np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
    q, found = who[row], ids[at]
    other = found != query_ids[q]
    q, at, found = q[other], at[other], found[other]
    score = cosines(queries[q], vectors[at])
    order = np.lexsort((found, -score, q))
    q, found, score = q[order], found[order], score[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    keep = rank < k
    return query_ids[q[keep]], found[keep], score[keep]


@dataclass
class Region:
    """A node of the tree over the sample: inside ``radius`` of ``point`` lies ``inner``; a region's number is a leaf."""

    point: np.ndarray
    radius: float
    inner: Region | int
    outer: Region | int


def regions(sample: np.ndarray, count: int, rng: np.random.Generator) -> Region | int:
    """A tree with ``count`` leaves at most, numbered from 0, each with about as much of the sample (rows of length one)."""
    number = iter(range(count))

    def grow(members: np.ndarray, leaves: int) -> Region | int:
        if leaves < 2 or len(members) < 4:
            return next(number)
        trial = members[rng.integers(0, len(members), 5)]
        far = distances(sample[trial] @ sample[members].T)
        k = int(np.argmax(far.std(axis=1)))
        radius = float(np.median(far[k]))
        inside = far[k] <= radius
        if inside.all():
            return next(number)
        return Region(sample[trial[k]], radius, grow(members[inside], (leaves + 1) // 2), grow(members[~inside], leaves // 2))

    return grow(np.arange(len(sample)), count)


def at_home(node: Region | int, unit: np.ndarray) -> np.ndarray:
    """Number of the region of each row."""
    if isinstance(node, int):
        return np.full(len(unit), node, np.int64)
    inside = distances(unit @ node.point) <= node.radius
    out = np.empty(len(unit), np.int64)
    out[inside], out[~inside] = at_home(node.inner, unit[inside]), at_home(node.outer, unit[~inside])
    return out


def within(node: Region | int, unit: np.ndarray, rows: np.ndarray, far: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Rows (numbers of ``unit``'s) with each region that may hold something within their distance ``far``."""
    if not len(rows):
        return
    if isinstance(node, int):
        yield rows, node
        return
    away = distances(unit[rows] @ node.point)
    yield from within(node.inner, unit, rows[away - far[rows] <= node.radius + SLACK], far)
    yield from within(node.outer, unit, rows[away + far[rows] >= node.radius - SLACK], far)


def near_one(v: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to 0.5 or more and below 1: no digit of a cosine changes, and no
    square overflows or vanishes."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None]) if v.size else v


def scaled(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    """Vectors of one length as rows of length one."""
    v = near_one(column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1))
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def by_dimension(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    dims = b.column("dim").to_numpy()
    for d in np.unique(dims).tolist():
        yield d, np.flatnonzero(dims == d)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, relax: float = 1.0, key: str = "vec_id", column: str = "embedding", shard_rows: int = SHARD, block_rows: int = BLOCK) -> DataFrame:
    """The k nearest rows of ``vectors`` by cosine for each row of ``queries``: query_id, rank (from 1), vec_id, score.

    Nearest first, ties to the smaller id; rows with the query's own id are no candidates. Vectors that are null, zero, or have
    a null or non-finite component take no part, and a query meets vectors of its own length alone. Of query rows that share an
    id one is asked; repeated rows of ``vectors`` are candidates each. Other columns don't matter, whatever their names. With
    ``relax`` 1 the result is exact. Regions come from a sample of at most about SAMPLE vectors; every vector is indexed.
    """

    def clean(df: DataFrame) -> DataFrame:
        v = F.col("v")
        finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
        some = F.exists(v, lambda x: x != 0)
        return df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{column}`").cast("array<double>").alias("v")).where("id is not null").where(F.when(v.isNotNull(), finite & some).otherwise(False)).withColumn("dim", F.size(v))

    index, asked = clean(vectors), settled(clean(queries).groupBy("id").agg(F.min_by("v", "v").alias("v"), F.min_by("dim", "v").alias("dim")))
    sizes = {r["dim"]: r["count"] for r in index.groupBy("dim").count().collect()}  # a row for each length of vectors
    total = max(1, sum(sizes.values()))
    trees: dict[int, Region | int] = dict.fromkeys(sizes, 0)
    if any(n > shard_rows for n in sizes.values()):
        chosen: dict[int, list] = {}
        for r in index.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(total)) < SAMPLE).select("dim", "v").limit(2 * SAMPLE).collect():
            chosen.setdefault(r["dim"], []).append(r["v"])
        for d, own in chosen.items():
            trees[d] = regions(scaled(pa.array(own), len(own)), -(-sizes[d] // shard_rows), np.random.default_rng(d))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows, np.int64)
            for d, own in by_dimension(b):
                out[own] = at_home(trees.get(d, 0), scaled(b.column("v").take(pa.array(own)), len(own)))
            yield b.append_column("region", pa.array(out))

    placed = "id bigint, v array<double>, dim int, region bigint"
    index, asked = settled(index.mapInArrow(home, placed)), settled(asked.mapInArrow(home, placed))
    # a region too large for a task is dealt by a hash of the id
    filled = index.groupBy("dim", "region").count().select("dim", "region", F.ceil(F.col("count") / shard_rows).cast("int").alias("parts"))
    filled = broadcast_if_small(settled(filled), MOST_BROADCAST)
    blocks = max(1, -(-asked.count() // block_rows))
    parts = index.join(filled, ["dim", "region"]).select("dim", "region", F.pmod(F.xxhash64("id", F.lit(1)), "parts").cast("int").alias("part"), "id", "v")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, query = table.column("id").to_numpy(), table.column("query").to_numpy()
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        flat = near_one(flat)
        q, found, score = search_shard(ids[~query], flat[~query], ids[query], flat[query], k, relax)
        return pa.table({"query_id": q, "vec_id": found, "score": score})

    def searched(visits: DataFrame) -> DataFrame:
        """The k best of each part of each region visited. Only parts and blocks of queries that meet are brought together."""
        block = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int").alias("block")
        visits = visits.join(filled, ["dim", "region"]).select("dim", "region", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), block, "id", "v")
        met = broadcast_if_small(settled(visits.select("dim", "region", "block").distinct()), MOST_BROADCAST)
        rows = parts.join(met, ["dim", "region"]).select("dim", "region", "part", "block", "id", "v", F.lit(False).alias("query")).unionByName(visits.withColumn("query", F.lit(True)))
        return rows.groupBy("dim", "region", "part", "block").applyInArrow(run, "query_id bigint, vec_id bigint, score double")

    first = settled(searched(asked))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    kth = first.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = reach(b.column("kth").to_numpy(), relax)
            homes = b.column("region").to_numpy()
            for d, own in by_dimension(b):
                unit = scaled(b.column("v").take(pa.array(own)), len(own))
                for rows, region in within(trees.get(d, 0), unit, np.arange(len(own)), far[own]):
                    rows = own[rows][homes[own[rows]] != region]
                    if len(rows):
                        yield b.select(["id", "v", "dim"]).take(pa.array(rows)).append_column("region", pa.array(np.full(len(rows), region, np.int64)))

    others = settled(asked.join(kth, "id", "left").select("id", "v", "dim", "region", F.coalesce("kth", F.lit(-1.0)).alias("kth")).mapInArrow(elsewhere, placed)) if any(isinstance(t, Region) for t in trees.values()) else None
    best = first if others is None else first.unionByName(searched(others))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_digest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The stated query set, every row whose id is divisible by ``every``, against all rows.

    Rows without an id, and vectors that are null, zero or not finite, take no part; an empty table has no result.
    """
    return nearest(vectors, vectors.where(F.col("vec_id") % every == 0), k)
