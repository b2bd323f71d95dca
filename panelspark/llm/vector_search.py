"""Nearest neighbours by a forest of random-projection trees (operator 2)."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm.common import stored, table

#: Rows that the trees are grown on, about (chosen by a hash of the id); every row is indexed. Trees, and the sample's
#: rows in a leaf at most; a leaf holds more in proportion where the table is larger than the sample.
SAMPLE, TREES, LEAF, SEED = 60_000, 8, 192, 5
#: Leaves that a query visits in all trees together: as many as bring this recall among the sample's vectors, measured by
#: brute force for so many of them, and PROBES at least.
RECALL, ASKED, PROBES = 0.96, 100, 16
#: Index rows (a tree's entry of a vector) that meet the queries in one group, about.
GROUP = 20_000


@dataclass
class Forest:
    """For each tree its nodes: normal and offset of the plane, and the two children; a leaf is a child below 0."""

    normals: list[np.ndarray]
    offsets: list[np.ndarray]
    children: list[np.ndarray]

    @classmethod
    def grow(cls, x: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> Forest:
        """Each node parts its rows by a random direction between two of them, at the middle of the projections."""
        rng, forest = np.random.default_rng(seed), cls([], [], [])
        for _ in range(trees):
            normals, offsets, children, leaves = [], [], [], 0
            stack = [(np.arange(len(x)), -1, 0)]
            while stack:
                rows, parent, side = stack.pop()
                high = None
                if len(rows) > leaf:
                    for _ in range(8):
                        a, b = x[rng.choice(rows, 2, replace=False)]
                        normal = a - b
                        at = x[rows] @ normal
                        middle = float(np.median(at))
                        high = at > middle
                        if 0.1 * len(rows) < high.sum() < 0.9 * len(rows):
                            break
                    if not high.any() or high.all():
                        high = None
                if high is None:
                    here, leaves = -1 - leaves, leaves + 1
                else:
                    here = len(normals)
                    scale = max(float(np.linalg.norm(normal)), 1e-30)
                    normals.append(normal / scale)
                    offsets.append(middle / scale)
                    children.append([0, 0])
                    stack += [(rows[~high], here, 0), (rows[high], here, 1)]
                if parent >= 0:
                    children[parent][side] = here
            forest.normals.append(np.array(normals, np.float64).reshape(-1, x.shape[1]))
            forest.offsets.append(np.array(offsets))
            forest.children.append(np.array(children, np.int64).reshape(-1, 2))
        return forest

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree: rows x trees, numbered over all trees."""
        out = np.zeros((len(x), len(self.normals)), np.int64)
        for t, (normals, offsets, children) in enumerate(zip(self.normals, self.offsets, self.children)):
            at = np.zeros(len(x), np.int64) if len(normals) else np.full(len(x), -1)
            while (live := np.flatnonzero(at >= 0)).size:
                node = at[live]
                side = (np.einsum("ij,ij->i", x[live], normals[node]) > offsets[node]).astype(np.int64)
                at[live] = children[node, side]
            out[:, t] = (t << 32) + (-1 - at)
        return out

    def probes(self, q: np.ndarray, n: int) -> list[int]:
        """The first n leaves of a query in order of the least margin on the way to them, one queue for all trees."""
        margins = [normals @ q - offsets for normals, offsets in zip(self.normals, self.offsets)]
        queue = [(0.0, t, 0 if len(m) else -1) for t, m in enumerate(margins)]
        heapq.heapify(queue)
        out: list[int] = []
        while queue and len(out) < n:
            far, t, node = heapq.heappop(queue)
            while node >= 0:
                m = margins[t][node]
                near = int(m > 0)
                heapq.heappush(queue, (max(far, abs(m)), t, int(self.children[t][node, 1 - near])))
                node = int(self.children[t][node, near])
            out.append((t << 32) + (-1 - node))
        return out


def leaves_needed(forest: Forest, x: np.ndarray, k: int, recall: float = RECALL, asked: int = ASKED) -> int:
    """How many leaves, in order of the queue, hold the given share of the k true neighbours of some of the vectors x."""
    n = sum(len(m) + 1 for m in forest.normals)
    if len(x) < 2:
        return n
    of, found = forest.leaves(x), np.zeros(n, np.int64)
    for i in np.random.default_rng(SEED).choice(len(x), min(asked, len(x)), replace=False):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argpartition(d, min(k, len(d) - 1) - 1)[:k] if len(d) > 1 else []
        place = {leaf: at for at, leaf in enumerate(forest.probes(x[i], n))}
        np.add.at(found, [min(place[leaf] for leaf in of[j].tolist()) for j in near if j != i], 1)
    return int(np.searchsorted(np.cumsum(found), recall * found.sum())) + 1


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of the rows that take part: an id, a vector of the commonest length (the
    shorter among equals), all components finite, not all zero."""
    fine = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    )
    sizes = fine.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return fine.where(F.size("embedding") == (sizes[0] if sizes else 0))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every` the k nearest rows found.

    score is the Euclidean distance of the original vectors in double precision; ties go to the smaller vec_id. Rows that
    `usable` drops take no part; of several vectors of one id the smallest in order of components does. Equal vectors are
    indexed once, by their k + 1 smallest ids: no result needs more. Some leaves and the queries that visit them meet in a
    group of about GROUP rows; a leaf that would hold more is parted by a hash of the id, and its queries go to each part.
    Only each query's k best leave a group. An empty table gives no rows. Other columns aren't read.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    n = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    share = min(1.0, SAMPLE / n)
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < 1_000_003 * share).orderBy("vec_id").select("embedding").toArrow()
    sampled = _matrix(sample["embedding"].combine_chunks()) if len(sample) else np.zeros((0, 1))
    grown = Forest.grow(sampled)
    forest = spark.sparkContext.broadcast(grown)
    same = Window.partitionBy("embedding").orderBy("vec_id")
    kept = rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))

    n_groups = max(1, -(-n * len(grown.normals) // GROUP))
    visits = max(probes, leaves_needed(grown, sampled, k))
    splits = max(1, -(-int(LEAF / share) // GROUP))

    def group_of(leaves: np.ndarray, part) -> np.ndarray:
        return ((leaves & 0xFFFFFFFF) * 31 + (leaves >> 32) * 7 + part * 10_007) % n_groups

    def index(batches):
        for batch in batches:
            found = forest.value.leaves(_matrix(batch.column("embedding")))
            part = np.array([hash(ids[0]) % splits for ids in batch.column("ids").to_pylist()], np.int64)
            for t in range(found.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(group_of(found[:, t], part)), pa.array(found[:, t]), batch.column("ids"), batch.column("embedding")], ["part", "leaf", "ids", "embedding"])

    def ask(batches):
        for batch in batches:
            for i, q in enumerate(_matrix(batch.column("embedding"))):
                leaves = np.repeat(np.array(forest.value.probes(q, visits), np.int64), splits)
                parts = group_of(leaves, np.arange(len(leaves)) % splits)
                own = np.unique(parts)
                take = pa.array([i] * len(own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array([np.unique(leaves[parts == g]) for g in own], pa.list_(pa.int64())), batch.column("vec_id").take(take), batch.column("embedding").take(take)], ["part", "leaves", "query_id", "embedding"]
                )

    def meet(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        """Each query's k best among the members of the leaves that it visits here."""
        out = []
        if len(queries) and len(members):
            members = members.sort_values("leaf")
            x, leaf, ids = np.stack(members["embedding"].to_numpy()), members["leaf"].to_numpy(), members["ids"].to_numpy()
            for query, q, leaves in zip(queries["query_id"], queries["embedding"], queries["leaves"]):
                spans = zip(np.searchsorted(leaf, leaves), np.searchsorted(leaf, leaves, "right"))
                rows = np.concatenate([np.arange(a, b) for a, b in spans])
                if len(rows):
                    d = np.sqrt(((x[rows] - q) ** 2).sum(1))
                    # a row may be here once for each tree, and be the query itself
                    bound = np.partition(d, min(reach, len(d)) - 1)[min(reach, len(d)) - 1]
                    pairs = sorted({(float(d[i]), int(v)) for i in np.flatnonzero(d <= bound) for v in ids[rows[i]] if v != query})
                    out += [(query, v, s) for s, v in pairs[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    reach = (k + 1) * max(len(grown.normals), 1)
    members = kept.mapInArrow(index, "part long, leaf long, ids array<long>, embedding array<double>")
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(ask, "part long, leaves array<long>, query_id long, embedding array<double>")
    pairs = queries.groupBy("part").cogroup(members.groupBy("part")).applyInPandas(meet, "query_id long, vec_id long, score double")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
