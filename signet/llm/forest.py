"""Approximate nearest neighbours: a forest of random-projection trees (operator 1).

Nearness is the largest inner product.  Vectors get one more component, so that all
have the length of the longest, and queries get zero there: then the nearest in angle
has the largest inner product, and trees that split by direction serve.

1. Equal vectors collapse to one, with the SHOWN + 1 smallest ids (a map-side top k):
   a vector that a third of all rows hold is indexed once.
2. TREES trees are fitted on a sample of at most SAMPLE distinct vectors: each node
   splits its sample at the median of a random projection that is at right angles to
   those above it.  The trees, of bounded size, are broadcast; every vector is put into
   its leaf of each tree.
3. A query walks all trees through one priority queue, least sum of the margins that it
   has crossed first, until the leaves it met hold as many vectors as a share of the
   index.  That share is measured: on the sample, ASKED of its vectors find RECALL of
   their nearest with it.  So it is small where vectors have structure, and what recall
   takes where they have none.
4. Neighbouring leaves of a tree make parts of about PART_ROWS vectors, and a larger
   leaf is dealt out to several; queries come in blocks of QUERY_ROWS.  In each part a
   leaf's queries meet its vectors in one matrix product, the best of all leaves are
   kept for each query, scored exactly in double precision, and only these go on.

Vectors that are null, zero, or hold null or non-finite components take no part, nor
do those of a length that isn't the most frequent (ties: the longest) and rows without
an id.  Repeated rows count once.  A query's own id is no candidate.  Ties go to the
smaller id.  Fewer candidates give fewer rows; no rows give none.  Very large components
are scaled down for the trees; scores are those of the vectors as they are, and a score
that is minus infinity or not a number, beyond the range of doubles, is no answer.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table

SHOWN, EVERY = 20, 20
TREES, LEAF, SAMPLE, PART_ROWS, QUERY_ROWS = 12, 64, 65_536, 65_536, 65_536
#: Vectors that are put into their leaves at once.
SLICE = 4096
#: The share of the nearest that a walk finds on the sample, by so many of its vectors; and the least candidates of a walk.
RECALL, ASKED, CANDIDATES = 0.94, 256, 400


#: Products of a query and vectors that differ by less than this share of their lengths' product count as tied until scored exactly.
ROUNDING = 1e-12


@dataclass
class Forest:
    """Complete binary trees of one depth: node k of a tree has children 2k + 1 and 2k + 2."""

    depth: int
    scale: float  # the largest component: vectors are divided by it
    longest: float
    directions: np.ndarray  # trees x nodes x (dimension + 1)
    bounds: np.ndarray  # trees x nodes
    counts: np.ndarray | None = None  # trees x leaves: vectors of the whole index

    @classmethod
    def of(cls, sample: np.ndarray, scale: float, longest: float, n: int, trees: int = TREES, leaf: int = LEAF, seed: int = 0) -> Forest:
        """Splits ``sample`` for an index of ``n`` vectors, down to ``leaf`` of these or 8 of the sample in a leaf."""
        depth = max(0, int(np.ceil(np.log2(max(1, min(n / leaf, len(sample) / 8))))))
        points, rng = lengthened(sample / scale, longest), np.random.default_rng(seed)
        directions = np.zeros((trees, (1 << depth) - 1, points.shape[1]), np.float32)
        bounds = np.zeros((trees, (1 << depth) - 1))
        for t in range(trees):
            own = {0: np.arange(len(points))}
            for k in range((1 << depth) - 1):
                rows = own.pop(k)
                way = rng.standard_normal(points.shape[1])
                if len(rows) > 1:  # a random direction within the spread of these points
                    a, b = points[rng.choice(rows, 16)].mean(0), points[rng.choice(rows, 16)].mean(0)
                    way = a - b if np.linalg.norm(a - b) > 1e-9 * longest else way
                ups, up = [], k
                while up:
                    up = (up - 1) // 2
                    ups.append(up)
                above = directions[t, ups[: points.shape[1] - 2]]
                rest = way - above.T @ (above @ way)
                way = rest if np.linalg.norm(rest) > 1e-3 * np.linalg.norm(way) else way
                directions[t, k] = way / np.linalg.norm(way)
                along = points[rows] @ directions[t, k].astype(float)
                bounds[t, k] = np.median(along) if len(rows) else 0.0
                own[2 * k + 1], own[2 * k + 2] = rows[along <= bounds[t, k]], rows[along > bounds[t, k]]
        return cls(depth, scale, longest, directions, bounds)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, vectors x trees."""
        out = np.zeros((len(vectors), len(self.directions)), np.int64)
        for low in range(0, len(vectors), SLICE):  # each vector meets the one node it is at, so memory is that of a slice
            points = lengthened(vectors[low : low + SLICE] / self.scale, self.longest)
            for t in range(len(self.directions)):
                at = np.zeros(len(points), np.int64)
                for _ in range(self.depth):
                    along = np.einsum("ij,ij->i", points, self.directions[t, at])
                    at = 2 * at + 1 + (along > self.bounds[t, at])
                out[low : low + SLICE, t] = at - ((1 << self.depth) - 1)
        return out

    def asking(self, queries: np.ndarray) -> np.ndarray:
        """Queries as points: of the longest length, and zero in the last component."""
        points = np.column_stack((queries / self.scale, np.zeros(len(queries))))
        return points / np.maximum(np.linalg.norm(points, axis=1), 1e-300)[:, None] * max(self.longest, 1e-300)

    def walk(self, queries: np.ndarray, candidates: int) -> list[list[tuple[int, int]]]:
        """For each query the (tree, leaf) met through the shared queue until they hold ``candidates`` vectors."""
        trees, inner = self.bounds.shape
        directions, found = self.directions.reshape(trees * inner, self.directions.shape[2]), []
        for point in self.asking(queries):
            margins = ((directions @ point.astype(np.float32)).reshape(trees, inner) - self.bounds).tolist()
            queue, met, held = [(0.0, t, 0) for t in range(trees)], [], 0
            while queue and held < candidates:
                cost, t, k = heapq.heappop(queue)
                while k < inner:
                    margin = margins[t][k]
                    near, far = (2 * k + 2, 2 * k + 1) if margin > 0 else (2 * k + 1, 2 * k + 2)
                    heapq.heappush(queue, (cost + abs(margin), t, far))
                    k = near
                if self.counts[t, k - inner]:
                    met.append((t, k - inner))
                    held += self.counts[t, k - inner]
            found.append(met)
        return found

    def share(self, sample: np.ndarray, recall: float = RECALL, asked: int = ASKED, shown: int = SHOWN) -> float:
        """The share of an index that walks must meet for ``recall`` of the ``shown`` nearest: measured on ``sample``, each leaf's cost at once."""
        if len(sample) <= shown + 1:
            return float(len(self.directions))
        leaves, (trees, inner) = self.leaves(sample), self.bounds.shape
        counts = np.stack([np.bincount(leaves[:, t], minlength=inner + 1) for t in range(trees)])
        places = np.linspace(0, len(sample) - 1, min(asked, len(sample))).astype(int)
        scaled, best = sample / self.scale, np.zeros((len(places), shown), int)
        for low in range(0, len(places), 16):  # a few rows of products at once
            some = places[low : low + 16]
            near = scaled[some] @ scaled.T
            near[np.arange(len(some)), some] = -np.inf
            best[low : low + 16] = np.argpartition(-near, shown - 1, axis=1)[:, :shown]
        needed = []
        for point, own in zip(self.asking(sample[places]), best, strict=True):
            margins, cost = self.directions @ point.astype(np.float32) - self.bounds, np.zeros((trees, 1))
            for d in range(self.depth):
                at = margins[:, (1 << d) - 1 : (2 << d) - 1]
                cost = np.stack((cost + np.maximum(at, 0), cost + np.maximum(-at, 0)), 2).reshape(trees, -1)
            order = np.argsort(cost, axis=None)
            ahead = np.empty(cost.size)
            ahead[order] = np.cumsum(counts.ravel()[order])
            needed.append(ahead.reshape(trees, -1)[np.arange(trees), leaves[own]].min(1))
        return float(np.quantile(np.concatenate(needed), recall)) / len(sample)


def lengthened(vectors: np.ndarray, longest: float) -> np.ndarray:
    rest = np.maximum(longest**2 - (vectors**2).sum(1), 0.0)
    return np.column_stack((vectors, np.sqrt(rest)))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """The distinct rows (vec_id, embedding as floats or doubles) that take part."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select("vec_id", F.col("embedding").cast(kind).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter("vec_id is not null and embedding is not null").filter(finite & F.exists("embedding", lambda x: x != 0))
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)).cast(kind)).distinct()  # -0.0 is 0.0
    size = F.size("embedding")
    most = rows.groupBy(size.alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return rows.filter(size == (most["size"] if most else 0))


def fit(distinct: DataFrame, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, recall: float = RECALL) -> tuple[Forest, float] | None:
    """A forest for ``distinct`` (rep, embedding), from its ``sample`` rows of least hash, and the share of it that walks must meet."""
    largest, n = distinct.agg(F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))), F.count("*")).first()
    if not n:
        return None
    longest = distinct.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x.cast("double") / F.lit(largest)) * (x / F.lit(largest))))).first()[0]
    some = distinct.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("embedding").toArrow()
    points = matrix(some.column("embedding"))
    forest = Forest.of(points, largest, float(np.sqrt(longest)), n, trees, leaf)
    return forest, forest.share(points, recall)


def search(vectors: DataFrame, asked: DataFrame, shown: int = SHOWN, candidates: int = CANDIDATES, recall: float = RECALL, trees: int = TREES, leaf: int = LEAF, part_rows: int = PART_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each id of ``asked`` (vec_id) its nearest of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors))
    by_vector = W.partitionBy("embedding").orderBy("vec_id")
    least = rows.withColumn("place", F.row_number().over(by_vector)).filter(F.col("place") <= shown + 1)
    distinct = stored(least.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0]))
    schema = "query_id long, rank int, vec_id long, score double"
    fitted = fit(distinct, trees, leaf, recall=recall)
    if fitted is None:
        return spark.createDataFrame([], schema)
    forest, share = fitted
    queries = stored(rows.join(asked.select("vec_id").distinct(), "vec_id").join(distinct.select("embedding", "rep"), "embedding").select(F.col("vec_id").alias("query_id"), F.col("rep").alias("asker")))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                found = shared.value.leaves(matrix(part.column("embedding")))
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(list(found.astype(np.int32)), pa.list_(pa.int32()))], names=["rep", "leaves"])

    shared = spark.sparkContext.broadcast(forest)  # bounded by SAMPLE and TREES
    leaves = stored(distinct.select("rep", "embedding").mapInArrow(placed, "rep long, leaves array<int>"))
    places = leaves.select("rep", F.posexplode("leaves").alias("tree", "leaf"))
    counts = places.groupBy("tree", "leaf").agg(F.count("*").alias("n")).toArrow()  # a row for each leaf of the forest
    t, k, n = (counts.column(c).to_numpy() for c in ("tree", "leaf", "n"))
    forest.counts = np.zeros((trees, 1 << forest.depth), np.int64)
    forest.counts[t, k] = n
    candidates = max(candidates, int(np.ceil(share * n.sum() / trees)))
    # leaf -> its first part and how many parts it has; a row of each table for each leaf of the forest
    many = np.maximum(-(-forest.counts // part_rows), 1)
    ends = np.cumsum(np.where(many > 1, 0, forest.counts), axis=1)
    first = np.where(many > 1, 0, np.maximum(ends - 1, 0) // part_rows)
    for t, leaf in np.argwhere(many > 1):
        first[t, leaf] = first[t].max() + 1 + (many[t, :leaf][many[t, :leaf] > 1] - 1).sum()
    known = spark.sparkContext.broadcast((forest, first, many))
    asks = queries.select(F.col("asker").alias("rep")).distinct()
    blocks = -(-max(1, asks.count()) // query_rows)

    def mixed(rep: np.ndarray, n) -> np.ndarray:
        return (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector once for each tree and block, with its part and leaf."""
        _, first, many = known.value
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                some = batch.slice(low, 2048)
                rep, found = some.column("rep").to_numpy(), np.stack(some.column("leaves").to_numpy(zero_copy_only=False))
                for t in range(found.shape[1]):
                    leaf = found[:, t]
                    part = first[t, leaf] + mixed(rep, many[t, leaf])
                    for block in range(blocks):
                        yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(rep), x, np.int32)) for x in (block, t)), pa.array(part.astype(np.int32)), some.column("rep"), some.column("embedding"), pa.array([[x] for x in leaf.tolist()], pa.list_(pa.int32()))], names=names)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for each part that holds leaves it met."""
        forest, first, many = known.value
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                block = mixed(some.column("rep").to_numpy(), blocks)
                rows: dict[tuple[int, int, int], list[int]] = {}
                for i, met in enumerate(forest.walk(matrix(some.column("embedding")), candidates)):
                    for t, leaf in met:
                        for p in range(first[t, leaf], first[t, leaf] + many[t, leaf]):
                            rows.setdefault((i, t, int(p)), []).append(leaf)
                i, t, p = np.array(list(rows), np.int32).T
                yield pa.RecordBatch.from_arrays([pa.array(block[i].astype(np.int32)), pa.array(t), pa.array(p), some.column("rep").take(pa.array(i)), some.column("embedding").take(pa.array(i)), pa.array(list(rows.values()), pa.list_(pa.int32()))], names=names)

    def compared(key: tuple, index: pa.Table, asking: pa.Table) -> pa.Table:
        if not index.num_rows or not asking.num_rows:
            return pa.table({"asker": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, q = matrix(index.column("embedding")), matrix(asking.column("embedding"))
        rep, asker = index.column("rep").to_numpy(), asking.column("rep").to_numpy()
        leaf = index.column("leaves").combine_chunks().flatten().to_numpy()
        order = np.argsort(leaf, kind="stable")
        lists = asking.column("leaves").combine_chunks()
        wanted, by = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
        turn = np.argsort(wanted, kind="stable")
        wanted, by = wanted[turn], by[turn]
        keep = shown + 4
        # the best by score, then those that tie with the last of these, by the smallest rep
        best, at = np.full((len(q), 2 * keep), -np.inf), np.full((len(q), 2 * keep), -1)
        largest = max(np.abs(x).max(), np.abs(q).max())
        longest = largest * np.sqrt(((x / largest) ** 2).sum(1).max())
        margin = ROUNDING * longest * largest * np.sqrt(((q / largest) ** 2).sum(1))
        for one in np.unique(wanted):
            rows = order[slice(*np.searchsorted(leaf[order], [one, one + 1]))]
            asks_it = by[slice(*np.searchsorted(wanted, [one, one + 1]))]
            for low in range(0, len(asks_it) if len(rows) else 0, 512):
                some = asks_it[low : low + 512]
                for cut_at in range(0, len(rows), 8192):
                    own = rows[cut_at : cut_at + 8192]
                    near = np.concatenate([best[some], q[some] @ x[own].T], axis=1)
                    place = np.concatenate([at[some], np.broadcast_to(own, (len(some), len(own)))], axis=1)
                    top = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
                    score = np.take_along_axis(near, top, 1)
                    lowest = score.min(1) - margin[some]
                    found, found_at = np.full((len(some), 2 * keep), -np.inf), np.full((len(some), 2 * keep), -1)
                    found[:, :keep], found_at[:, :keep] = score, np.take_along_axis(place, top, 1)
                    for r in np.flatnonzero(((near >= lowest[:, None]) & (near > -np.inf)).sum(1) > keep):
                        tied = (near[r] >= lowest[r]) & (near[r] > -np.inf)
                        tied[top[r]] = False
                        tied = np.flatnonzero(tied)
                        tied = tied[np.argsort(rep[place[r, tied]])[:keep]]
                        found[r, keep : keep + len(tied)], found_at[r, keep : keep + len(tied)] = near[r, tied], place[r, tied]
                    best[some], at[some] = found, found_at
        i, k = np.nonzero(at >= 0)
        j = at[i, k]
        score = np.concatenate([(x[j[low : low + 65536]] * q[i[low : low + 65536]]).sum(1) for low in range(0, len(j), 65536)] or [np.empty(0)])
        return pa.table({"asker": asker[i], "rep": rep[j], "score": score})

    names = ["block", "tree", "part", "rep", "embedding", "leaves"]
    groups = f"block int, tree int, part int, rep long, embedding {distinct.schema['embedding'].dataType.simpleString()}, leaves array<int>"
    index = distinct.select("rep", "embedding").join(leaves, "rep").mapInArrow(indexed, groups).groupBy(*names[:3])
    asking = distinct.select("rep", "embedding").join(asks, "rep").mapInArrow(walked, groups).groupBy(*names[:3])
    met = index.cogroup(asking).applyInArrow(compared, "asker long, rep long, score double").groupBy("asker", "rep").agg(F.max("score").alias("score"))
    top = met.withColumn("place", F.row_number().over(W.partitionBy("asker").orderBy(F.desc("score"), "rep"))).filter(F.col("place") <= shown + 1)
    near = top.join(distinct.select("rep", "ids"), "rep").select("asker", "score", F.explode("ids").alias("vec_id"))
    near = near.withColumn("place", F.row_number().over(W.partitionBy("asker").orderBy(F.desc("score"), "vec_id"))).filter(F.col("place") <= shown + 1).select("asker", "vec_id", "score")
    answered = queries.join(stored(near), "asker").filter("vec_id != query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answered.withColumn("rank", rank).filter(F.col("rank") <= shown).select("query_id", "rank", "vec_id", "score")


def op1_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
