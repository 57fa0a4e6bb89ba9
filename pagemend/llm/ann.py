"""Approximate nearest neighbours with a forest of random-projection trees.

Every level of a tree has a random line (through two sampled vectors), and a node splits at
the median of the projections on it. Trees are complete binary trees fitted on at most
``SAMPLE`` vectors (taken by a hash of the id); all vectors are then sent down all trees. A
query walks all trees through one priority queue, ordered by the sum of the squared margins
on the way, and takes the first ``LEAVES`` leaves, however large the table is. A vector has a
vote for each tree in which one of these leaves holds it. About ``RERANK`` of most votes (the
least number of votes is read off the sample, with no cap on ties) are ranked by exact
distances in double precision.

Vectors are dealt once, by a hash of the id, into blocks of bounded size, and queries, dealt
into bounded parts too, visit each block with their leaves as bits. A block's trees hold
numbers only, so each vector moves once a part of queries, and only the k best of a block
leave it. Queries that found fewer than k are compared with every vector.

The sample bounds the depth: beyond ``SAMPLE / LEAST_SAMPLED * LEAF`` vectors leaves grow with
the table, and a larger sample should be asked for.

Defined cases: vectors that are null, zero, hold nulls or non-finite components, or have
another length than most, and rows with a null id, take no part; rows that repeat an id are
one item at the smallest distance of its rows; ties go to the smaller id; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tune

TREES = 40
LEAF = 200
SAMPLE = 20_000
LEAST_SAMPLED = 40
LEAVES = 1024
RERANK = 4000
VECTORS_A_BLOCK = 20_000
QUERIES_A_PART = 10_000
SEED = 5


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, v): rows that take part, kept, as arrays of float or double as they came."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    rows = cut(rows.select("vec_id", v.alias("v")))
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (top[0] if top else 0))


class Forest:
    """Complete trees of one depth: node i of a tree has children 2i + 1 and 2i + 2."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        n, d = sample.shape
        self.depth, self.leaves = depth, 1 << depth
        self.lines = np.zeros((trees, depth, d))
        self.cuts = np.zeros((trees, self.leaves - 1))
        for t in range(trees):
            node = np.zeros(n, np.int64)
            for level in range(depth):
                a, b = sample[rng.integers(0, n, 2)]
                line = a - b if (a != b).any() else rng.normal(size=d)
                self.lines[t, level] = line / np.linalg.norm(line)
                proj = sample @ self.lines[t, level]
                first = (1 << level) - 1
                order = np.lexsort((proj, node))
                start = np.searchsorted(node[order], np.arange(first, 2 * first + 2))
                for i, (lo, hi) in enumerate(zip(start, start[1:], strict=False)):
                    if lo < hi:  # a node without a sample keeps 0
                        self.cuts[t, first + i] = proj[order[(lo + hi) // 2]]
                node = 2 * node + 1 + (proj >= self.cuts[t][node])
        self.sample_leaf = self.leaf_of(sample)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """(trees, n): the leaf of each row in each tree."""
        out = np.zeros((len(self.lines), len(x)), np.int32)
        for t, lines in enumerate(self.lines):
            node = np.zeros(len(x), np.int64)
            for proj in (x @ lines.T).T:
                node = 2 * node + 1 + (proj >= self.cuts[t][node])
            out[t] = node - (self.leaves - 1)
        return out

    def walk(self, q: np.ndarray, leaves: int) -> np.ndarray:
        """(trees, leaves) of bool: the leaves to visit, by the least sum of squared margins over all trees."""
        proj, cuts = (self.lines @ q).tolist(), self.cuts.tolist()
        heap = [(0.0, t, 0, 0) for t in range(len(self.lines))]
        inner, hit, left = self.leaves - 1, np.zeros((len(self.lines), self.leaves), bool), leaves
        while heap and left:
            m, t, node, level = heapq.heappop(heap)
            while node < inner:  # the near child costs nothing: go down, and keep the far one
                d = proj[t][level] - cuts[t][node]
                near = 2 * node + 1 + (d >= 0)
                heapq.heappush(heap, (m + d * d, t, 4 * node + 3 - near, level + 1))
                node, level = near, level + 1
            hit[t, node - inner] = True
            left -= 1
        return hit

    def least_votes(self, hit: np.ndarray, share: float) -> int:
        """The fewest votes that at most this share of the sample has; the most that any has, if that is more."""
        votes = sum(h[leaf].astype(np.int16) for h, leaf in zip(hit, self.sample_leaf, strict=True))
        at_least = np.bincount(votes)[::-1].cumsum()[::-1]
        few = np.flatnonzero(at_least <= share * len(votes))
        return int(max(1, min(few[0] if len(few) else len(at_least), len(at_least) - 1)))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _walk(forest, leaves: int, share: float):
    def run(batches):
        f = forest.value
        for batch in batches:
            if not batch.num_rows:
                continue
            hits = [f.walk(q, leaves) for q in _matrix(batch.column(1))]
            least = [f.least_votes(h, share) for h in hits]
            bits = [np.packbits(h).tobytes() for h in hits]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary()), pa.array(least, pa.int32())], names=["query_id", "q", "bits", "least"])

    return run


def _first(ids: np.ndarray, d: np.ndarray, k: int) -> dict[int, float]:
    """The k nearest distinct ids with their distances."""
    out: dict[int, float] = {}
    for i in np.lexsort((ids, d)).tolist():
        out.setdefault(int(ids[i]), float(d[i]))
        if len(out) == k:
            break
    return out


class Block:
    """Vectors with each tree's leaves as lists of row numbers."""

    def __init__(self, forest: Forest, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        leaf = forest.leaf_of(x)
        self.order = np.argsort(leaf, axis=1, kind="stable")
        self.starts = np.stack([np.searchsorted(row[o], np.arange(forest.leaves + 1)) for row, o in zip(leaf, self.order, strict=True)])

    def voted(self, hit: np.ndarray, least: int) -> np.ndarray:
        """Rows with at least so many votes; only the lists of visited leaves are read."""
        t, leaf = np.nonzero(hit)
        a, n = self.starts[t, leaf], self.starts[t, leaf + 1] - self.starts[t, leaf]
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum()) + np.repeat(t * len(self.ids), n)
        return np.flatnonzero(np.bincount(self.order.ravel()[at], minlength=len(self.ids)) >= least)

    def nearest(self, q: np.ndarray, own: int, rows: np.ndarray, k: int) -> dict[int, float]:
        rows = rows[self.ids[rows] != own]
        if not len(rows):
            return {}
        d = np.sqrt(((self.x[rows] - q) ** 2).sum(axis=1))
        close = d <= np.partition(d, 4 * k)[4 * k] if len(rows) > 8 * k else np.ones(len(rows), bool)
        found = _first(self.ids[rows[close]], d[close], k)
        return found if len(found) == k or close.all() else _first(self.ids[rows], d, k)  # rows of few ids


FOUND = pa.schema([("block", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("n_tested", pa.int64())])


def _rerank(forest, k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(vectors) or not len(queries):
            return FOUND.empty_table()
        f, out, number = forest.value, [], vectors["block"][0].as_py()
        block = Block(f, vectors["vec_id"].to_numpy(), _matrix(vectors["v"]))
        shape = (len(f.lines), f.leaves)
        for own, q, bits, least in zip(queries["query_id"].to_pylist(), _matrix(queries["q"]), queries["bits"].to_pylist(), queries["least"].to_pylist(), strict=True):
            if least:
                hit = np.unpackbits(np.frombuffer(bits, np.uint8), count=shape[0] * shape[1]).reshape(shape).astype(bool)
                rows = block.voted(hit, least)
            else:
                rows = np.arange(len(block.ids))
            out += [(number, own, i, s, len(rows)) for i, s in block.nearest(q, own, rows, k).items()]
        return pa.table([pa.array(c, x.type) for c, x in zip(zip(*out, strict=True) if out else [[]] * len(FOUND), FOUND, strict=True)], schema=FOUND)

    return run


def _search(rows: DataFrame, queries: DataFrame, shipped, k: int, n: int) -> DataFrame:
    """(block, query_id, vec_id, score, n_tested): the k best of each block."""
    blocks, parts = max(1, -(-n // VECTORS_A_BLOCK)), max(1, -(-queries.count() // QUERIES_A_PART))
    dealt = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.select(dealt("vec_id", blocks).alias("block"), every(parts).alias("part"), "vec_id", "v")
    right = queries.select(every(blocks).alias("block"), dealt("query_id", parts).alias("part"), "query_id", "q", "bits", "least")
    key = ["block", "part"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        _rerank(shipped, k), "block int, query_id long, vec_id long, score double, n_tested long"
    )


def nearest(table: DataFrame, query_filter, k: int = 10, trees: int = TREES, leaf: int = LEAF, leaves: int = LEAVES, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score, n_tested): the k nearest found of every row that query_filter picks, and how many distances that took."""
    spark = table.sparkSession
    tune(spark)
    rows = usable(table)
    n = rows.count()
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).select("v").toArrow()  # at most ``sample`` vectors
    if not len(chosen):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, n_tested long")
    deep = lambda m, size: max(0, int(np.floor(np.log2(max(1, m / size)) + 0.5)))
    depth = min(deep(n, leaf), deep(len(chosen), min(LEAST_SAMPLED, leaf)))
    shipped = spark.sparkContext.broadcast(Forest(_matrix(chosen["v"]), trees, depth))  # as large as the sample at most
    asked = rows.filter(query_filter).mapInArrow(_walk(shipped, leaves, rerank / n), f"query_id long, q {rows.schema['v'].dataType.simpleString()}, bits binary, least int")
    queries = cut(asked)
    found = cut(_search(rows, queries, shipped, k, n))
    # rows of few ids among those of most votes, or a table of few rows
    enough = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).filter(F.col("n") >= k).select("query_id")
    short = queries.join(enough, "query_id", "left_anti")
    if not short.isEmpty():
        again = _search(rows, short.withColumn("least", F.lit(0)), shipped, k, n)
        found = found.join(enough, "query_id", "left_semi").unionByName(again)
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    tested = found.groupBy("query_id", "block").agg(F.max("n_tested").alias("n")).groupBy("query_id").agg(F.sum("n").alias("n_tested"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(tested, "query_id").select("query_id", "rank", "vec_id", "score", "n_tested")
