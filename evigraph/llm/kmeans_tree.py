"""Approximate nearest neighbours by cosine: hierarchical k-means tree, best-bin-first."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, hashed_sample
from .textops import mix
from .vectors import matrix, unit, usable

#: Rows that the tree is fitted on, at most; every row is indexed.
SAMPLE = 20_000
#: Rows of the sample whose true neighbours calibrate the number of leaf visits.
CALIBRATION = 200
BRANCHES, LEAF_ROWS, LLOYD = 8, 64, 8
#: Vectors and queries of one leaf that meet in one task; larger leaves are split.
VECTORS, QUERIES = 4_096, 1_024


class Tree:
    """A k-means tree over unit vectors: per inner node its children's centres; leaves are numbered."""

    def __init__(self, sample: np.ndarray, seed: int = 7):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []  # >= 0: inner node, < 0: leaf -1 - number
        self.leaves = 0
        self.rng = np.random.default_rng(seed)
        self.root = self._grow(sample)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, rows: np.ndarray) -> int:
        if len(rows) <= LEAF_ROWS:
            return self._leaf()
        centres = rows[self.rng.choice(len(rows), BRANCHES, replace=False)]
        for _ in range(LLOYD):
            own = nearest(rows, centres)
            centres = np.stack([rows[own == k].mean(0) if (own == k).any() else centres[k] for k in range(len(centres))])
        own = nearest(rows, centres)
        used = [k for k in range(len(centres)) if (own == k).any()]
        if len(used) < 2:  # copies of one vector can't be split
            return self._leaf()
        node = len(self.centres)
        self.centres.append(centres[used])
        self.children.append([])
        self.children[node] = [self._grow(rows[own == k]) for k in used]
        return node

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row, by descent to the nearest centre."""
        out, todo = np.zeros(len(rows), np.int32), [(self.root, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = -1 - node
            elif len(at):
                own = nearest(rows[at], self.centres[node])
                todo += [(child, at[own == k]) for k, child in enumerate(self.children[node])]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves in best-bin-first order: the open node nearest to the query comes next."""
        queue, out = [(0.0, 0, self.root)], []
        while queue and len(out) < most:
            _, _, node = heapq.heappop(queue)
            if node < 0:
                out.append(-1 - node)
                continue
            gap = self.centres[node] - query
            for k, (d, child) in enumerate(zip((gap * gap).sum(1), self.children[node], strict=True)):
                heapq.heappush(queue, (float(d), node * BRANCHES + k + 1, child))
        return out


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(rows @ centres.T - 0.5 * (centres * centres).sum(1), axis=1)


def best(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, keys: np.ndarray, ids: np.ndarray, k: int):
    """(query index, row index, score) of each query's k nearest rows but its own key's; ties to the smaller id."""
    if not len(queries) or not len(rows):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    rough = queries @ rows.T
    rough[own[:, None] == keys[None, :]] = -np.inf
    floor = np.partition(rough, max(0, len(rows) - k), axis=1)[:, max(0, len(rows) - k)] - 1e-9
    q, r = np.nonzero((rough >= floor[:, None]) & np.isfinite(rough))
    score = np.concatenate([(queries[q[a : a + 100_000]] * rows[r[a : a + 100_000]]).sum(1) for a in range(0, len(q), 100_000)] or [np.zeros(0)])
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], r[keep], score[keep]


def calibrate(vectors: DataFrame, tree: Tree, keys: np.ndarray, rows: np.ndarray, k: int, recall: float) -> int:
    """Leaf visits at which the calibration queries find that share of their true k nearest among all rows."""

    def exact(batches):
        for b in batches:
            there, ids = unit(matrix(b.column("v"))), b.column("vec_id").to_numpy()
            q, r, s = best(rows, keys, there, b.column("row").to_numpy(), ids, k)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids[r]), pa.array(tree.assign(there)[r]), pa.array(s)], ["q", "vec_id", "leaf", "score"])

    near = vectors.mapInArrow(exact, "q long, vec_id long, leaf int, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    true = near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("q", "leaf").toPandas()
    order = {q: {leaf: n for n, leaf in enumerate(tree.visits(rows[q], tree.leaves))} for q in true["q"].unique()}
    needed = np.sort([order[q][leaf] + 1 for q, leaf in zip(true["q"], true["leaf"], strict=True)])
    visits = 1
    while visits < tree.leaves and np.mean(needed <= visits) < recall:
        visits += 1
    return visits


def nearest_neighbours(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", query_every: int = 20, k: int = 10, recall: float = 0.97, work: Workspace | None = None, sample: int = SAMPLE
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors by cosine that the tree finds.

    Queries are the rows whose id is divisible by query_every, candidates all
    rows but the query's own; scores are cosines in double precision on the
    original vectors, ties go to the smaller id. The tree is fitted on at most
    ``sample`` rows (by hash); all rows are indexed in its leaves. The number of
    leaves that each query visits is the least at which CALIBRATION other rows,
    on which the tree was not fitted, reach the recall against brute force (of
    small tables the same rows serve for both).

    Vectors that ``usable`` leaves out take no part, neither as queries nor as
    candidates. Rows that repeat an id are queries and candidates of their own.
    Leaves of many rows are split over tasks, rows and queries both. An empty
    table gives no rows.
    """
    spark = rows.sparkSession
    work = work or Workspace(spark)
    vectors = work.written(usable(rows, id_col, vec_col, nonzero=True), "vectors")
    some = hashed_sample(vectors, ["vec_id", "v"], sample + CALIBRATION).toPandas().sort_values(["vec_id", "row"])
    some = some.iloc[np.argsort(mix(some["vec_id"].to_numpy(np.int64).view(np.uint64)), kind="stable")]
    keys = some["row"].to_numpy(np.int64)
    known = unit(np.stack(some["v"].to_numpy())) if len(keys) else np.zeros((0, 1))
    tree = Tree(known[CALIBRATION:] if len(keys) > 4 * CALIBRATION else known)
    visits = calibrate(vectors, tree, keys[:CALIBRATION], known[:CALIBRATION], k, recall) if len(keys) else 1

    def assign(batches):
        for b in batches:
            leaf = tree.assign(unit(matrix(b.column("v")))) if b.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), b.column("row"), b.column("vec_id"), b.column("v")], ["leaf", "row", "vec_id", "v"])

    def choose(batches):
        for b in batches:
            all_ = unit(matrix(b.column("v")))
            found = [tree.visits(q, visits) for q in all_]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, []]).astype(np.int32)), *(b.column(c).take(pa.array(at)) for c in ("row", "vec_id", "v"))], ["leaf", "row", "vec_id", "v"])

    schema = "leaf int, row long, vec_id long, v array<double>"
    indexed = work.written(vectors.mapInArrow(assign, schema), "indexed")
    asked = work.written(vectors.filter(F.pmod("vec_id", F.lit(query_every)) == 0).mapInArrow(choose, schema), "asked")
    # one row per leaf: at most SAMPLE rows
    split = indexed.groupBy("leaf").agg(F.ceil(F.count("*") / VECTORS).cast("int").alias("parts")).join(
        asked.groupBy("leaf").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups")).hint("shuffle_merge"), "leaf"
    )
    split = work.written(split, "split")
    own, others = "cast(pmod(xxhash64(row), {}) as int)", "explode(sequence(0, {} - 1))"
    left = indexed.join(F.broadcast(split), "leaf").withColumn("part", F.expr(own.format("parts"))).withColumn("grp", F.expr(others.format("groups")))
    right = asked.join(F.broadcast(split), "leaf").withColumn("grp", F.expr(own.format("groups"))).withColumn("part", F.expr(others.format("parts")))

    def search(there: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(there) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "query_row": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "query_row": "int64"})
        a, b = there["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        q, r, s = best(unit(np.stack(queries["v"])), queries["row"].to_numpy(), unit(np.stack(there["v"])), there["row"].to_numpy(), a, k)
        return pd.DataFrame({"query_id": b[q], "vec_id": a[r], "query_row": queries["row"].to_numpy()[q], "score": s})

    keys = ["leaf", "part", "grp"]
    columns = [*keys, "row", "vec_id", "v"]
    found = left.select(*columns).groupBy(*keys).cogroup(right.select(*columns).groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, query_row long, score double")
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
