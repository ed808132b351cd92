"""Exact top-k inner products: vectors by descending length, SVD-rotated partial sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace
from .vectors import matrix, usable

#: Vectors of a candidate block, queries of a query block, rotated dimensions summed before the bound is tried.
BLOCK, QUERY_BLOCK, LEADING = 1_024, 1_024, 16
#: Rows of a step inside a block; blocks that one task keeps for the queries that come through.
STEP, HELD = 512, 16


def rotation(vectors: DataFrame) -> np.ndarray:
    """Right singular vectors of all rows, largest singular value first, from the summed d x d products."""

    def products(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v"))
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], ["g"])

    cells = vectors.mapInArrow(products, "g array<double>").select(F.posexplode("g").alias("i", "x"))
    sums = cells.groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")["x"].to_numpy()
    d = int(np.sqrt(len(sums)))
    return np.linalg.eigh(sums.reshape(d, d))[1][:, ::-1].copy() if d else np.zeros((0, 0))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of rows in descending length: (n, top double, ids, rows, v), the last three as packed int64."""

    def pack(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= size:
                table = pa.Table.from_batches(held).combine_chunks()
                yield one(table.slice(0, size))
                held, n = table.slice(size).to_batches(), n - size
        if n:
            yield one(pa.Table.from_batches(held).combine_chunks())

    def one(table):
        x = matrix(table.column("v")).astype(np.int64)
        length = float(np.sqrt(table.column("norm2")[0].as_py()))
        return pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([length]), *(pa.array([table.column(c).to_numpy().tobytes()], pa.binary()) for c in ("vec_id", "row")), pa.array([x.tobytes()], pa.binary())], ["n", "top", "ids", "rows", "v"])

    dealt = rows.repartitionByRange(F.desc("norm2"), "vec_id").sortWithinPartitions(F.desc("norm2"), "vec_id")
    return dealt.mapInArrow(pack, "n long, top double, ids binary, rows binary, v binary")


def _unpack(ids: bytes, rows: bytes, v: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(rows, np.int64), np.frombuffer(v, np.int64).reshape(len(ids), -1)


def _lengths(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.sqrt((x * x).sum(1))


def exact_dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All integer inner products: by float64 where every sum stays below 2**53, else by int64."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def _merged(q: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int):
    """The k largest scores of each query, ties to the smaller id, and which of them are a query's k-th."""
    order = np.lexsort((ids, -s, q))
    q, ids, s = q[order], ids[order], s[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return q[keep], ids[keep], s[keep], (place == k - 1)[keep]


def scan(qrows: np.ndarray, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, turn: np.ndarray, least: np.ndarray, k: int):
    """(query index, id, score): up to k best rows of a block for each query, among those that may reach ``least``.

    Rows come in descending length. A step of rows is skipped once no query's
    length times theirs reaches its bound; then the leading rotated dimensions
    are summed and the rest is bounded by Cauchy-Schwarz; exact integer products
    are taken of what is left. Bounds have a slack for rounding.
    """
    qr, xr = q.astype(np.float64) @ turn, x.astype(np.float64) @ turn
    q_len, x_len = np.sqrt((qr * qr).sum(1)), np.sqrt((xr * xr).sum(1))
    q_rest, x_rest = np.sqrt((qr[:, LEADING:] ** 2).sum(1)), np.sqrt((xr[:, LEADING:] ** 2).sum(1))
    least, out = least.astype(np.float64).copy(), []
    kept_q, kept_id, kept_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a in range(0, len(x), STEP):
        xs = slice(a, a + STEP)
        slack = 1e-9 * (1 + q_len * x_len[a])
        live = np.flatnonzero(q_len * x_len[a] + slack >= least)
        if not len(live):
            break
        bound = qr[live, :LEADING] @ xr[xs, :LEADING].T + np.outer(q_rest[live], x_rest[xs]) + slack[live, None]
        may = (bound >= least[live, None]) & (qrows[live, None] != rows[None, xs])
        if not may.any():
            continue
        i, j = np.nonzero(may)
        if len(i) * 4 > may.size:
            score = exact_dots(q[live], x[xs])[i, j]
        else:
            score = np.concatenate([(q[live[i[s : s + 100_000]]] * x[xs][j[s : s + 100_000]]).sum(1) for s in range(0, len(i), 100_000)])
        ok = score >= least[live[i]]
        kept_q, kept_id, kept_s = np.append(kept_q, live[i[ok]]), np.append(kept_id, ids[xs][j[ok]]), np.append(kept_s, score[ok])
        kept_q, kept_id, kept_s, full = _merged(kept_q, kept_id, kept_s, k)
        least[kept_q[full]] = np.maximum(least[kept_q[full]], kept_s[full])
    return kept_q, kept_id, kept_s


def top_inner_products(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", query_every: int = 20, k: int = 10, scale: int = 256, work: Workspace | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score long): each query's k largest integer inner products, exactly.

    Components become floor(scale * x), x as double. Queries are the rows whose
    id is divisible by query_every, candidates all rows but the query's own;
    ties go to the smaller id. Vectors that ``usable`` leaves out take no part;
    zero vectors do. Rows that repeat an id are queries and candidates of their
    own. ValueError where a score might not fit a long.

    Every query gets its first bound from the longest block, of bounded size.
    Then blocks of queries come through tasks that hold HELD blocks of candidates
    each: these are met in descending length, and each query's bound tightens
    from one to the next.
    """
    work = work or Workspace(rows.sparkSession)
    whole = usable(rows, id_col, vec_col, nonzero=False).withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")))
    whole = work.written(whole.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), "vectors")
    if (whole.agg(F.max("norm2")).first()[0] or 0) >= 2.0**62:
        raise ValueError("inner products of these vectors may not fit a long")
    turn = rotation(whole)
    blocks = work.written(_packed(whole, BLOCK).withColumn("block", F.monotonically_increasing_id()), "blocks")
    first = blocks.orderBy(F.desc("top"), "block").limit(1).collect()  # one block
    seed = _unpack(first[0]["ids"], first[0]["rows"], first[0]["v"]) if first else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 1), np.int64))

    def bounded(batches):
        for b in batches:
            for r in b.to_pylist():
                _, qrows, q = _unpack(r["ids"], r["rows"], r["v"])
                least = np.full(len(q), -np.inf)
                qi, _, s, full = _merged(*scan(qrows, q, *seed, turn, least, k), k)
                least[qi[full]] = s[full]
                # the length that a block needs so that some query may find something in it
                need = np.where(least > 0, least / np.maximum(_lengths(q), 1e-300), 0.0)
                yield pa.RecordBatch.from_arrays([*(pa.array([r[c]], pa.binary()) for c in ("ids", "rows", "v")), pa.array([least.tobytes()], pa.binary()), pa.array([float(need.min())])], ["qids", "qrows", "q", "least", "need"])

    queries = _packed(whole.filter(F.pmod("vec_id", F.lit(query_every)) == 0), QUERY_BLOCK)
    queries = queries.mapInArrow(bounded, "qids binary, qrows binary, q binary, least binary, need double").withColumn("asked", F.monotonically_increasing_id())
    queries = work.written(queries, "queries")
    salts = max(1, -(-blocks.count() // HELD))
    left = queries.withColumn("salt", F.explode(F.expr(f"sequence(0, {salts - 1})")))
    right = blocks.select(F.expr(f"cast(pmod(xxhash64(block), {salts}) as int)").alias("salt"), "top", "ids", "rows", "v")
    right = right.repartition("salt").sortWithinPartitions("salt", F.desc("top"))
    met = left.hint("shuffle_merge").join(right.hint("shuffle_merge"), "salt").filter(F.col("top") * (1 + 1e-9) >= F.col("need"))

    def search(batches):
        asked, least, kept = None, None, None
        for r in (b.slice(n, 1).to_pylist()[0] for b in batches for n in range(b.num_rows)):
            (qids, qrows, q), block = _unpack(r["qids"], r["qrows"], r["q"]), _unpack(r["ids"], r["rows"], r["v"])
            if r["asked"] != asked:
                asked, least, kept = r["asked"], np.frombuffer(r["least"], np.float64).copy(), [np.zeros(0, np.int64)] * 3
            qi, found, s = scan(qrows, q, *block, turn, least, k)
            *kept, full = _merged(*(np.append(x, y) for x, y in zip(kept, (qi, found, s), strict=True)), k)
            least[kept[0][full]] = np.maximum(least[kept[0][full]], kept[2][full])
            yield pa.RecordBatch.from_arrays([pa.array(qids[qi]), pa.array(qrows[qi]), pa.array(found), pa.array(s)], ["query_id", "query_row", "vec_id", "score"])

    out = met.select("asked", "qids", "qrows", "q", "least", "ids", "rows", "v").mapInArrow(search, "query_id long, query_row long, vec_id long, score long")
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
