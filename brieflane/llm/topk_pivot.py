"""Exact top-k search by pivot-table elimination (operator 6).

Distances of every vector to many pivots are computed once and stored beside it. For a query
q and a candidate x, max over pivots |d(q, p) - d(x, p)| is a lower bound of their distance,
hence (|q|^2 + |x|^2 - bound^2) / 2 an upper bound of their inner product. Candidates are
evaluated in the order of that bound until it falls under the k-th best score: no candidate
left can be among the k best, so the result is exact.

Queries and candidates are dealt into blocks of bounded size by a hash of the id; every pair
of a query block and a candidate block is one cell with a task's work, whose k best for each
query are merged by a top-k window. The work is that of the query set against all rows.

Rules: see ``vectors.usable``; vectors of different lengths are not compared; ties go to the
smaller id; with fewer than k candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brieflane.llm.vectors import matrix, usable

PIVOTS, BLOCK_ROWS, QUERY_ROWS = 48, 8192, 1024
CELL = "query_id bigint, vec_id bigint, score bigint"
EXACT, LONG = 1 << 52, (1 << 63) - 1


def floored(v: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(v * float(scale))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(d2, 0.0))


def search_cell(queries: tuple, rows: tuple, k: int, evaluated: list | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """queries, rows: (ids, integer-valued vectors, pivot distances). For each query the ids and
    scores of its k best rows other than itself. ``evaluated`` gets the numbers of rows scored."""
    (qid, q, qd), (rid, r, rd) = queries, rows
    rn, out = (r * r).sum(1), []
    for i in range(len(qid)):
        qn = float(q[i] @ q[i])
        # the slack covers the rounding of distances
        low = np.maximum(np.abs(rd - qd[i]).max(1) - 1e-7 * (1.0 + np.sqrt(qn + rn)), 0.0)
        bound = (qn + rn - low * low) / 2.0
        bound += 1e-9 * (qn + rn) + 1.0
        order = np.argsort(-bound)
        ids, scores, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 4 * k
        while at < len(order):
            if len(scores) >= k and bound[order[at]] < scores[k - 1]:
                break
            some = order[at:at + step]
            at, step = at + step, step * 2
            some = some[rid[some] != qid[i]]
            if evaluated is not None:
                evaluated.append(len(some))
            if float(np.sqrt(qn) * np.sqrt(rn[some].max(initial=0.0))) < EXACT:
                got = (r[some] @ q[i]).astype(np.int64)
            else:  # beyond what doubles hold exactly; what a long does not hold ends at its bounds
                got = np.array([min(max(sum(int(a) * int(b) for a, b in zip(x, q[i])), -LONG), LONG) for x in r[some]], np.int64)
            ids, scores = np.concatenate([ids, rid[some]]), np.concatenate([scores, got])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
        out.append((np.full(len(ids), qid[i]), ids, scores))
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id",
          vector_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): ``is_query`` is over the column ``id``."""
    data = usable(vectors, id_col, vector_col, zero=True)
    n = data.count()
    n_queries = data.where(is_query).count() if n else 0
    blocks, query_blocks = -(-n // BLOCK_ROWS) or 1, -(-n_queries // QUERY_ROWS) or 1
    chosen = [r[0] for r in data.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()]
    by_size = {size: floored(np.array([c for c in chosen if len(c) == size]), scale) for size in {len(c) for c in chosen}}

    def measure(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            lens = np.array([len(x) for x in table["v"]], np.int64)
            for size in np.unique(lens).tolist():
                part = table.filter(pa.array(lens == size))
                x = floored(matrix(part["v"]), scale)
                d = distances(x, by_size.get(size, np.zeros((1, size))))
                yield pa.RecordBatch.from_arrays([
                    part["id"].combine_chunks(), pa.array([size] * len(x), pa.int32()),
                    pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in d], pa.binary())],
                    names=["id", "size", "v", "d"])

    measured = data.mapInArrow(measure, "id bigint, size int, v binary, d binary")
    spread = F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(1 << 30))
    rows = (measured.withColumn("block", (spread % blocks).cast("int"))
            .withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))))
    queries = (measured.where(is_query).withColumn("query_block", (spread % query_blocks).cast("int"))
               .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))

    def unpack(t: pa.Table) -> tuple:
        make = lambda name: np.array([np.frombuffer(b, np.float64) for b in t[name].to_pylist()])
        return t["id"].to_numpy(), make("v"), make("d")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found = search_cell(unpack(left), unpack(right), k) if left.num_rows and right.num_rows else []
        cols = [np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in range(3)]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("query_id", "vec_id", "score"), cols)})

    keys = ("size", "query_block", "block")
    found = queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(cell, CELL)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
