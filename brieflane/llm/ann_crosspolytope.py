"""Approximate nearest neighbours by cross-polytope hashing (operator 10).

Vectors are parted by their length into ranges (of ``RATIO``), each an index of its own that every
query probes; a small range is one bucket, looked at whole. In a range a vector is brought to
length 1 (shorter ones by one more component, so that the order of inner products is kept), turned by a pseudo-rotation (three times random signs and a fast Hadamard
transform), and hashed to its nearest signed axis. Several tables with independent rotations
hold every row; a query probes, in each table, the buckets of its next nearest axes too. The
candidates found are ranked by their exact inner product.

Equal vectors are one entry of the index, with the smallest ids that a query can need, so
copies do not fill buckets. A bucket is one task's work as long as it holds at most
``BUCKET_ROWS`` entries; larger ones are dealt by a hash of the id into parts, and a query
goes to each of the parts; where more than ``QUERY_ROWS`` queries meet in a bucket, they are dealt
by a hash into lots, and an entry goes to each of the lots. A bucket is a combination of ``hashes`` axes, whose number
follows the rows and components by one rule (``hashes_for``); there
are ``TABLES * hashes`` tables and ``PROBES ** hashes`` probes, so that as many neighbours
are found as with one axis.

Rules: see ``vectors.usable`` (zero vectors take no part); vectors of different lengths are not
compared; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brieflane.llm.common import saved
from brieflane.llm.vectors import matrix, usable

TABLES, PROBES, BUCKET_ROWS = 8, 16, 4096
QUERY_ROWS = 16_384  # queries of a bucket in one task
RATIO = 1.1  # between the largest and the smallest length of a range
HASH_ROWS = 256  # rows hashed at a time: two hashes look at (twice the dimension) ** 2 buckets of each


def hashes_for(rows: int, size: int) -> int:
    """Hashes of a bucket: as many as bring ``rows`` vectors of ``size`` components nearest to
    ``BUCKET_ROWS`` a bucket, each hash parting them by its signed axes (one at least)."""
    return max(1, round(math.log(max(rows, 1) / BUCKET_ROWS) / math.log(2 * width(size)))) if size > 1 else 1


def hadamard(y: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of every row (a power of two long), scaled to keep lengths."""
    d, h = y.shape[1], 1
    while h < d:
        y = y.reshape(-1, d // (2 * h), 2, h)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(-1, d)
        h *= 2
    return y / np.sqrt(d)


def width(d: int) -> int:
    return 1 << max(0, d - 1).bit_length()


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean norms, also of components whose squares are no doubles."""
    peak = np.abs(x).max(1)
    return peak * np.sqrt(((x / peak[:, None]) ** 2).sum(1))


def norm_ranges(found: list[tuple[int, float, float, int]], whole: int) -> dict[int, list[tuple[float, float, int]]]:
    """For each number of components the ranges of norms (least, most, rows) in rising order.
    ``found`` has (components, least, most, rows); neighbours that are one range together are
    joined, as rounding can part equal norms. A number of components with one range only is hashed
    whatever its rows."""
    out: dict[int, list[tuple[float, float, int]]] = {}
    for size, least, most, n in sorted(found):
        own = out.setdefault(size, [])
        if own and most <= own[-1][0] * (1 + 1e-5):
            least, most, n = own[-1][0], max(most, own[-1][1]), n + own.pop()[2]
        own.append((least, most, n))
    return {size: [(a, b, max(n, whole + 1)) for a, b, n in own] if len(own) == 1 else own for size, own in out.items()}


def rotated(x: np.ndarray, table: int, turn: int, seed: int) -> np.ndarray:
    d = width(x.shape[1])
    y = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    signs = np.random.default_rng([seed, table, turn]).choice([-1.0, 1.0], (3, d))
    for s in signs:
        y = hadamard(y * s)
    return y


def axes(x: np.ndarray, table: int, hashes: int, probes: int, seed: int = 0) -> np.ndarray:
    """The ``probes`` best buckets of each row (rows x probes), best first. A bucket is the
    number made of one signed axis for each of ``hashes`` rotations."""
    best, cost, d2 = None, None, 0
    for turn in range(hashes):
        y = rotated(x, table, turn, seed)
        both = np.concatenate([y, -y], 1)
        d2 = both.shape[1]
        some = np.argsort(-both, 1, kind="stable")[:, :min(probes, d2)]
        loss = both.max(1)[:, None] - np.take_along_axis(both, some, 1)
        if best is None:
            best, cost = some, loss
            continue
        pairs = list(itertools.product(range(best.shape[1]), range(some.shape[1])))
        a, b = [p[0] for p in pairs], [p[1] for p in pairs]
        code, total = best[:, a] * d2 + some[:, b], cost[:, a] + loss[:, b]
        first = np.argsort(total, 1, kind="stable")[:, :probes]
        best, cost = np.take_along_axis(code, first, 1), np.take_along_axis(total, first, 1)
    return best


def best_of(q: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: list[np.ndarray], k: int):
    """For each query the ids and exact scores of its k best entries, itself left out."""
    rough = q @ x.T
    for i in range(len(q)):
        row = rough[i]
        if len(row) > k + 1:
            floor = np.partition(row, len(row) - k - 1)[len(row) - k - 1]
            some = np.flatnonzero(row >= floor - 1e-9 * (1.0 + abs(floor)))
        else:
            some = np.arange(len(row))
        exact = (x[some] * q[i]).sum(1)
        own = np.concatenate([ids[j] for j in some])
        score = np.repeat(exact, [len(ids[j]) for j in some])
        score, own = score[own != qid[i]], own[own != qid[i]]
        first = np.lexsort((own, -score))[:k]
        yield np.full(len(first), qid[i]), own[first], score[first]


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
               tables: int | None = None, probes: int | None = None, hashes: int | None = None, seed: int = 0,
               whole: int = BUCKET_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): ``is_query`` is over the column ``id``. Tables and probes
    follow the number of hashes unless they are given. Where lengths differ, a range of them with
    at most ``whole`` rows is one bucket."""
    data = usable(vectors, id_col, vector_col, zero=False)
    w = Window.partitionBy("v").orderBy("id")
    entries = (data.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1)
               .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    peak = F.array_max(F.transform("v", F.abs))
    norm = F.col("peak") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("peak")) * (x / F.col("peak"))))
    sized = data.select(F.size("v").alias("size"), "v", peak.alias("peak")).select("size", norm.alias("norm"))
    # one row for each length and range of norms, not for each vector
    found_ranges = (sized.groupBy("size", F.floor(F.log("norm") / math.log(RATIO)).alias("band"))
                    .agg(F.max("norm").alias("most"), F.min("norm").alias("least"), F.count("*").alias("n")).collect())
    rows_of: dict[int, int] = {}
    for r in found_ranges:
        rows_of[r["size"]] = rows_of.get(r["size"], 0) + r["n"]
    turns_of = {size: hashes or hashes_for(n, size) for size, n in rows_of.items()}
    ranges = norm_ranges([(r["size"], r["least"], r["most"], r["n"]) for r in found_ranges], whole)

    def hashed(query: bool):
        def run(batches):
            for batch in batches:
                t = pa.Table.from_batches([batch])
                lens = np.array([len(x) for x in t["v"]], np.int64)
                for size in np.unique(lens).tolist():
                    same = t.filter(pa.array(lens == size))
                    for at in range(0, same.num_rows, HASH_ROWS):
                        part = same.slice(at, HASH_ROWS)
                        x = matrix(part["v"])
                        norms = lengths(x)
                        home = np.searchsorted([r[1] for r in ranges[size]], norms * (1 - 1e-9))
                        home = np.minimum(home, len(ranges[size]) - 1)
                        for band, (least, most, n) in enumerate(ranges[size]):
                            mine = np.arange(len(x)) if query else np.flatnonzero(home == band)
                            if not len(mine):
                                continue
                            if n <= whole:  # one bucket
                                codes = np.zeros((len(mine), 1, 1), np.int64)
                            else:
                                even = least >= most * (1 - 1e-5)  # vectors of one length need no more component
                                u = x[mine] / norms[mine, None] if even or query else x[mine] / most
                                if not even:
                                    rest = 0.0 if query else np.sqrt(np.maximum(1 - (norms[mine] / most) ** 2, 0.0))
                                    u = np.concatenate([u, np.broadcast_to(rest, len(mine))[:, None]], 1)
                                # as many of all buckets, should the component double their number
                                turns = turns_of[size]
                                own = (probes or PROBES ** turns) * (width(u.shape[1]) // width(size)) ** turns if query else 1
                                codes = np.stack([axes(u, i, turns, own, seed) for i in range(tables or TABLES * turns)], 1)
                            yield pa.RecordBatch.from_arrays([
                                part[0].take(pa.array(mine)).combine_chunks(), pa.array([size] * len(mine), pa.int32()),
                                pa.array([band] * len(mine), pa.int32()), pa.array([r.tobytes() for r in x[mine]], pa.binary()),
                                pa.array(codes.tolist(), pa.list_(pa.list_(pa.int64())))],
                                names=[t.column_names[0], "size", "band", "v", "codes"])
        return run

    def spread(df: DataFrame) -> DataFrame:
        return (df.select("*", F.posexplode("codes").alias("tab", "buckets")).drop("codes")
                .select("*", F.explode("buckets").alias("bucket")).drop("buckets"))

    keys = ["size", "band", "tab", "bucket"]
    index = saved(entries.select("ids", "v").mapInArrow(
        hashed(False), "ids array<bigint>, size int, band int, v binary, codes array<array<bigint>>"))
    questions = saved(data.where(is_query).select("id", "v").mapInArrow(
        hashed(True), "id bigint, size int, band int, v binary, codes array<array<bigint>>"))
    rows, asked = spread(index), spread(questions)
    cells = (rows.groupBy(*keys).agg(F.ceil(F.count("*") / BUCKET_ROWS).cast("int").alias("parts"))
             .join(asked.groupBy(*keys).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("lots")), keys))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = rows.join(cells, keys).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    rows = rows.select(*keys, "part", every("lots").alias("lot"), "ids", "v")
    asked = asked.join(cells, keys).withColumn("lot", F.pmod(F.xxhash64("id"), F.col("lots")).cast("int"))
    asked = asked.select(*keys, every("parts").alias("part"), "lot", "id", "v")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            q, x = (np.array([np.frombuffer(b, np.float64) for b in t["v"].to_pylist()]) for t in (left, right))
            ids = [np.array(i, np.int64) for i in right["ids"].to_pylist()]
            qid = left["id"].to_numpy()
            for at in range(0, len(q), 512):
                found += best_of(q[at:at + 512], qid[at:at + 512], x, ids, k)
        cols = [np.concatenate([f[i] for f in found] or [np.zeros(0)]) for i in range(3)]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)),
                         "score": pa.array(cols[2].astype(np.float64))})

    cut = [*keys, "part", "lot"]
    found = asked.groupBy(*cut).cogroup(rows.groupBy(*cut)).applyInArrow(
        cell, "query_id bigint, vec_id bigint, score double")
    # a pair found in several tables has the same score in each
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
