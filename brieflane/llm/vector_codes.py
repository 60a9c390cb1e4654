"""Vector code compression by active-entry Lloyd (operator 13).

Vectors of integers are cut into equal parts, and each part position has a codebook that starts
from the rows with the smallest ids. A round assigns every part to its nearest entry and replaces
each entry by the rounded-down mean of its parts. The table carries each part's entry and exact
distance from round to round: a part whose entry did not move in the last round compares only the
entries that moved with what is stored; other parts look at all entries again. Ties go to the lower
index either way.

A round is one pass over the rows, which writes the new assignments and, once for each task, the
sums and counts of the parts by entry; these are added up by Spark, and only the codebooks (entries
x components) come to the driver and go out again. Rounds end early when no entry moved, as all
later ones would be the same. A round's table is deleted when the next one is written.

All arithmetic is exact: in doubles as long as they hold every sum, else in Python's integers.

Rules: rows with a null vector or null or non-finite components are dropped; other rows stay, also
those with a null id, a null label, or an id that is repeated (each row counts; of rows with one id
the smaller vector comes first). Null ids come after all others. Vectors whose length is no multiple
of the number of parts are filled up with zeros; vectors of different (filled) lengths have codebooks
of their own. With fewer rows than entries there are as many entries as rows. Components beyond
2**60 in size count as 2**60; errors beyond a long as its largest value. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from brieflane.llm.common import discard, intermediate
from brieflane.llm.vectors import matrix
from brieflane.operators.skew import salted_join

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LIMIT, LONG = 1 << 60, (1 << 63) - 1
ROWS = 4096  # rows worked on at a time
STATE = ("id {id}, label {label}, v array<bigint>, codes array<int>, distances array<bigint>, error bigint, "
         "sums array<struct<size:int,part:int,entry:int,n:bigint,total:array<decimal(38,0)>>>")


def peak(x: np.ndarray) -> int:
    return int(np.abs(x).max(initial=0))


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows by entries."""
    if 4 * max(x.shape[1], 1) * max(peak(x), peak(book)) ** 2 < 1 << 52:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    apart = x.astype(object)[:, None, :] - book.astype(object)[None]
    return (apart * apart).sum(2)


def assign(x: np.ndarray, book: np.ndarray, moved: np.ndarray | None, codes: np.ndarray, distances: np.ndarray,
           scanned: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Entries and distances of one part position. ``moved``: entries that are new since ``codes``
    and ``distances`` were found (None: all are); a negative distance is one that was not stored.
    ``scanned`` gets the number of distances that were computed."""
    codes, distances = codes.copy(), distances.astype(object) if distances.dtype == object else distances.copy()
    whole = np.ones(len(x), bool) if moved is None else moved[codes] | (distances < 0)
    some = np.flatnonzero(whole)
    if len(some):
        d = squared(x[some], book)
        best = d.argmin(1)  # the lowest index of equals
        codes[some] = best
        near = np.take_along_axis(d, best[:, None], 1)[:, 0]
        if near.dtype == object:
            distances = distances.astype(object)
        distances[some] = near
        if scanned is not None:
            scanned.append(d.size)
    rest, entries = np.flatnonzero(~whole), np.flatnonzero(moved) if moved is not None else []
    if len(rest) and len(entries):
        d = squared(x[rest], book[entries])
        best = d.argmin(1)
        near, entry = np.take_along_axis(d, best[:, None], 1)[:, 0], entries[best]
        nearer = ((near < distances[rest]) | ((near == distances[rest]) & (entry < codes[rest]))).astype(bool)
        if near.dtype == object:
            distances = distances.astype(object)
        codes[rest[nearer]], distances[rest[nearer]] = entry[nearer], near[nearer]
        if scanned is not None:
            scanned.append(d.size)
    return codes, distances


class Sums:
    """Sums and counts of the parts by entry, over the rows of a task."""

    def __init__(self):
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, x: np.ndarray, codes: np.ndarray, entries: int) -> None:
        parts = codes.shape[1]
        cut = x.reshape(len(x), parts, -1)
        if x.shape[1] not in self.held:
            self.held[x.shape[1]] = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, cut.shape[2]), object)
        n, total = self.held[x.shape[1]]
        exact = peak(x) * len(x) < 1 << 52
        for p in range(parts):
            one = codes[:, p, None] == np.arange(entries)
            n[p] += one.sum(0)
            total[p] += ((one.T.astype(np.float64) @ cut[:, p].astype(np.float64)).astype(np.int64).astype(object) if exact
                         else one.T.astype(object) @ cut[:, p].astype(object))

    def rows(self) -> list[dict]:
        from decimal import Decimal
        return [{"size": size, "part": p, "entry": e, "n": int(n[p, e]), "total": [Decimal(int(t)) for t in total[p, e]]}
                for size, (n, total) in self.held.items() for p, e in np.argwhere(n).tolist()]


def integer_rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int, scale: int) -> DataFrame:
    """(id, label, v): floor(scale * x) of every kept vector, filled up with zeros."""
    x = F.col(vector_col).cast("array<double>")
    good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.alias("x")).where(F.col("x").isNotNull() & good)
    whole = F.transform("x", lambda c: F.greatest(F.least(F.floor(c * float(scale)), F.lit(LIMIT)), F.lit(-LIMIT)))
    fill = F.array_repeat(F.lit(0).cast("bigint"), F.pmod(-F.size("x"), F.lit(parts)))
    return kept.select("id", "label", F.concat(whole, fill).alias("v"))


def one_round(books: dict[int, np.ndarray], moved: dict[int, np.ndarray] | None, arrow: pa.Schema):
    """Function for mapInArrow: new codes, distances and errors of the rows, then the task's sums."""
    def run(batches):
        sums = Sums()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = pa.Table.from_batches([batch.slice(at, ROWS)])
                lens = pa.compute.list_value_length(some["v"]).to_numpy()
                for size in np.unique(lens).tolist():
                    rows = some.filter(pa.array(lens == size))
                    x, book = matrix(rows["v"]).reshape(rows.num_rows, size), books[size]
                    parts, cut = len(book), x.reshape(rows.num_rows, len(book), -1)
                    if moved is None:
                        codes, far = np.zeros((len(x), parts), np.int64), np.full((len(x), parts), -1, np.int64)
                    else:
                        codes, far = (matrix(rows[c]).reshape(len(x), parts) for c in ("codes", "distances"))
                    found = [assign(cut[:, p], book[p], moved[size][p] if moved else None, codes[:, p], far[:, p]) for p in range(parts)]
                    codes = np.stack([c for c, _ in found], 1)
                    sums.add(x, codes, book.shape[1])
                    if all(d.dtype != object for _, d in found) and peak(x) < 1 << 20 and size < 1 << 20:
                        far = np.stack([d for _, d in found], 1)
                        error = far.sum(1)
                    else:
                        far = np.stack([d.astype(object) for _, d in found], 1)
                        error = np.array([min(sum(map(int, r)), LONG) for r in far], np.int64)
                        far = np.where(far > LONG, -1, far).astype(np.int64)  # computed again in the next round
                    lists = lambda m, kind: pa.ListArray.from_arrays(
                        pa.array(np.arange(0, m.size + 1, parts), pa.int32()), pa.array(m.reshape(-1), kind))
                    yield pa.RecordBatch.from_arrays([
                        rows["id"].combine_chunks().cast(arrow[0].type), rows["label"].combine_chunks().cast(arrow[1].type),
                        rows["v"].combine_chunks().cast(arrow[2].type), lists(codes, pa.int32()), lists(far, pa.int64()),
                        pa.array(error, pa.int64()), pa.nulls(len(x), arrow[6].type)], schema=arrow)
        if sums.held:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, arrow[i].type) for i in range(6)), pa.array([sums.rows()], arrow[6].type)],
                                             schema=arrow)
    return run


def moved_entries(state: DataFrame, books: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """The codebooks after the assignment in ``state``, and which of their entries moved."""
    each = state.where(F.col("sums").isNotNull()).select(F.explode("sums").alias("s")).select("s.*")
    each = each.select("size", "part", "entry", "n", F.posexplode("total").alias("place", "total"))
    found = each.groupBy("size", "part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    new = {size: book.copy() for size, book in books.items()}
    for r in found.collect():  # the codebooks, whatever the number of rows
        new[r["size"]][r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return new, {size: (new[size] != books[size]).any(2) for size in books}


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """The rows (id, label, v, codes, distances, error) and the codebooks (part, entry, component)
    for each length of vectors."""
    spark = vectors.sparkSession
    kept = integer_rows(vectors, id_col, vector_col, label_col, parts, scale)
    first = Window.partitionBy(F.size("v")).orderBy(F.col("id").asc_nulls_last(), "v")
    seeds = kept.withColumn("place", F.row_number().over(first)).where(F.col("place") <= entries)
    starts: dict[int, list] = {}
    for r in seeds.orderBy("place").select("v").collect():  # at most ``entries`` rows for each length
        starts.setdefault(len(r["v"]), []).append(r["v"])
    books = {size: np.ascontiguousarray(np.array(rows, np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2)) for size, rows in starts.items()}
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = STATE.format(id=kinds["id"], label=kinds["label"])
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    state, moved, path = kept, None, None
    for at in range(rounds + 1):
        before, path = path, intermediate(spark, "codes")
        state.mapInArrow(one_round(books, moved, arrow), schema).write.parquet(path)
        if before:
            discard(spark, before)
        written = spark.read.schema(schema).parquet(path)
        state = written.where(F.col("sums").isNull()).drop("sums")
        if at < rounds:
            books, moved = moved_entries(written, books)
            if not any(m.any() for m in moved.values()):
                break
    return state, books


def coded(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", **options) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) for every kept row."""
    rows, books = compress(vectors, id_col, label_col=label_col, **options)
    digests = {size: hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest() for size, book in books.items()}
    digest = F.lit(None).cast("string")
    for size, text in digests.items():
        digest = F.when(F.size("v") == size, F.lit(text)).otherwise(digest)
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    key = [F.col("label").isNull().alias("no_label"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label_text")]
    out = rows.select("id", code.alias("code"), "error", digest.alias("codebooks_sha256"), *key)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("bigint")
    totals = rows.select("error", *key).groupBy("no_label", "label_text").agg(total.alias("label_error"))
    joined = salted_join(out, totals, ["no_label", "label_text"], salt_source=F.xxhash64("id", "code"))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256")
