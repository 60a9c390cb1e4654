"""Hard-negative mining by an inverted multi-index (operator 11).

Vectors of integers are cut into two halves, each half has a codebook, and a row's cell is the pair
of its nearest entries. An entry's radius is the largest distance of a half that it stands for, so
for a query q a row of cell (i, j) scores at most the sum of two half bounds, q1.c1[i] + |q1| r1[i]
and q2.c2[j] + |q2| r2[j]. A multi-sequence heap visits cells by falling sums, over the two sorted
lists of half bounds, and stops when what is wanted is certain:
- positives: the k-th best row of the anchor's label scores more than the next cell's bound;
- negatives: each positive's window of scores holds its first rows, and the last of them scores
  more than the bound, or the bound is under the window.

The codebooks come from a bounded sample; every row is indexed. Rows lie in blocks of neighbouring
cells (large cells are dealt into several blocks by a hash), and an anchor is sent to the blocks
whose best cell can still matter: first to its own block, whose rows give a first floor for the
positives, then to those that reach the floor, then, with the positives' scores known, to those that
reach the lowest window. A block and at most ``QUERY_ROWS`` anchors are one task's work; in the block
the heap runs over the entries that occur there, with the radii of its own rows. Results are exact
whatever the codebooks are; these only decide how many rows are scored.

Rules: ids are whole numbers, labels too. Rows with a null id, label or vector, an empty vector, or
null or non-finite components take no part; of rows under one id the one with the smallest vector,
then label, counts. Vectors of different lengths are not compared. Ties go to the smaller id. An
anchor without positives, or a positive without rows in its window, gives no rows. Components beyond
2**60 in size count as 2**60, scores beyond a long as its bounds. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from brieflane.llm.common import saved, share
from brieflane.llm.vectors import matrix

#: Rows of a block, anchors of a task, rows that the codebooks come from.
BLOCK_ROWS, QUERY_ROWS, SAMPLE_ROWS = 8192, 4096, 8192
#: Rows for each cell that the codebook size aims at, and the most entries of a codebook.
CELL_ROWS, MOST_ENTRIES = 64, 256
LIMIT, LONG, EXACT = 1 << 60, (1 << 63) - 1, 1 << 52


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for at in range(0, len(x), 4096):
        some = x[at:at + 4096]
        out[at:at + 4096] = ((book * book).sum(1) - 2.0 * (some @ book.T)).argmin(1)
    return out


def codebook(x: np.ndarray, entries: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's method from evenly spaced rows; entries without rows stay."""
    book = x[np.linspace(0, len(x) - 1, min(entries, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, book)
        n = np.bincount(near, minlength=len(book))
        for e in np.flatnonzero(n):
            book[e] = x[near == e].mean(0)
    return book


class Halves:
    """The index over vectors of one length: the two codebooks, the radii of their entries, and the
    cells (entry, entry, first block, blocks)."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray]):
        self.books, self.radii = books, [np.zeros(len(b)) for b in books]
        self.cells = np.zeros((0, 4), np.int64)

    def cut(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.books[0].shape[1]
        return x[..., :at], x[..., at:]

    def blocks_above(self, q: np.ndarray, floor: float) -> np.ndarray:
        """Blocks that hold a cell whose bound reaches ``floor``."""
        a, b = (half_bounds(h, book, r) for h, book, r in zip(self.cut(q), self.books, self.radii))
        good = self.cells[a[self.cells[:, 0]] + b[self.cells[:, 1]] >= floor]
        return np.unique(np.concatenate([np.arange(f, f + n) for _, _, f, n in good.tolist()] or [np.zeros(0, np.int64)]))


def half_bounds(q: np.ndarray, book: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Highest score of a half of each entry; the slack covers the rounding of doubles."""
    size = float(np.sqrt(q @ q))
    slack = 1e-9 * size * (np.sqrt((book * book).sum(1)) + radii) + 0.5
    return book @ q + size * radii + slack


def multi_sequence(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Pairs of positions in the two lists, both falling, by falling sum."""
    if not len(a) or not len(b):
        return
    heap = [(-(a[0] + b[0]), 0, 0)]
    while heap:
        low, i, j = heapq.heappop(heap)
        yield -low, i, j
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))


class Best:
    """The first ``k`` of what it is given, by falling score and rising id."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        first = np.lexsort((ids, -scores))[:self.k]
        self.ids, self.scores = ids[first], scores[first]

    def floor(self) -> float:
        """Score that a further row needs at least (it may be a tie)."""
        return self.scores[-1] if len(self.scores) == self.k else -math.inf


class Positives:
    def __init__(self, label: int, k: int, floor: float):
        self.label, self.known, self.best = label, floor, Best(k)

    def floor(self) -> float:
        return max(self.best.floor(), self.known)

    def add(self, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        good = (labels == self.label) & (scores >= self.floor())
        if good.any():
            self.best.add(ids[good], scores[good])


class Negatives:
    """The windows of an anchor's positives: low% of the positive's score to high%."""

    def __init__(self, label: int, targets: list[tuple[int, int]], k: int, low: int, high: int):
        self.label, self.low, self.high = label, low, high
        self.windows = [(p, s, Best(k)) for p, s in targets if low * s <= high * s]  # none under a negative score

    def _floor(self, score: int, best: Best) -> float:
        return max(best.floor(), -(-self.low * score // 100))

    def floor(self) -> float:
        return min((self._floor(s, b) for _, s, b in self.windows), default=math.inf)

    def add(self, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        some = np.flatnonzero((labels != self.label) & (scores >= self.floor()))
        ids, scores = ids[some], scores[some]
        if not len(ids):
            return
        hundred = scores * 100
        for _, s, best in self.windows:
            good = (hundred >= self.low * s) & (hundred <= self.high * s) & (scores >= best.floor())
            if good.any():
                best.add(ids[good], scores[good])


class Block:
    """The rows of a block in the order of their cells."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, codes: np.ndarray, halves: Halves):
        order = np.lexsort((codes[:, 1], codes[:, 0]))
        self.ids, self.labels, self.whole, codes = ids[order], labels[order], x[order], codes[order]
        self.x = self.whole.astype(np.float64)
        self.most, self.halves = float(lengths(self.x).max(initial=0)), halves
        self.entries, self.radii, places = [], [], []
        for half, (part, book) in enumerate(zip(halves.cut(self.x), halves.books)):
            entries, place = np.unique(codes[:, half], return_inverse=True)
            radii = np.zeros(len(entries))
            np.maximum.at(radii, place, lengths(part - book[codes[:, half]]))
            self.entries.append(book[entries])
            self.radii.append(radii)
            places.append(place)
        cell = places[0] * max(len(self.entries[1]), 1) + places[1]
        firsts = np.flatnonzero(np.diff(cell, prepend=-1))
        self.cells = dict(zip(cell[firsts].tolist(), zip(firsts.tolist(), np.append(firsts[1:], len(cell)).tolist())))

    def scores(self, spans: list[tuple[int, int]], q: np.ndarray, whole: np.ndarray) -> np.ndarray:
        if self.most * float(np.sqrt(q @ q)) < EXACT:
            return np.concatenate([self.x[a:b] @ q for a, b in spans]).astype(np.int64)
        ints = [int(c) for c in whole]  # beyond what doubles hold exactly
        return np.array([min(max(sum(int(a) * b for a, b in zip(row, ints)), -LONG), LONG) for s, e in spans for row in self.whole[s:e]], object)

    def search(self, query: int, whole: np.ndarray, wanted: Positives | Negatives, scored: list | None = None) -> None:
        """Gives ``wanted`` the rows of cells, best bound first, until none left can matter.
        ``scored`` gets the number of rows that were scored."""
        q = whole.astype(np.float64)
        bounds = [half_bounds(h, e, r) for h, e, r in zip(self.halves.cut(q), self.entries, self.radii)]
        first, second = (np.argsort(-b, kind="stable") for b in bounds)
        wide, step, spans, held = len(second), 128, [], 0

        def take() -> None:
            starts, ends = np.array(spans).T
            sizes = ends - starts
            rows = np.repeat(ends - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
            scores = self.scores(spans, q, whole)
            other = self.ids[rows] != query
            wanted.add(self.ids[rows][other], self.labels[rows][other], scores[other])
            if scored is not None:
                scored.append(len(rows))

        floor = wanted.floor()
        a, b, at, other = bounds[0][first], bounds[1][second], first.tolist(), second.tolist()
        for bound, i, j in multi_sequence(a.tolist(), b.tolist()):
            if bound < floor:
                break
            span = self.cells.get(at[i] * wide + other[j])
            if span is None:
                continue
            spans.append(span)
            held += span[1] - span[0]
            if held >= step:
                take()
                spans, held, step, floor = [], 0, min(step * 2, 2048), wanted.floor()
        if spans:
            take()


def cleaned(vectors: DataFrame, relabel: Column | None, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v): integer vectors, one row for each id; ``relabel`` is over id and label."""
    x = F.col(vector_col).cast("array<double>")
    good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    out = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), x.alias("x"))
    out = out.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & good)
    whole = F.transform("x", lambda c: F.greatest(F.least(F.floor(c * float(scale)), F.lit(LIMIT)), F.lit(-LIMIT)))
    out = out.select("id", (F.col("label") if relabel is None else relabel).alias("label"), whole.alias("v"))
    return out.groupBy("id").agg(F.min(F.struct("v", "label")).alias("r")).select("id", "r.label", "r.v")


def build(rows: DataFrame) -> tuple[DataFrame, dict[int, Halves]]:
    """The rows with size, codes and block, and the index of each length of vectors."""
    spark, n = rows.sparkSession, rows.count()
    entries = min(MOST_ENTRIES, max(1, math.ceil(math.sqrt(n / CELL_ROWS))))
    sample: dict[int, list] = {}
    for r in rows.where(share("id", n, SAMPLE_ROWS)).select("id", "v").orderBy(F.xxhash64("id")).collect() if n else []:
        sample.setdefault(len(r["v"]), []).append(r["v"])
    index = {}
    for size, own in sample.items():
        x = np.array(own, np.float64)
        index[size] = Halves((codebook(x[:, :size // 2], entries), codebook(x[:, size // 2:], entries)))

    def halves_of(size: int) -> Halves:  # a length that the sample lacks has one cell
        return index.get(size) or Halves((np.zeros((1, size // 2)), np.zeros((1, size - size // 2))))

    def code(batches):
        for batch in batches:
            some = pa.Table.from_batches([batch])
            lens = pa.compute.list_value_length(some["v"]).to_numpy()
            for size in np.unique(lens).tolist():
                part = some.filter(pa.array(lens == size))
                halves = halves_of(size)
                cut = halves.cut(matrix(part["v"]).astype(np.float64))
                codes = [nearest(h, book) for h, book in zip(cut, halves.books)]
                far = [lengths(h - book[c]) for h, book, c in zip(cut, halves.books, codes)]
                yield pa.RecordBatch.from_arrays([
                    part["id"].combine_chunks(), part["label"].combine_chunks(), part["v"].combine_chunks(),
                    pa.array(np.full(len(codes[0]), size), pa.int32()), *(pa.array(c, pa.int32()) for c in codes), *map(pa.array, far)],
                    names=["id", "label", "v", "size", "i", "j", "far_i", "far_j"])

    coded = saved(rows.mapInArrow(code, "id bigint, label bigint, v array<bigint>, size int, i int, j int, far_i double, far_j double"))
    # at most MOST_ENTRIES ** 2 cells of a length
    cells = coded.groupBy("size", "i", "j").agg(F.count("*").alias("n"), F.max("far_i").alias("far_i"), F.max("far_j").alias("far_j")).collect()
    placed, block, room = [], -1, 0
    by_size: dict[int, list] = {}  # neighbouring cells share a block as long as it has room
    for c in sorted(cells, key=lambda c: (c["size"], c["i"], c["j"])):
        if c["size"] not in by_size or c["n"] > room:
            block, room = block + 1, BLOCK_ROWS
        parts = -(-c["n"] // BLOCK_ROWS)
        by_size.setdefault(c["size"], []).append((c, block, parts))
        placed.append((c["size"], c["i"], c["j"], block, parts))
        block, room = block + parts - 1, room - c["n"] if parts == 1 else 0
    for size, own in by_size.items():
        halves = index[size] = halves_of(size)
        for c, _, _ in own:
            for radii, at, far in zip(halves.radii, (c["i"], c["j"]), (c["far_i"], c["far_j"])):
                radii[at] = max(radii[at], far)
        halves.cells = np.array([(c["i"], c["j"], first, parts) for c, first, parts in own], np.int64)
    where = spark.createDataFrame(placed, "size int, i int, j int, first int, parts int")
    spread = F.pmod(F.xxhash64(F.lit("block"), "id"), F.col("parts"))
    out = coded.join(F.broadcast(where), ["size", "i", "j"])
    return out.select("size", (F.col("first") + spread).cast("int").alias("block"), "id", "label", "v", "i", "j"), index


ASK = "size int, block int, id bigint, label bigint, v array<bigint>, home int, floor double, targets array<struct<id:bigint,score:bigint>>"


def asked(queries: DataFrame, index: dict[int, Halves], with_home: bool) -> DataFrame:
    """One row for each block that an anchor (id, label, v, size, block, floor, targets) is sent to."""
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            pairs = [(r, b) for r in rows for b in index[r["size"]].blocks_above(
                np.array(r["v"], np.float64), -math.inf if r["floor"] is None else r["floor"]).tolist() if with_home or b != r["block"]]
            for at in range(0, len(pairs), 1024):
                some = pairs[at:at + 1024]
                yield pa.RecordBatch.from_pylist([{**r, "home": r["block"], "block": b} for r, b in some], schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(ASK))
    return queries.select("size", "block", "id", "label", "v", F.col("floor").cast("double").alias("floor"), "targets").mapInArrow(run, ASK)


def searched(asks: DataFrame, rows: DataFrame, index: dict[int, Halves], want: Callable, answer: Callable, schema: str) -> DataFrame:
    """``want(ask)`` is what a block's rows are searched for, ``answer(id, wanted)`` its rows of ``schema``."""
    keys = ["size", "block"]
    lots = asks.groupBy(*keys).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("lots"))
    left = asks.join(lots, keys).withColumn("lot", F.pmod(F.xxhash64("id"), F.col("lots")).cast("int")).drop("lots")
    right = rows.join(lots, keys).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")
    names = [f.split()[0] for f in schema.split(", ")]

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if a.num_rows and b.num_rows:
            codes = np.stack([b["i"].to_numpy(), b["j"].to_numpy()], 1)
            block = Block(b["id"].to_numpy(), b["label"].to_numpy(), matrix(b["v"]), codes, index[b["size"][0].as_py()])
            for ask, v in zip(a.drop_columns(["v"]).to_pylist(), matrix(a["v"])):
                wanted = want(ask)
                block.search(ask["id"], v, wanted)
                out += answer(ask["id"], wanted)
        return pa.table({name: pa.array([r[at] for r in out], pa.int64()) for at, name in enumerate(names)})

    cut = [*keys, "lot"]
    return left.groupBy(*cut).cogroup(right.groupBy(*cut)).applyInArrow(cell, schema)


def mine(vectors: DataFrame, is_anchor: Column, relabel: Column | None = None, positives: int = 5, negatives: int = 3,
         low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): ``is_anchor`` is
    over the column ``id``, ``relabel`` over ``id`` and ``label``."""
    rows, index = build(saved(cleaned(vectors, relabel, scale, id_col, vector_col, label_col)))
    anchors = saved(rows.where(is_anchor))
    pair, best = "id bigint, vec_id bigint, score bigint", Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    want = lambda ask: Positives(ask["label"], positives, -math.inf if ask["floor"] is None else ask["floor"])
    answer = lambda i, w: [(i, x, s) for x, s in zip(w.best.ids.tolist(), w.best.scores.tolist())]
    none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>")
    own = anchors.select("*", F.col("block").alias("home"), F.lit(None).cast("double").alias("floor"), none.alias("targets")).drop("i", "j")
    near = saved(searched(own, rows, index, want, answer, pair))
    floors = near.groupBy("id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    floors = floors.select("id", F.when(F.col("n") >= positives, F.col("least")).cast("double").alias("floor"))
    further = asked(anchors.join(floors, "id", "left").withColumn("targets", none), index, False)
    found = near.unionByName(searched(further, rows, index, want, answer, pair))
    chosen = saved(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives)
                   .groupBy("id").agg(F.collect_list(F.struct(F.col("vec_id").alias("id"), "score")).alias("targets")))
    # a window under a negative score is empty
    reach = F.array_min(F.filter(F.transform("targets", lambda t: t["score"]), lambda s: s >= 0)) * (low / 100.0)
    ready = anchors.join(chosen, "id").withColumn("floor", reach - 1.0).where(F.col("floor").isNotNull())
    seek = lambda ask: Negatives(ask["label"], [(t["id"], t["score"]) for t in ask["targets"]], negatives, low, high)
    tell = lambda i, w: [(i, p, s, x, n) for p, s, b in w.windows for x, n in zip(b.ids.tolist(), b.scores.tolist())]
    hard = searched(asked(ready, index, True), rows, index, seek, tell,
                    "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    w = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (hard.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
