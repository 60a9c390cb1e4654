"""Near-duplicate join of documents by n-gram Jaccard with a token-group matrix (operator 3).

A document's set holds the 64-bit hashes of its distinct word shingles. Documents of equal sets
are one *set* from then on, named by 128 bits of hash, so copies cost one row.

1. Partition. Sets with the same smallest hash, under two independent hash functions, are
   compared with one another (large ones in blocks, each with the same leader); linked sets
   form a group. This only has to be good, not complete.
2. Token-group matrix. Every group is stored with the tokens of its members: the prefix tokens
   as rows (token, group), the union of all tokens as a bitmap of hashed columns. By the prefix
   rule two linked sets share a token among the first n - ceil(s * n) + 1 of each in one common
   order; the order puts tokens that are frequent last, which keeps the rows of a token few.
3. Bound and open. For two groups that share a prefix token, the members of the smaller one are
   queries against the other: a query's size less the tokens that the group's bitmap lacks bounds
   the overlap. The union of a large group fills its bitmap, so a query that it lets pass goes on to
   the unions of its *bounds* (at most ``BOUND`` members each), and only members of a bound that lets
   it pass are queries against the query's own bound. What can reach the threshold is opened and
   compared set by set.

So no link is lost, whatever step 1 and the frequency estimate do; they only save work. Tokens
in very many groups are compared in blocks by bitmaps, never as rows of pairs. Links are joined
to components by contraction (``components.connected``).

Rules: A-Z is lower-cased; words are runs of characters that are not ASCII white space; a text
of fewer words than a shingle is one shingle; without words the set is empty and linked with
nothing, and the component is the document's own id; rows with equal sets are linked, repeated
rows and null ids too (a null id never names a component); other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from brieflane.llm.common import chunks, saved
from brieflane.llm.components import connected

SLICE_BYTES = 512 << 10
BITS = 4096              # columns of a bitmap
FREQUENT = 1 << 18       # at most so many tokens are ordered last (broadcast: 2 MB)
FREQUENT_FROM = 4        # ... those counted so often
COUNTED_TOKENS = 1 << 20  # a task counts tokens in blocks of so many
BLOCK = 512              # sets compared at once
LIGHT = 24               # groups of a token up to which pairs of groups become rows
BOUND = 64               # members whose union is one bitmap in the second look at a large group
LOT_ROWS = 4096          # rows of a task's cells, about
BROADCAST_ROWS = 500_000  # text hashes (8 bytes each) that are broadcast at most

M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x2545F4914F6CDD1D)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finalizer that spreads 64-bit values."""
    x = x + np.uint64(int(M3) * (salt + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Shingle sets of the texts of an Arrow column."""

    def __init__(self, words: int):
        self.k, self.size = words, 0
        self.factors = [int(f) for f in mixed(np.arange(1, words + 1, dtype=np.uint64), 7) | np.uint64(1)]

    def _powers(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, SLICE_BYTES + 1)
            self.up = np.ones(self.size, np.uint64)
            self.up[1:] = BASE
            self.up = np.cumprod(self.up, dtype=np.uint64)
            self.down = np.ones(self.size, np.uint64)
            self.down[1:] = INVERSE
            self.down = np.cumprod(self.down, dtype=np.uint64)

    def sets(self, column: pa.Array) -> list[np.ndarray]:
        """For each text the sorted distinct hashes of its shingles."""
        column = pa.compute.fill_null(column.cast(pa.large_string()), "")
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        data = column.buffers()[2]
        text = LOWER[np.frombuffer(data, np.uint8)[ends[0]:ends[-1]]] if data is not None else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        n = len(text)
        empty = np.zeros(0, np.uint64)
        if not n:
            return [empty] * len(column)
        self._powers(n + 1)
        inside = ~SPACE[text]
        first = np.zeros(n + 1, bool)
        first[ends[:-1]] = True  # a text begins (or, empty, the next one does)
        begin = inside & np.r_[True, ~inside[:-1] | first[1:-1]]
        stop = inside & np.r_[~inside[1:] | first[1:-1], True]
        s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[text] * self.up[:n], dtype=np.uint64, out=total[1:])
        word = mixed((total[e] - total[s]) * self.down[s] + (e - s).astype(np.uint64) * M1)
        at = np.searchsorted(s, ends)  # words of text i: at[i] .. at[i + 1]
        k, out = self.k, []
        grams = empty
        if len(word) >= k:
            grams = np.zeros(len(word) - k + 1, np.uint64)
            for j, f in enumerate(self.factors):
                grams += word[j:len(word) - k + 1 + j] * np.uint64(f)
            grams = mixed(grams, 1)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= k:
                h = np.sort(grams[a:b - k + 1])
                out.append(h[np.r_[True, h[1:] != h[:-1]]])
            elif b > a:
                f = np.array(self.factors[:b - a], np.uint64)
                out.append(mixed(np.array([(word[a:b] * f).sum() + np.uint64(b - a)], np.uint64), 2))
            else:
                out.append(empty)
        return out


def name_of(h: np.ndarray) -> bytes:
    return np.array([mixed(h, 11).sum(), mixed(h, 12).sum() + np.uint64(len(h))], np.uint64).tobytes()


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of n shares at least with a linked one."""
    return -(-percent * n // 100)


def bitmap(h: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, np.uint8)
    bits[(mixed(h, 21) >> np.uint64(52)).astype(np.int64) % BITS] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix of links among some sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        inter = np.zeros((2, 2), np.int64)
        inter[0, 1] = inter[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        tokens, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row, col = np.repeat(np.arange(len(sets)), sizes), np.cumsum(n > 1) - 1
        keep = n[at] > 1
        row, at = row[keep], col[at[keep]]
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        inter = np.zeros((len(sets), len(sets)), np.float64)
        for c in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
            a, b = np.searchsorted(at, [c, c + 4096])
            m = np.zeros((len(sets), 4096), np.float32)
            m[row[a:b], at[a:b] - c] = 1
            inter += m @ m.T
        inter = inter.astype(np.int64)
    out = 100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)
    np.fill_diagonal(out, True)
    return out


def stars(link: np.ndarray) -> list[tuple[int, int]]:
    """Edges (smallest, member) of the components of a link matrix."""
    label = np.arange(len(link))
    while True:
        new = np.where(link, label[None, :], len(link)).min(1)
        if (new == label).all():
            return [(int(x), i) for i, x in enumerate(label) if x != i]
        label = new


def scan(docs: DataFrame, words: int) -> DataFrame:
    """One pass over the texts: rows of kind 0 (id, th, node, n, m1, m2) for every document,
    rows of kind 1 (token, times) for tokens that a block of documents holds more than once."""
    kind = docs.schema["id"].dataType.simpleString()
    ddl = f"kind int, id {kind}, th bigint, node binary, n int, m1 bigint, m2 bigint, token bigint, times int"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def frequent(held: list[np.ndarray]):
        token, times = np.unique(np.concatenate(held), return_counts=True)
        token, times = token[times > 1], times[times > 1]
        cols = [pa.array(np.ones(len(token), np.int32))] + [pa.nulls(len(token), schema.field(i).type) for i in range(1, 7)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(token.view(np.int64)), pa.array(times.astype(np.int32))], schema=schema)

    def run(batches):
        shingles, held, n_held = Shingles(words), [], 0
        for batch in batches:
            for part in chunks(batch, 1, SLICE_BYTES):
                sets = shingles.sets(part.column(1))
                some = [h if len(h) else None for h in sets]
                low = lambda salt: [None if h is None else int(mixed(h, salt).min().view(np.int64)) for h in some]
                n = len(sets)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.zeros(n, np.int32)), part.column(0), part.column(2),
                    pa.array([name_of(h) for h in sets], pa.binary()), pa.array([len(h) for h in sets], pa.int32()),
                    pa.array(low(31), pa.int64()), pa.array(low(32), pa.int64()), pa.nulls(n, pa.int64()),
                    pa.nulls(n, pa.int32())], schema=schema)
                held += sets
                n_held += sum(map(len, sets))
                if n_held > COUNTED_TOKENS:
                    yield frequent(held)
                    held, n_held = [], 0
        if held:
            yield frequent(held)

    return docs.select("id", "text", "th").mapInArrow(run, ddl)


def prefixes(docs: DataFrame, words: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(node, prefix) for every document with a set."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        shingles, last = Shingles(words), shared.value

        def first(h: np.ndarray) -> np.ndarray:
            need = len(h) - least_overlap(len(h), percent) + 1
            if len(last):
                late = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h
                h = np.concatenate([h[~late], h[late]])
            return h[:need]

        for batch in batches:
            for part in chunks(batch, 0, SLICE_BYTES):
                sets = [h for h in shingles.sets(part.column(0)) if len(h)]
                heads = [first(h) for h in sets]
                flat = np.concatenate([*heads, np.zeros(0, np.uint64)]).view(np.int64)
                ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([name_of(h) for h in sets], pa.binary()),
                                                  pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                                                 names=["node", "prefix"])

    return docs.select("text").mapInArrow(run, "node binary, prefix array<bigint>")


def sets_of(docs: DataFrame, nodes: DataFrame, words: int, bits: bool = False) -> DataFrame:
    """(node, tokens) or, with ``bits``, (node, bits) for ``nodes`` (node, rep, th), from the text
    of one document of each."""
    wanted = nodes.select(F.col("rep"), F.col("th").alias("th_of")).distinct()
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    some = docs.join(wanted, (docs["th"] == F.col("th_of")) & docs["id"].eqNullSafe(F.col("rep"))).select("id", "text")

    def run(batches):
        shingles = Shingles(words)
        for batch in batches:
            for part in chunks(batch, 1, SLICE_BYTES):
                sets = shingles.sets(part.column(1))
                if bits:
                    words_at = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (BITS // 64))
                    of_set = pa.ListArray.from_arrays(words_at, pa.array(np.concatenate([*map(bitmap, sets), np.zeros(0, np.int64)])))
                else:
                    of_set = pa.array([h.tobytes() for h in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([name_of(h) for h in sets], pa.binary()), of_set],
                                                 names=["node", "bits" if bits else "tokens"])

    return some.mapInArrow(run, "node binary, " + ("bits array<bigint>" if bits else "tokens binary"))


def in_lots(cells: DataFrame) -> DataFrame:
    """Stored cells with the ``lot`` that each belongs to: about ``LOT_ROWS`` rows are one."""
    return cells.withColumn("lot", F.pmod(F.xxhash64("cell"), F.lit(max(1024, cells.count() // LOT_ROWS))))


def compare(cells: DataFrame, percent: int) -> DataFrame:
    """``cells`` (lot, cell, label, node, tokens): edges (a, b) between the labels of linked sets
    that share a cell. Cells have a bounded number of rows; those of a lot are one task's group."""

    def run(table: pa.Table) -> pa.Table:
        edges = set()
        table = table.sort_by("cell")
        names, labels = table["cell"].to_pylist(), table["label"].to_pylist()
        nodes, tokens = table["node"].to_pylist(), table["tokens"]
        at = 0
        while at < len(names):
            to = at
            while to < len(names) and names[to] == names[at]:
                to += 1
            seen = {nodes[i]: i for i in range(at, to)}  # a set may come with several copies
            own = sorted(seen.values())
            if len(own) > 1:
                sets = [np.frombuffer(tokens[i].as_py(), np.uint64) for i in own]
                for i, j in stars(linked(sets, percent)):
                    a, b = labels[own[i]], labels[own[j]]
                    if a != b:
                        edges.add((min(a, b), max(a, b)))
            at = to
        return pa.table({"a": pa.array([x[0] for x in edges], pa.binary()), "b": pa.array([x[1] for x in edges], pa.binary())})

    return cells.groupBy("lot").applyInArrow(run, "a binary, b binary")


def partition_cells(nodes: DataFrame) -> DataFrame:
    """(cell, label, node, rep, th): sets of equal smallest hash, large ones in blocks."""
    out = None
    for r in ("m1", "m2"):
        size = nodes.groupBy(r).agg(F.count("*").alias("size"), F.min("node").alias("leader")).where(F.col("size") > 1)
        own = nodes.join(size, r)
        parts = F.ceil(F.col("size") / BLOCK)
        block = F.when(F.col("node") == F.col("leader"), F.sequence(F.lit(0).cast("bigint"), parts - 1)) \
            .otherwise(F.array(F.pmod(F.xxhash64("node"), parts)))
        own = own.select(F.lit(r).alias("round"), F.col(r).alias("low"), F.explode(block).alias("block"), "node", "rep", "th")
        out = own if out is None else out.unionByName(own)
    return out.select(F.concat_ws("/", "round", "low", "block").alias("cell"), F.col("node").alias("label"), "node", "rep", "th")


def reach(members: DataFrame, percent: int) -> DataFrame:
    """Members (…, n, bits, other_bits, other_min, other_max) whose bound of the overlap with the
    other group reaches what a link needs."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            bits, other = (cols[c].flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("bits", "other_bits"))
            n, low, high = (cols[c].to_numpy().astype(np.int64) for c in ("n", "other_min", "other_max"))
            most = n - np.bitwise_count(bits & ~other).sum(1).astype(np.int64)
            partner = np.maximum(low, -(-percent * n // 100))
            need = -(-percent * (n + partner) // (100 + percent))
            fits = (100 * high >= percent * n) & (percent * low <= 100 * n) & (most >= need)
            yield batch.filter(pa.array(fits))

    return members.mapInArrow(run, members.schema)


def heavy_pairs(rows: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of groups that share a token of very many groups, bounded in blocks by the
    bitmaps; rows: (token, grp, groups_of)."""
    parts = F.ceil(F.col("groups_of") / BLOCK)
    own = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("grp"), F.col("parts")))
    own = own.select("token", "grp", "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("q"))
    own = own.select("token", F.least("part", "q").alias("i"), F.greatest("part", "q").alias("j"), "part", "grp") \
        .join(groups.withColumnRenamed("grp", "g"), F.col("grp") == F.col("g")).drop("g")

    def run(table: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        n = table.num_rows
        bits = table["union"].combine_chunks().flatten().to_numpy().reshape(n, -1)
        low, high, size = (table[c].to_numpy().astype(np.int64) for c in ("low", "high", "size"))
        part, grp = table["part"].to_numpy(), table["grp"].to_pylist()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        for x in range(n):
            if part[x] != i:
                continue
            y = np.flatnonzero((part == j) & (np.arange(n) > x if i == j else True))
            y = y[(100 * high[y] >= percent * low[x]) & (percent * low[y] <= 100 * high[x])]
            if size[x] == 1:  # the group is one set: its own bound
                y = y[low[x] - np.bitwise_count(bits[x] & ~bits[y]).sum(1) >= least_overlap(int(low[x]), percent)]
            if len(y):  # and that of the single ones against this group
                bound = low[y] - np.bitwise_count(bits[y] & ~bits[x]).sum(1)
                y = y[(size[y] > 1) | (100 * bound >= percent * low[y])]
            out_a += [min(grp[x], grp[k]) for k in y]
            out_b += [max(grp[x], grp[k]) for k in y]
        return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})

    return own.groupBy("token", "i", "j").applyInArrow(run, "a binary, b binary")


def shared_only(rows: DataFrame) -> DataFrame:
    """Rows (token, ...), dealt by token, of tokens with several rows, with their number ``times``."""
    common = rows.groupBy("token").agg(F.count("*").alias("times")).where(F.col("times") > 1)
    return rows.join(common.hint("shuffle_hash"), "token")


def components_of(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, text_hash, component) for every row of ``docs``;
    ``component`` names it also where no id does (null without words)."""
    words = shingle_words
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                      F.xxhash64(F.col(text_col).cast("string")).alias("th"))
    found = saved(scan(own, words))
    each = found.where(F.col("kind") == 0)
    nodes = each.where(F.col("n") > 0).groupBy("node").agg(
        F.min("id").alias("rep"), F.min("n").alias("n"), F.min("m1").alias("m1"), F.min("m2").alias("m2"))
    # the text of the smallest id (any of them, where it has several)
    of_rep = each.where(F.col("n") > 0).groupBy("node", "id").agg(F.min("th").alias("th"))
    nodes = saved(nodes.join(of_rep.withColumnRenamed("node", "node_of"), (F.col("node") == F.col("node_of"))
                             & F.col("rep").eqNullSafe(F.col("id"))).select("node", "rep", "n", "m1", "m2", "th"))

    # 1. groups
    cells = saved(partition_cells(nodes))
    held = in_lots(cells).join(sets_of(own, cells, words), "node").select("lot", "cell", "label", "node", "tokens")
    grouped = connected(compare(held, percent))
    nodes = saved(nodes.join(grouped, "node", "left").select("node", "rep", "n", "th", F.coalesce("label", "node").alias("grp")))

    # 2. the matrix
    often = (found.where(F.col("kind") == 1).groupBy("token").agg(F.sum("times").alias("times"))
             .where(F.col("times") >= FREQUENT_FROM).orderBy(F.desc("times"), "token").limit(FREQUENT).select("token").collect())
    last = np.sort(np.array([r[0] for r in often], np.int64).view(np.uint64))
    # sets and groups go by 64 bits of their names here; the names come back with the sizes
    rows = prefixes(own, words, percent, last).select(F.explode("prefix").alias("token"), F.xxhash64("node").alias("n8"))
    rows = rows.repartition("token").distinct()
    rows = shared_only(rows)
    sized = nodes.groupBy("grp").agg(F.count("*").alias("size"), F.min("n").alias("low"), F.max("n").alias("high"))
    places = nodes.join(sized, "grp").select(F.xxhash64("node").alias("n8"), "grp", "low", "high")
    rows = rows.select("token", "n8").join(places, "n8").select("token", "grp", "low", "high")
    rows = saved(shared_only(rows.repartition("token").distinct()))
    a, b = (rows.where(F.col("times") <= LIGHT).select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("grp", "low", "high")])
            for x in ("a", "b"))
    pairs = a.join(b, "token").where(
        (F.col("grp_a") < F.col("grp_b")) & (100 * F.col("high_a") >= percent * F.col("low_b"))
        & (100 * F.col("high_b") >= percent * F.col("low_a"))).select(F.col("grp_a").alias("a"), F.col("grp_b").alias("b"))
    pairs = saved(pairs.distinct())
    crowded = rows.where(F.col("times") > LIGHT).select("token", "grp", F.col("times").alias("groups_of"))

    # the union of a group's tokens: bitmaps, combined word by word
    asked = pairs.select(F.col("a").alias("grp")).union(pairs.select("b")).union(crowded.select("grp")).distinct()
    asked = nodes.join(asked, "grp", "left_semi")
    heads = sets_of(own, asked, words, bits=True).join(asked.select("node", "grp", "n"), "node").join(sized.select("grp", "size"), "grp")
    bound = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BOUND)).cast("int")
    heads = saved(heads.select("node", "grp", "n", "bits", "size", bound.alias("bound")))

    def union_of(parts: DataFrame, keys: list[str]) -> DataFrame:
        each = parts.select(*keys, F.posexplode("bits").alias("at", "word")).groupBy(*keys, "at").agg(F.bit_or("word").alias("word"))
        return (each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
                .select(*keys, F.transform("words", lambda w: w["word"]).alias("bits")))

    several = heads.where(F.col("size") > 1)
    spans = several.groupBy("grp", "bound").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    bounds = saved(heads.where(F.col("size") == 1).select("grp", "bound", "bits", F.col("n").alias("low"), F.col("n").alias("high"))
                   .unionByName(union_of(several, ["grp", "bound"]).join(spans, ["grp", "bound"])))
    whole = bounds.join(sized.where(F.col("size") <= BOUND).select("grp"), "grp", "left_semi").select("grp", "bits")
    large = union_of(bounds.join(sized.where(F.col("size") > BOUND).select("grp"), "grp", "left_semi").select("grp", "bits"), ["grp"])
    groups = saved(whole.unionByName(large)).withColumnRenamed("bits", "union").join(sized, "grp").select("grp", "union", "size", "low", "high")
    pairs = pairs.unionByName(heavy_pairs(crowded, groups, percent)).distinct()

    # 3. bound and open
    # the members of the smaller group ask the larger one, then its bounds; the members of a bound that
    # lets one pass ask that one's own bound
    of = lambda x: sized.select(F.col("grp").alias(x), F.col("size").alias(f"size_{x}"))
    pairs = pairs.join(of("a"), "a").join(of("b"), "b")
    a_first = F.col("size_a") <= F.col("size_b")
    pairs = pairs.select("a", "b", F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("grp"),
                         F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("other"))
    others = groups.select(F.col("grp").alias("other"), F.col("union").alias("other_bits"), F.col("low").alias("other_min"),
                           F.col("high").alias("other_max"))
    bound_of = bounds.select(F.col("grp").alias("other"), F.col("bound").alias("other_bound"), F.col("bits").alias("other_bits"),
                             F.col("low").alias("other_min"), F.col("high").alias("other_max"))
    members, facing = heads.select("grp", "bound", "node", "n", "bits"), ["other_bits", "other_min", "other_max"]
    one = pairs.join(others, "other").join(members, "grp").select("a", "b", "grp", "bound", "node", "n", "bits", "other", *facing)
    one = saved(reach(one, percent).drop(*facing))
    one = one.join(bound_of, "other").select("a", "b", "grp", "bound", "node", "n", "bits", "other", "other_bound", *facing)
    one = saved(reach(one, percent).select("a", "b", "grp", "bound", "node", "other", "other_bound"))
    two = one.select("a", "b", F.col("other").alias("grp"), F.col("other_bound").alias("bound"), F.col("grp").alias("other"),
                     F.col("bound").alias("other_bound")).distinct()
    two = two.join(bound_of, ["other", "other_bound"]).join(members, ["grp", "bound"]).select("a", "b", "grp", "node", "n", "bits", *facing)
    two = reach(two, percent).select("a", "b", "grp", "node")
    queries = saved(one.select("a", "b", "grp", "node").unionByName(two).distinct())
    counts = queries.groupBy("a", "b").agg(F.count_if(F.col("grp") == F.col("a")).alias("n_a"),
                                           F.count_if(F.col("grp") == F.col("b")).alias("n_b"))
    counts = counts.where((F.col("n_a") > 0) & (F.col("n_b") > 0))
    parts_a, parts_b = F.ceil(F.col("n_a") * 2 / BLOCK), F.ceil(F.col("n_b") * 2 / BLOCK)
    of_a = F.col("grp") == F.col("a")
    open_ = queries.join(counts, ["a", "b"]).withColumn(
        "part", F.pmod(F.xxhash64("node"), F.when(of_a, parts_a).otherwise(parts_b))).withColumn(
        "facing", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(of_a, parts_b).otherwise(parts_a) - 1)))
    open_ = open_.select(
        F.concat_ws("/", F.hex("a"), F.hex("b"), F.when(of_a, F.col("part")).otherwise(F.col("facing")),
                    F.when(of_a, F.col("facing")).otherwise(F.col("part"))).alias("cell"), F.col("grp").alias("label"), "node")
    open_ = saved(open_)
    needed = nodes.join(open_.select("node").distinct(), "node", "left_semi")
    held = in_lots(open_).join(sets_of(own, needed, words), "node").select("lot", "cell", "label", "node", "tokens")
    merged = connected(compare(held, percent)).select(F.col("node").alias("grp"), F.col("label").alias("top"))

    comps = nodes.join(merged, "grp", "left").select("node", "rep", F.coalesce("top", "grp").alias("top"))
    least = comps.groupBy("top").agg(F.min("rep").alias("component_id"))
    ids = comps.join(least, "top").select(F.col("node").alias("node_of"), "component_id", F.col("top").alias("component"))
    out = each.join(ids, F.col("node") == F.col("node_of"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
                      F.col("th").alias("text_hash"), "component")


def one_of_each(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, unchanged: of every component one row with the smallest id, and all rows
    without words."""
    found = components_of(docs, shingle_words, percent, id_col, text_col).where(F.col("component").isNotNull())
    kept = found.groupBy("component").agg(F.min(F.struct(
        F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("text_hash").alias("th"))).alias("one"))
    kept = kept.select(F.col("one.id").alias("id_kept"), F.col("one.th").alias("th_kept"))
    th = F.xxhash64(F.col(text_col).cast("string"))
    has_words = F.coalesce(F.col(text_col).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), th.alias("th"), has_words.alias("words"))
    rest = own.where(~F.col("words")).select("row.*")
    # equal rows meet here: one of them
    some = own.where("words").join(kept, F.col("id").eqNullSafe(F.col("id_kept")) & (F.col("th") == F.col("th_kept")))
    w = Window.partitionBy("id", "th").orderBy(F.xxhash64("row"))
    some = some.withColumn("place", F.row_number().over(w)).where(F.col("place") == 1).select("row.*")
    return some.unionByName(rest)
