"""Mixing sources to target weights by Pfair scheduling (operator 7, DataFrame functions only).

The documents of a source, in the order of a hash of their ids, form blocks of ``block_docs``.
Weights are whole units, ``period`` in all. Block j (from 0) of a source with u units may not
come before slot floor(j * period / u), its release, and must come before slot
ceil((j + 1) * period / u), its deadline. In every slot the released block with the earliest
deadline is taken. So after any number of slots each source has had its share of them to less
than one block. The schedule repeats after one period, so only that is computed, as an
aggregate over the slots; block j of a source has the slot of block j mod u, j div u periods
later. A source that runs out leaves its further slots empty.

Ranks within a source are computed without gathering it: its documents are dealt by ranges of
the hash into buckets of bounded size, ranked there, and moved up by the sizes of the buckets
before.

Rules: null sources are a source of their own; without given weights a source counts with the
square root of its size; sources missing among given weights get the smallest weight; ties of
the hash go by id, then by a hash of the row; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_DOCS, PERIOD, BUCKET_DOCS = 16, 1000, 20_000
NO_SOURCE = "\x00null"


def shares(sizes: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """(src, n, units, period): units of each source, one at least, ``period`` together."""
    if weights is None:
        raw = F.floor(F.sqrt("n") * 1000)
    else:
        least = int(min(weights.values()) * 1_000_000) or 1
        raw = F.coalesce(*[F.when(F.col("src") == k, F.lit(int(v * 1_000_000))) for k, v in weights.items()], F.lit(least))
    every = Window.partitionBy(F.lit(0))
    s = sizes.withColumn("raw", F.greatest(raw.cast("bigint"), F.lit(1).cast("bigint")))
    s = s.withColumn("period", F.greatest(F.lit(PERIOD), F.count("*").over(every) * 10).cast("bigint"))
    s = s.withColumn("free", F.col("period") - F.count("*").over(every)).withColumn("total", F.sum("raw").over(every))
    s = s.withColumn("whole", F.expr("free * raw div total")).withColumn("rest", F.expr("free * raw % total"))
    s = s.withColumn("left", F.col("free") - F.sum("whole").over(every))
    by_rest = Window.partitionBy(F.lit(0)).orderBy(F.desc("rest"), "src")
    extra = (F.row_number().over(by_rest) <= F.col("left")).cast("bigint")
    return s.select("src", "n", (1 + F.col("whole") + extra).alias("units"), "period")


def schedule(units: DataFrame) -> DataFrame:
    """(src, turn, slot): one period; ``turn`` numbers the blocks of a source in it."""
    one = units.agg(F.sort_array(F.collect_list(F.struct("src", "units"))).alias("s"), F.max("period").alias("period"))
    u = lambda i: F.get(F.col("s"), i)["units"]

    def div(a: Column, b: Column) -> Column:
        return F.floor(a / b)  # exact: both are far below 2^53 / period

    def pick(acc: Column, slot: Column) -> Column:
        ready = F.filter(F.transform(acc["had"], lambda had, i: F.struct(
            div((had + 1) * F.col("period") + u(i) - 1, u(i)).alias("deadline"), (-u(i)).alias("by"), i.alias("i"),
            div(had * F.col("period"), u(i)).alias("release"))), lambda x: x["release"] <= slot)
        return F.get(F.transform(F.array(F.array_min(ready)), lambda best: F.struct(
            F.transform(acc["had"], lambda had, i: had + (i == best["i"]).cast("bigint")).alias("had"),
            F.concat(acc["order"], F.array(best["i"])).alias("order"))), F.lit(0))

    start = F.struct(F.transform("s", lambda x: F.lit(0).cast("bigint")).alias("had"),
                     F.expr("cast(array() as array<int>)").alias("order"))
    order = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.col("period") - 1), start, pick)["order"]
    slots = one.where(F.size("s") > 0).select("s", F.posexplode(order).alias("slot", "i"))
    slots = slots.select(F.get(F.col("s"), F.col("i"))["src"].alias("src"), F.col("slot").cast("bigint").alias("slot"))
    return slots.withColumn("turn", (F.row_number().over(Window.partitionBy("src").orderBy("slot")) - 1).cast("bigint"))


def _own(docs: DataFrame, source_col: str, *more: Column) -> DataFrame:
    return docs.select(F.struct("*").alias("row"), F.coalesce(F.col(source_col), F.lit(NO_SOURCE)).alias("src"), *more)


def _units(own: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    return shares(own.groupBy("src").agg(F.count("*").alias("n")), weights)


def _ranked(own: DataFrame, bucket: str, *order: str | Column) -> DataFrame:
    """``rank`` of each row within its source: by ``bucket``, and by ``order`` within one. The rank in
    the bucket moves up by the sizes of the buckets before."""
    before = Window.partitionBy("src").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (own.groupBy("src", bucket).agg(F.count("*").alias("here"))
               .select("src", bucket, F.coalesce(F.sum("here").over(before), F.lit(0)).alias("offset")))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("src", bucket).orderBy(*order)))
    return ranked.join(offsets, ["src", bucket]).withColumn("rank", F.col("offset") + F.col("rank") - 1)


def _placed(ranked: DataFrame, units: DataFrame, block_docs: int) -> DataFrame:
    """(row, block, slot, place) of ranked rows, by the schedule. ``units`` and the schedule are bounded
    by the number of sources (ten slots for each, or PERIOD)."""
    ranked = ranked.join(F.broadcast(units.drop("n")), "src")
    ranked = ranked.withColumn("block", F.expr(f"rank div {int(block_docs)}")).withColumn("turn", F.col("block") % F.col("units"))
    placed = ranked.join(F.broadcast(schedule(units)), ["src", "turn"])
    return placed.select("row", "block", (F.expr("block div units") * F.col("period") + F.col("slot")).alias("slot"),
                         (F.col("rank") % block_docs).cast("int").alias("place"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source",
        block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(row: struct of all columns of ``docs``, block, slot, place): the block of the document
    within its source, the slot of the block in the mix, the document's place in its block."""
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    own = _own(docs, source_col, F.col(id_col).alias("id"), key.alias("hash"))
    units = _units(own, weights)
    high = F.conv(F.substring("hash", 1, 8), 16, 10).cast("bigint")
    own = own.join(F.broadcast(units.select("src", "n")), "src")
    own = own.withColumn("bucket", F.shiftright(high * F.ceil(F.col("n") / BUCKET_DOCS), 32))
    return _placed(_ranked(own, "bucket", "hash", "id", F.xxhash64("row")), units, block_docs)


def stored_mix(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source",
               block_docs: int = BLOCK_DOCS) -> DataFrame:
    """As ``mix``, for the Parquet files that were written from ``in_mix_order`` with the same weights:
    the order of a source's documents is that of their rows in the files, whatever put them there."""
    name, at = F.col("_metadata.file_name"), F.col("_metadata.row_index").alias("at")
    part = F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("bigint")  # wider than its zeros from 100000 on
    own = _own(docs, source_col, F.struct(part.alias("part"), name.alias("name")).alias("file"), at)
    return _placed(_ranked(own, "file", "at"), _units(own, weights), block_docs)


def in_mix_order(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id",
                 source_col: str = "source") -> DataFrame:
    """Rows of ``docs``, unchanged, sorted by slot: partition by partition, the files that are
    written from it hold the mix in order."""
    mixed = mix(docs, weights, id_col, source_col)
    return mixed.repartitionByRange("slot").sortWithinPartitions("slot", "place").select("row.*")
