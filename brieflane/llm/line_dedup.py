"""Line de-duplication by overlapping three-line windows (operator 2, DataFrame functions only).

The lines of a document that are not blank, trimmed of spaces, form windows of three
consecutive lines, one starting at each line. A window's identity is two 64-bit hashes of its
lines. Of each window the first occurrence, by document id and then position, stays; the lines
that later occurrences cover are merged and removed.

One row of every repeated window is aggregated (partial sums before the shuffle, so a window in
a third of all documents is one row for each task) and joined back; a hot window's join
partition is split by adaptive execution. Only positions travel; the texts are shuffled once,
to meet the positions to remove.

Rules: documents with fewer than three such lines have no window and stay as they are; blank
lines stay where they are; a null text stays null; a row with a null id neither removes nor
loses lines; equal rows count as one document, and rows that share an id but not the text are
told apart by their texts; other columns are passed on unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def filled(text: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(split_lines(text), lambda x: F.trim(x)), lambda x: x != "")


def windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, at, h1, h2): the windows of every document; ``at`` counts filled lines."""
    own = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("text_hash"),
        filled(F.col(text_col)).alias("lines")).where(F.size("lines") >= WINDOW)
    at = F.sequence(F.lit(0), F.size("lines") - WINDOW)
    some = [lambda i, k=k: F.get(F.col("lines"), i + k) for k in range(WINDOW)]
    spans = F.transform(at, lambda i: F.struct(
        i.alias("at"), F.xxhash64(*[line(i) for line in some]).alias("h1"),
        F.xxhash64(F.lit("second"), *[line(i) for line in some]).alias("h2")))
    return own.select("id", "text_hash", F.inline(spans))


def later_windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, later): positions of the windows that occurred before."""
    found = windows(docs, id_col, text_col)
    place = (F.col("id").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("at")).cast("decimal(38,0)")
    first = (found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first"))
             .where(F.col("n") > 1).select("h1", "h2", "first"))
    later = found.join(first, ["h1", "h2"]).where(place != F.col("first"))
    return later.groupBy("id", "text_hash").agg(F.collect_set("at").alias("later"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text that is left, and n_lines, n_removed (filled lines) as a last
    column ``line_dedup`` of type struct."""
    later = later_windows(docs, id_col, text_col)
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("id"),
                      F.xxhash64(text_col).alias("text_hash"))
    joined = own.join(later, ["id", "text_hash"], "left")
    text = F.col("row")[text_col]
    # lines as (line, filled); the k-th filled one is at position k - 1 of the windows
    lines = F.transform(split_lines(text), lambda x: F.struct(x.alias("line"), (F.trim(x) != "").alias("filled")))
    places = F.filter(F.transform(lines, lambda x, i: F.when(x["filled"], i)), lambda i: i.isNotNull())
    covered = F.array_distinct(F.flatten(F.transform(F.col("later"), lambda j: F.sequence(j, j + WINDOW - 1))))
    step = joined.select("row", "later", lines.alias("lines"), places.alias("places"), covered.alias("covered"))
    # index of each line to remove among all lines, as a map for constant-time lookup
    step = step.withColumn("gone", F.transform("covered", lambda k: F.get(F.col("places"), k)))
    step = step.withColumn("flags", F.map_from_arrays(F.col("gone"), F.col("gone")))
    kept = F.transform(F.filter("lines", lambda x, i: ~F.map_contains_key(F.col("flags"), i)), lambda x: x["line"])
    new_text = F.when(F.col("later").isNull(), F.col("row")[text_col]).otherwise(F.array_join(kept, "\n"))
    info = F.struct(F.coalesce(F.size("places"), F.lit(0)).alias("n_lines"),
                    F.when(F.col("later").isNull(), 0).otherwise(F.size("covered")).alias("n_removed"))
    info = F.when(F.col("row")[text_col].isNull(), F.struct(F.lit(0).alias("n_lines"), F.lit(0).alias("n_removed"))).otherwise(info)
    rest = [(new_text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns]
    return step.select(*rest, info.alias("line_dedup"))
