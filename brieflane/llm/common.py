"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from brieflane.session import discard, intermediate  # noqa: F401

CHUNK_BYTES = 8 << 20

WORDS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """Runs of letters. The pattern, which is fast, takes other numerals (fractions, Roman ones) for
    letters; a text that has some is gone through again."""
    found = WORDS.findall(text)
    if not found or "".join(found).isalpha():
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split(" ") if w]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, kept if an executor is
    lost, with a short plan and true sizes for the joins that follow."""
    spark = df.sparkSession
    path = intermediate(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def share(id_col: str, rows: int, bound: int) -> Column:
    """Keeps about ``bound`` of ``rows`` rows, chosen by a hash of the id (all, if fewer)."""
    if rows <= bound:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.lit("share"), F.col(id_col)), F.lit(1 << 30)) < int((1 << 30) * bound / rows)


def chunks(batch: pa.RecordBatch, text_at: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch holding about ``most`` bytes of column ``text_at`` (one row at least)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_at)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n + 1
    if start < len(sizes):
        yield batch.slice(start)


_held: dict = {}


def held(key: tuple, make: Callable):
    """What a worker process keeps from task to task, by ``key``: the tables of one operator only, so
    that those of a pipeline's stages do not add up."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Drops what the worker process holds for another operator."""
    _held.clear()


def map_texts(df: DataFrame, schema: str, make: Callable, text_at: int = 1, most: int = CHUNK_BYTES) -> DataFrame:
    """``make()`` is called once in each task and returns a function from a slice of a batch
    (see :func:`chunks`, ``most`` bytes) to the list of output columns, in the order of ``schema``."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        work = make()
        for batch in batches:
            for part in chunks(batch, text_at, most):
                cols = [c if isinstance(c, pa.Array) else pa.array(c, arrow[i].type) for i, c in enumerate(work(part))]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return df.mapInArrow(run, schema)
