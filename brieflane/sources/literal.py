"""Small literal dimension tables as inline SQL tables.

``spark.createDataFrame(list)`` gives an RDD scan with no size statistics, so the
optimizer cannot tell it is tiny and may broadcast the *other* side. An inline VALUES
table is a LocalRelation with an exact size, so the broadcast size check picks it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _lit(v, dtype: str) -> str:
    if v is None:
        return f"CAST(NULL AS {dtype})"
    if isinstance(v, (list, tuple)):
        inner = dtype[len("array<"):-1]
        if not v:
            return f"CAST(array() AS {dtype})"
        return "array(" + ", ".join(_lit(x, inner) for x in v) + ")"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return f"CAST({v!r} AS {dtype})"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def values_table(spark: SparkSession, rows: list[tuple], columns: list[tuple[str, str]]) -> DataFrame:
    """Rows of Python values -> DataFrame with the given (name, sql type) columns."""
    names = [n for n, _ in columns]
    body = ", ".join("(" + ", ".join(_lit(v, t) for v, (_, t) in zip(r, columns)) + ")" for r in rows)
    df = spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")
    return df.select(*[df[n].cast(t).alias(n) for n, t in columns])
