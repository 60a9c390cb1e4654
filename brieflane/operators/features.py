"""TF-IDF vectors by a stored model.

The vector form of the long table: a model is fitted once and stored, and any texts, seen or not,
are turned into sparse vectors by joining their term counts to it. Nothing of the vocabulary passes
through the driver.

- ``terms``: (term, index, doc_freq, idf); the index is CountVectorizer's (terms by corpus count,
  then by name), from the distributed ranking of ``text.vocabulary``;
- ``size``: one row (n_docs, n_terms), written last: a folder without it holds no model.

A vector is (indices, values) in rising order of index, as Spark ML's sparse vectors are. Terms the
model has not seen have no index and are left out, as Spark ML does it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brieflane.operators import text as tx
from brieflane.session import intermediate, names_in

TERMS = "term string, index bigint, doc_freq bigint, idf double"
SIZE = "n_docs bigint, n_terms bigint"


def fit(docs: DataFrame, id_col: str, text_col: str, folder: str) -> FeatureModel:
    """Learns vocabulary and IDF from a table of texts and stores them in ``folder``."""
    spark = docs.sparkSession
    n_docs = docs.agg(F.count("*")).scalar()
    ranked = tx.vocabulary(docs, id_col, text_col)
    terms = ranked.select("term", (F.col("rank") - 1).alias("index"), "doc_freq", tx.idf_column(n_docs, F.col("doc_freq")).alias("idf"))
    terms.write.mode("overwrite").parquet(f"{folder}/terms")
    written = spark.read.schema(TERMS).parquet(f"{folder}/terms")
    written.agg(F.count("*").alias("n_terms")).select(n_docs.alias("n_docs"), "n_terms").write.mode("overwrite").parquet(f"{folder}/size")
    return FeatureModel(spark, folder)


class FeatureModel:
    """A stored model."""

    def __init__(self, spark: SparkSession, folder: str):
        if "size" not in names_in(spark, folder):
            raise ValueError(f"no model in {folder}")
        self.spark, self.folder = spark, folder
        self.n_docs, self.n_terms = spark.read.schema(SIZE).parquet(f"{folder}/size").first()

    def terms(self) -> DataFrame:
        return self.spark.read.schema(TERMS).parquet(f"{self.folder}/terms")

    @staticmethod
    def _pairs(joined: DataFrame) -> DataFrame:
        """(doc_id, p): one text's distinct terms meet in one row."""
        pair = F.struct("index", (F.col("tf") * F.col("idf")).alias("weight"))
        return joined.groupBy("doc_id").agg(F.collect_list(pair).alias("p"))

    def vectors(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, indices, values) for every row of ``docs``, whose ids are unique. The vocabulary grows with
        the corpus: its ``HEAD_TERMS`` most frequent terms are broadcast, and only the counts of the others
        move to their terms by sort-merge, and back to their texts."""
        counts = tx.counts_by_doc(docs, id_col, text_col)
        head = self.terms().where(F.col("index") < tx.HEAD_TERMS)
        near = self._pairs(counts.join(F.broadcast(head), "term"))  # the counts stay where they are
        out = docs.select(F.col(id_col).alias("doc_id")).join(near.hint("merge"), "doc_id", "left")
        if self.n_terms > tx.HEAD_TERMS:
            tail = self.terms().where(F.col("index") >= tx.HEAD_TERMS)
            rare = counts.join(F.broadcast(head.select("term")), "term", "left_anti")
            far = self._pairs(rare.join(tail.hint("merge"), "term")).withColumnRenamed("p", "q")
            none = F.array().cast("array<struct<index:bigint,weight:double>>")
            out = out.join(far.hint("merge"), "doc_id", "left")
            out = out.select("doc_id", F.concat(F.coalesce("p", none), F.coalesce("q", none)).alias("p"))
        out = out.select("doc_id", F.array_sort("p").alias("p"))
        none_i, none_v = F.array().cast("array<bigint>"), F.array().cast("array<double>")
        return out.select(F.col("doc_id").alias(id_col), F.coalesce(F.col("p.index"), none_i).alias("indices"),
                          F.coalesce(F.col("p.weight"), none_v).alias("values"))

    def ml_vectors(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, features) with Spark ML vectors, for its estimators: the arrays are written in the form
        in which Parquet holds such vectors, and read as them. A vector holds 2^31 - 1 terms at most."""
        from pyspark.ml.linalg import VectorUDT

        if self.n_terms >= 1 << 31:
            raise ValueError(f"{self.n_terms} terms are more than a Spark ML vector holds")
        sparse = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(self.n_terms).cast("int").alias("size"),
                          F.col("indices").cast("array<int>").alias("indices"), F.col("values"))
        path = intermediate(self.spark, "vectors")
        kind = docs.schema[id_col].dataType
        self.vectors(docs, id_col, text_col).select(id_col, sparse.alias("features")).write.parquet(path)
        return self.spark.read.schema(T.StructType([T.StructField(id_col, kind), T.StructField("features", VectorUDT())])).parquet(path)


def summary(vectors: DataFrame, id_col: str, n_terms: int) -> DataFrame:
    """What a vector holds, as numbers: size, non-zeros, first, last and sum of the indices, sum and
    length of the weights."""
    total = lambda c, zero: F.aggregate(c, zero, lambda a, x: a + x)
    square = F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x)
    return vectors.select(
        F.col(id_col).alias("doc_id"), F.lit(n_terms).cast("bigint").alias("size"), F.size("indices").alias("n_terms"),
        F.try_element_at("indices", F.lit(1)).alias("first_index"), F.try_element_at("indices", F.lit(-1)).alias("last_index"),
        total("indices", F.lit(0).cast("bigint")).alias("index_sum"), F.round(total("values", F.lit(0.0)), 4).alias("weight_sum"),
        F.round(F.sqrt(square), 4).alias("length"))
