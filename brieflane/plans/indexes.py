"""Word indexes of the landed fixture tables, one for each application and table folder.

They are built by the first query that needs them and read by the later ones, as a landing's index
would be; days that landed since are added.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brieflane.operators.word_index import WordIndex
from brieflane.plans import api
from brieflane.session import ensure_checkpoint_dir
from brieflane.sources import fixtures as fx
from brieflane.sources import ingest


def folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    key = hashlib.md5(sf_dir.encode()).hexdigest()
    return f"{ensure_checkpoint_dir(spark)}/brieflane-index-{spark.sparkContext.applicationId}-{key}/{name}"


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.articles_good(ingest.typed_articles(fx.article_responses(spark, sf_dir)))


def of_articles(spark: SparkSession, sf_dir: str, where: str | None = None) -> WordIndex:
    """Words of title and description."""
    index = WordIndex(spark, where or folder(spark, sf_dir, "articles"), "bigint")
    index.add(articles(spark, sf_dir), "article_id", api.news_text(), F.to_date("publishedAt"))
    return index


def of_posts(spark: SparkSession, sf_dir: str, where: str | None = None) -> WordIndex:
    """Words of titles, in lower case."""
    index = WordIndex(spark, where or folder(spark, sf_dir, "posts"), "string")
    index.add(fx.posts(spark, sf_dir), "id", F.lower("title"), F.to_date("created_utc"))
    return index
