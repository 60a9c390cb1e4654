"""A stored index of the words of landed texts.

Substring search over landed texts splits every text into words each time. The index does it once
for each landed day:

- ``postings``: (_rid, _word), partitioned by day and by a hash of the word; one row for each text
  and bucket holds the words of that bucket between spaces, so what moves are texts, not their words;
- ``vocabulary``: the distinct words, extended by those that are new;
- ``days``: the days that are indexed, written last. A day whose indexing broke off is not among
  them and is written anew.

A search finds the words that hold a term's longest piece by their grams (the GRAM characters that
follow each place of a word, fewer at its end, made from the vocabulary as it is read) and reads the
postings of those words only; a text is read again only for terms with a space, on the rows that are
left. The words found are written to the shared folder first, so their true size decides how they are
joined, and buckets of the postings without any of them are not read. Where the pieces are few, words
that hold none of them are left out before: grams are not made of them, and if the words found are too
many to be broadcast, their postings do not move for that join.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brieflane.operators import filters
from brieflane.session import discard, intermediate, names_in, written

BUCKETS_CONF, DEFAULT_BUCKETS = "brieflane.index.buckets", 2  # raise it on large clusters
LAYOUT = "by-row"  # folder of this layout; an index of another one beside it is not read
MANY_WORDS = 400_000  # about what is broadcast by its size
FEW_PIECES = 64
SHORT_WORD = 64  # characters


def following(word: Column) -> Column:
    """Distinct runs of GRAM characters that begin at each place of a word (fewer at its end)."""
    def runs(chars: Column) -> Column:
        after = lambda i, k: F.coalesce(F.get(chars, i + k), F.lit(""))
        return F.array_distinct(F.transform(chars, lambda c, i: F.concat(c, *[after(i, k) for k in range(1, filters.GRAM)])))

    return _bound(F.filter(F.split(word, ""), lambda c: c != ""), runs)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: as a lambda's variable, not as an expression."""
    return F.get(F.transform(F.array(value), use), 0)


def holding(words: DataFrame, pieces: Sequence[str]) -> DataFrame:
    """The rows whose word holds one of the pieces; all of them, if none are given. ``instr`` is not
    handed to the Parquet reader, which would go through a dictionary once for every piece."""
    least = [p for p in pieces if not any(p != q and q in p for q in pieces)]
    return words.where(functools.reduce(Column.__or__, [F.instr("_word", p) > 0 for p in least])) if least else words


class WordIndex:
    """An index in ``folder``. ``id_type`` is the type of the row ids; ``buckets`` is fixed once a
    folder holds an index."""

    def __init__(self, spark: SparkSession, folder: str, id_type: str, buckets: int | None = None):
        self.spark, self.folder, self.id_type = spark, f"{folder}/{LAYOUT}", id_type
        self.buckets = buckets or int(spark.conf.get(BUCKETS_CONF, str(DEFAULT_BUCKETS)))

    # ------------------------------------------------------------------ tables
    def _table(self, name: str, schema: str) -> DataFrame:
        if not names_in(self.spark, f"{self.folder}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def postings(self) -> DataFrame:
        stored = self._table("postings", f"_rid {self.id_type}, _words string, day date, bucket int")
        return stored.select("_rid", F.explode(F.split("_words", " ")).alias("_word"), "day", "bucket")

    def grams(self, size: int = filters.GRAM, words: DataFrame | None = None) -> DataFrame:
        """(_gram, _word) of the vocabulary, or of the ``words`` given: the first ``size``
        characters of what follows each place. A place of a short word is counted from its start; a
        long word is gone through once."""
        words, short = words or self.vocabulary(), F.length("_word") <= SHORT_WORD
        places = words.where(short).select("_word", F.explode(F.sequence(F.lit(1), F.length("_word"))).alias("_at"))
        runs = words.where(~short).select("_word", F.explode(following(F.col("_word"))).alias("_run"))
        return places.select(F.substring("_word", F.col("_at"), F.lit(size)).alias("_gram"), "_word").unionByName(
            runs.select(F.substring("_run", 1, size).alias("_gram"), "_word"))

    def vocabulary(self) -> DataFrame:
        return self._table("vocabulary", "_word string")

    def days(self) -> set[dt.date]:
        """Indexed days: one row for each day of the landing."""
        return {r["day"] for r in self._table("days", "day date").distinct().collect()}

    def _bucket(self, c: Column | str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _dealt(self, words: Column) -> Column:
        """(bucket, _words): the words of an array by bucket, as many rows as there are buckets."""
        def deal(every: Column) -> Column:
            return _bound(F.transform(every, self._bucket), lambda of: F.transform(
                F.array(*map(F.lit, range(self.buckets))),
                lambda b: F.struct(b.alias("bucket"), F.array_join(F.filter(every, lambda w, i: F.get(of, i) == b), " ").alias("_words"))))

        return F.inline(_bound(words, deal))

    # ------------------------------------------------------------------- build
    def add(self, rows: DataFrame, row_id: str, text: Column, day: Column, again: set[dt.date] = frozenset()) -> set[dt.date]:
        """Indexes the days of ``rows`` that the index lacks, and ``again`` (days whose rows have
        changed). Returns the days that were indexed. Rows without a day count to 1970-01-01."""
        rows = rows.select(F.col(row_id), text.alias("_text"), F.coalesce(day, F.lit("1970-01-01").cast("date")).alias("day"))
        landed = {r["day"] for r in rows.select("day").distinct().collect()}
        todo = sorted((landed - self.days()) | (landed & set(again)))
        for d in again:
            discard(self.spark, f"{self.folder}/postings/day={d}")
        if not todo:
            return set()
        words = F.array_remove(F.array_distinct(F.split("_text", " ")), "")
        dealt = rows.where(F.col("day").isin(todo)).select(F.col(row_id).alias("_rid"), "day", self._dealt(words))
        (dealt.where(F.col("_words") != "").hint("rebalance", "day", "bucket").sortWithinPartitions("day", "bucket")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
         .partitionBy("day", "bucket").parquet(f"{self.folder}/postings"))
        new = self.postings().where(F.col("day").isin(todo)).select("_word").distinct()
        if names_in(self.spark, f"{self.folder}/vocabulary"):
            new = new.join(self.vocabulary(), "_word", "left_anti")
        new.write.mode("append").parquet(f"{self.folder}/vocabulary")
        self.spark.createDataFrame([(d,) for d in todo], "day date").coalesce(1).write.mode("append").parquet(f"{self.folder}/days")
        return set(todo)

    # ------------------------------------------------------------------ search
    def few_pieces(self, terms: DataFrame, term_col: str) -> list[str]:
        """The pieces of the terms, if there are at most FEW_PIECES."""
        pieces = filters.term_pieces(terms, term_col).where(F.col("_piece") != "").select("_piece").distinct()
        found = sorted(r[0] for r in pieces.limit(FEW_PIECES + 1).collect())
        return found if len(found) <= FEW_PIECES else []

    def words_of(self, terms: DataFrame, term_col: str, few: Sequence[str] = ()) -> DataFrame:
        """(_term, _word, bucket) of the words that hold a term's piece, written to the shared folder."""
        pieces = filters.term_pieces(terms, term_col).where(F.col("_piece") != "")
        words = written(holding(self.vocabulary(), few), "candidates") if few else self.vocabulary()
        parts = []
        for size in [r[0] for r in pieces.select(F.length("_gram")).distinct().collect()]:  # 1 to GRAM
            own = pieces.where(F.length("_gram") == size)
            found = self.grams(size, words).join(own, "_gram")
            parts.append(found.where(F.col("_word").contains(F.col("_piece"))).select("_term", "_word"))
        none = self.spark.createDataFrame([], "_term string, _word string")
        near = functools.reduce(DataFrame.unionByName, parts, none)
        path = intermediate(self.spark, "words")
        near.distinct().withColumn("bucket", self._bucket("_word")).write.parquet(path)
        return self.spark.read.schema("_term string, _word string, bucket int").parquet(path)

    def matches(self, df: DataFrame, text: Column, terms: DataFrame, term_col: str, row_id: str) -> DataFrame:
        """As ``filters.substring_matches``, from the postings of the texts: ``text`` must be the
        indexed one. Only rows that ``df`` holds are returned."""
        few = self.few_pieces(terms, term_col)
        near = self.words_of(terms, term_col, few)
        postings = holding(self.postings(), few) if near.count() > MANY_WORDS else self.postings()
        found = postings.join(near, ["bucket", "_word"]).select("_rid", "_term").distinct()
        # what a search does not have it does not plan for: the texts are read for these two only
        kinds = terms.where(F.col(term_col).isNotNull()).agg(F.bool_or(F.trim(term_col) == ""),
                                                            F.bool_or((F.instr(term_col, " ") > 0) & (F.trim(term_col) != ""))).first()
        spaced = F.instr("_term", " ") > 0
        hits = found.where(~spaced) if kinds[1] else found
        if kinds[1]:
            hits = hits.unionByName(df.select(F.col(row_id).alias("_rid"), text.alias("_text")).join(found.where(spaced), "_rid")
                                    .where(F.col("_text").contains(F.col("_term"))).select("_rid", "_term"))
        out = filters.rows_of_hits(df, hits, terms, term_col, row_id)
        return out.unionByName(filters.blank_matches(df, text, terms, term_col, row_id)) if kinds[0] else out
