"""Text features in long form (E1–E6) and text cleaning.

Long form = one row per (document, term). It has no vocabulary cap, runs as plain
aggregates and joins, and matches Spark ML's Tokenizer -> StopWordsRemover ->
CountVectorizer -> IDF pipeline term for term (see ``ml_pipeline`` for the vector form).

Scale notes
* Tokens are exploded per document and counted with ``groupBy(doc, term)`` (partial
  aggregation); document frequency is a second partial aggregate over those counts.
* Stop words are a 181-literal ``isin``: Catalyst turns it into a hashed InSet.
* The tf ⋈ idf join is a pinned sort-merge join: the idf side grows with the
  vocabulary, so it is never broadcast on an estimate, and it is not salted (salting
  would copy the whole long tail); AQE's skew-join split handles a hot term.
* The document count m is a scalar subquery, not a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brieflane import fixed
from brieflane.operators import skew
from brieflane.session import written

WS = "[ \\t\\n\\x0B\\f\\r]"  # Java's \s: the Tokenizer's split class


def tokenize(text: Column) -> Column:
    """Tokenizer semantics — lower-case, split on single whitespace characters,
    trailing empty tokens dropped; '' -> [''], whitespace-only -> []."""
    low = F.lower(F.coalesce(text, F.lit("")))
    stripped = F.regexp_replace(low, WS + "+$", "")
    return (F.when(low == "", F.array(F.lit("")))
            .when(stripped == "", F.array().cast("array<string>"))
            .otherwise(F.split(stripped, WS, -1)))


def is_stop_word(token: Column) -> Column:
    return token.isin(fixed.ENGLISH_STOP_WORDS)


def doc_tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, pos, token) for every token of every document."""
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.posexplode(tokenize(F.col(text_col))).alias("pos", "token"))


def filtered_tokens(tokens: DataFrame) -> DataFrame:
    """Stop words removed (case-insensitive; tokens are already lower-case)."""
    return tokens.where(~is_stop_word(F.col("token")))


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, term, tf).

    The lower-cased and right-stripped texts are projected once (not re-evaluated per
    branch of the tokenizer expression); stop words are dropped after the explode by a
    codegen'd hashed ``InSet`` filter (a lambda inside ``filter()`` is interpreted)."""
    return _counted(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")))


def counts_by_doc(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """As ``term_counts``, for a reader that goes on by document or sums by term: the texts are dealt by
    id before they are split, as a text is far shorter than its (doc, term) rows. What reads it twice
    splits twice."""
    return _counted(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).repartition("doc_id"))


def _counted(texts: DataFrame) -> DataFrame:
    low = texts.select("doc_id", F.lower(F.coalesce(F.col("_text"), F.lit(""))).alias("_low"))
    low = low.select("doc_id", "_low", F.regexp_replace("_low", WS + "+$", "").alias("_stripped"))
    toks = (F.when(F.col("_low") == "", F.array(F.lit("")))
            .when(F.col("_stripped") == "", F.array().cast("array<string>"))
            .otherwise(F.split("_stripped", WS, -1)))
    words = low.select("doc_id", F.explode(toks).alias("term")).where(~is_stop_word(F.col("term")))
    return words.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def doc_freq(tf: DataFrame) -> DataFrame:
    """(term, doc_freq, total_count).

    doc_freq is written as ``count_if(tf > 0)`` (= rows, tf >= 1) so that it reads the
    counts: the optimizer then keeps the term-count aggregate intact and AQE reuses its
    shuffle for both the df branch and the tf side of the join (one tokenizing pass)."""
    return tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("doc_freq"), F.sum("tf").alias("total_count"))


def idf_column(m: Column, df: Column) -> Column:
    """E5: ln((m + 1) / (df + 1))."""
    return F.log((m + F.lit(1.0)) / (df + F.lit(1.0)))


#: Terms of a vocabulary that are broadcast, whatever its size: those that most rows hold.
HEAD_TERMS = 1 << 17


def weighted(tf: DataFrame, head: DataFrame, tail: DataFrame | None) -> DataFrame:
    """Term counts joined by term to a vocabulary in two parts: a ``head`` of ``HEAD_TERMS`` terms at
    most, which is broadcast, and the ``tail`` of any size, to which only the counts of its own terms
    move (sort-merge)."""
    near = tf.join(F.broadcast(head), "term")
    if tail is None:
        return near
    far = tf.join(F.broadcast(head.select("term")), "term", "left_anti").join(tail.hint("merge"), "term")
    return near.unionByName(far)


def idf_weights(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """E5: (term, doc_freq, idf); m counts every document, empty ones included."""
    m = docs.agg(F.count("*")).scalar()
    d = doc_freq(term_counts(docs, id_col, text_col))
    return d.select("term", "doc_freq", idf_column(m, F.col("doc_freq")).alias("idf"))


def tfidf_from_counts(tf: DataFrame, m: Column, strategy: str = "merge") -> DataFrame:
    """E6 from term counts (doc_id, term, tf) and the document count ``m``.

    The idf side has one row per vocabulary term. Vocabularies have a long tail, so it
    grows with the corpus: it is never broadcast on a size estimate (the join strategy
    is pinned, sort-merge by default, which spills), and it is not replicated for
    salting (that would copy the whole tail). A term held by a third of all documents
    makes one skewed partition on the tf side; AQE's skew-join handling splits exactly
    those partitions and copies only their slice of the idf side."""
    w = doc_freq(tf).select("term", idf_column(m, F.col("doc_freq")).alias("idf"))
    j = tf.join(w.hint(strategy), "term", "inner")
    return j.select("doc_id", "term", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tfidf"))


def tfidf(docs: DataFrame, id_col: str, text_col: str, strategy: str = "merge") -> DataFrame:
    """(doc_id, term, tf, idf, tfidf)."""
    m = docs.agg(F.count("*")).scalar()
    return tfidf_from_counts(term_counts(docs, id_col, text_col), m, strategy)


def segment_term_counts(segments: DataFrame, docs: DataFrame, salts: int | None = None) -> DataFrame:
    """E3 for documents stored as ordered segments (video transcripts), without
    assembling any document: counts equal ``term_counts`` on the texts joined with one
    space (``docs``: doc_id of every document, segmented or not).

    Splitting the joined text on single whitespace characters gives exactly the
    concatenation of every segment's pieces (the joining space is a separator), so
    tokens are exploded per segment. Only the Tokenizer's removal of trailing empty
    tokens needs a per-document fact — the last non-empty piece — which is one row per
    document, joined back to one summary row per segment (salted, so a document holding
    a third of all segments is spread over ``salts`` tasks).
    """
    seg = skew.salted_join(segments.where(F.col("text").isNotNull()), docs.select("doc_id").distinct(),
                           ["doc_id"], salts=salts, how="left_semi",
                           salt_source=F.xxhash64("doc_id", "position"))
    low = F.lower(F.col("text"))
    pieces = F.split(low, WS, -1)
    words = (seg.select("doc_id", F.explode(pieces).alias("term"))
             .where((F.col("term") != "") & ~is_stop_word(F.col("term")))
             .groupBy("doc_id", "term").agg(F.count("*").alias("tf")))
    # one row per segment: length, pieces, empty pieces, and -- when it has a word -- the
    # empty pieces after its last word (= its trailing whitespace characters)
    has_word = low.rlike("[^ \\t\\n\\x0B\\f\\r]")
    per_seg = seg.select(
        "doc_id", "position", F.length("text").alias("len"), F.size(pieces).alias("n_pieces"),
        (F.size(pieces) - F.size(F.array_remove(pieces, ""))).alias("n_empty"), has_word.alias("has_word"),
        (F.length(low) - F.length(F.regexp_replace(low, WS + "+$", ""))).alias("trail_in"))
    last_seg = per_seg.where("has_word").groupBy("doc_id").agg(F.max("position").alias("last_pos"))
    j = skew.salted_join(per_seg, last_seg, ["doc_id"], salts=salts, how="left",
                         salt_source=F.xxhash64("doc_id", "position"))
    trailing = (F.when(F.col("last_pos").isNull() | (F.col("position") > F.col("last_pos")), F.col("n_pieces"))
                .when(F.col("position") == F.col("last_pos"), F.col("trail_in"))
                .otherwise(F.lit(0)))
    per_doc = j.groupBy("doc_id").agg(
        (F.sum("n_empty") - F.sum(trailing)).alias("kept"), F.max("last_pos").alias("last_pos"),
        (F.sum("len") + F.count("*") - 1).alias("chars"))
    # documents whose joined text is '' tokenize to [''] (no segments, or one empty segment)
    d = docs.select("doc_id").distinct().join(per_doc, "doc_id", "left")
    empty_tf = (F.when(F.coalesce(F.col("chars"), F.lit(0)) == 0, F.lit(1))
                .when(F.col("last_pos").isNull(), F.lit(0))
                .otherwise(F.col("kept")))
    blanks = d.select("doc_id", F.lit("").alias("term"), empty_tf.cast("bigint").alias("tf")).where("tf > 0")
    return words.unionByName(blanks)


def vocabulary(docs: DataFrame, id_col: str, text_col: str, vocab_size: int | None = None) -> DataFrame:
    """The vocabulary in CountVectorizer's order — terms by corpus count (desc, then term)
    with a 1-based rank; all of them, or the first ``vocab_size``. Runs a job: the term table is
    written to the checkpoint folder.

    The rank is computed without any single-task merge: the term table is range-sorted,
    each row is stamped with its partition and its position in it, and the result is
    checkpointed to the shared folder (so layout and positions are fixed even if tasks
    are retried). A rank is then the row's position plus the number of rows in all
    earlier partitions, taken from a table with one row per partition (broadcast)."""
    from pyspark.sql import Window
    from brieflane.session import cut_lineage

    d = doc_freq(counts_by_doc(docs, id_col, text_col))
    order = [F.col("total_count").desc(), F.col("term")]
    stamped = cut_lineage(d.repartitionByRange(*order).sortWithinPartitions(*order)
                          .withColumn("_pid", F.spark_partition_id())
                          .withColumn("_mid", F.monotonically_increasing_id()))
    sizes = stamped.groupBy("_pid").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    ranked = stamped.join(F.broadcast(offsets), "_pid").select(
        "term", "total_count", "doc_freq", (F.col("_off") + pos + 1).cast("bigint").alias("rank"))
    return ranked if vocab_size is None else ranked.where(F.col("rank") <= vocab_size)


def ml_pipeline(text_col: str, vocab_size: int = (1 << 31) - 1):
    """The vector form: Tokenizer -> StopWordsRemover -> CountVectorizer -> IDF, over all terms
    (the default is the most that a Spark ML vector can hold; CountVectorizer's own is 2^18).
    Spark ML keeps its vocabulary on the driver; the long form does not."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, CountVectorizer, StopWordsRemover, Tokenizer
    return Pipeline(stages=[
        Tokenizer(inputCol=text_col, outputCol="_words"),
        StopWordsRemover(inputCol="_words", outputCol="_filtered"),
        CountVectorizer(inputCol="_filtered", outputCol="_raw", vocabSize=vocab_size),
        IDF(inputCol="_raw", outputCol="features"),
    ])


def feature_sums(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, total) of the vectors of :func:`ml_pipeline`: non-zeros and weight sum of every
    document, from the long form, so that no vocabulary is on the driver and none is capped."""
    m = docs.agg(F.count("*")).scalar()
    tf = written(counts_by_doc(docs, id_col, text_col), "counts", compression="zstd")
    w = written(doc_freq(tf).select("term", "doc_freq", idf_column(m, F.col("doc_freq")).alias("idf")), "idf", compression="zstd")
    often = F.col("doc_freq") >= F.ceil(w.agg(F.sum("doc_freq")).scalar() / HEAD_TERMS)
    sums = (weighted(tf, w.where(often).select("term", "idf"), w.where(~often).select("term", "idf"))
            .select("doc_id", (F.col("tf") * F.col("idf")).alias("tfidf")).groupBy("doc_id")
            .agg(F.count_if(F.col("tfidf") != 0).alias("n"), F.sum("tfidf").alias("total")))
    out = docs.select(F.col(id_col).alias("doc_id")).join(sums.hint("merge"), "doc_id", "left")
    return out.select(F.col("doc_id").alias(id_col), F.coalesce("n", F.lit(0)).alias("n"),
                      F.coalesce("total", F.lit(0.0)).alias("total"))


# --------------------------------------------------------------------------- J1
def clean_text(text: Column) -> Column:
    """Tags, URLs and punctuation removed, lower-cased, whitespace collapsed."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]*>", " ")
    t = F.regexp_replace(t, r"https?://[^ \t\n\x0B\f\r]+", " ")
    t = F.regexp_replace(F.lower(t), r"[^\p{L}\p{N} \t\n\x0B\f\r]+", " ")
    return F.trim(F.regexp_replace(t, WS + "+", " "))
