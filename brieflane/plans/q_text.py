"""Text-feature queries (E1–E6, J1, J2) on post titles, article titles and transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from brieflane import fixed
from brieflane import sinks
from brieflane.operators import features
from brieflane.operators import text as tx
from brieflane.plans import api, q_sources
from brieflane.plans.oracle_views import lit, register_view, with_views
from brieflane.plans.registry import query
from brieflane.sources import fixtures as fx
from brieflane.streaming import posts_stream

_WS = "[ \\t\\n\\x0B\\f\\r]"
_STOP = "(" + ", ".join(lit(w) for w in fixed.ENGLISH_STOP_WORDS) + ")"


def sql_tokens(t: str) -> str:
    low = f"lower(coalesce({t}, ''))"
    stripped = f"regexp_replace({low}, '{_WS}+$', '')"
    return (f"(CASE WHEN {low} = '' THEN [''] WHEN {stripped} = '' THEN CAST([] AS VARCHAR[]) "
            f"ELSE string_split_regex({stripped}, '{_WS}') END)")


def sql_clean(t: str) -> str:
    x = f"regexp_replace(coalesce({t}, ''), '<[^>]*>', ' ', 'g')"
    x = f"regexp_replace({x}, 'https?://[^ \\t\\n\\x0B\\f\\r]+', ' ', 'g')"
    x = f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}} \\t\\n\\x0B\\f\\r]+', ' ', 'g')"
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _register_corpus(name: str, source_view: str, id_expr: str, text_expr: str) -> None:
    register_view(f"{name}_docs", (source_view,), f"SELECT {id_expr} AS doc_id, {text_expr} AS txt FROM {source_view}")
    register_view(f"{name}_tok", (f"{name}_docs",), f"""
  SELECT doc_id, unnest(toks) AS token, CAST(generate_subscripts(toks, 1) - 1 AS INTEGER) AS pos
  FROM (SELECT doc_id, {sql_tokens('txt')} AS toks FROM {name}_docs)""")
    register_view(f"{name}_tf", (f"{name}_tok",), f"""
  SELECT doc_id, token AS term, count(*) AS tf FROM {name}_tok WHERE token NOT IN {_STOP} GROUP BY 1, 2""")
    register_view(f"{name}_df", (f"{name}_tf",), f"""
  SELECT term, count(*) AS doc_freq, CAST(sum(tf) AS BIGINT) AS total_count FROM {name}_tf GROUP BY term""")
    register_view(f"{name}_idf", (f"{name}_df", f"{name}_docs"), f"""
  SELECT term, doc_freq, ln(CAST((SELECT count(*) FROM {name}_docs) AS DOUBLE) + 1.0)
         - ln(CAST(doc_freq AS DOUBLE) + 1.0) AS idf FROM {name}_df""")


_register_corpus("ptext", "posts", "id", "title")
_register_corpus("atext", "articles", "article_id", "title")
_register_corpus("vtext", "videos", "video_id", "transcript_text")


def _tfidf_sql(name: str) -> str:
    return with_views([f"{name}_tf", f"{name}_idf"], f"""
SELECT t.doc_id, t.term, t.tf, round(i.idf, 6) AS idf, round(t.tf * i.idf, 6) AS tfidf
FROM {name}_tf t JOIN {name}_idf i USING (term)""")


def _posts_docs(spark, sf_dir):
    return fx.posts(spark, sf_dir).select("id", "title")


def _tfidf_out(df):
    return df.select("doc_id", "term", "tf", F.round("idf", 6).alias("idf"), F.round("tfidf", 6).alias("tfidf"))


@query("tokenize_titles", with_views(["ptext_tok"], "SELECT doc_id, pos, token FROM ptext_tok"))
def tokenize_titles(spark, sf_dir):
    """Tokenizer tokens of every post title, with positions."""
    return tx.doc_tokens(_posts_docs(spark, sf_dir), "id", "title").select("doc_id", F.col("pos").cast("int"), "token")


@query("stopword_filtered", with_views(["ptext_tok"], f"""
SELECT doc_id, pos, token FROM ptext_tok WHERE token NOT IN {_STOP}"""))
def stopword_filtered(spark, sf_dir):
    """Title tokens without English stop words."""
    t = tx.filtered_tokens(tx.doc_tokens(_posts_docs(spark, sf_dir), "id", "title"))
    return t.select("doc_id", F.col("pos").cast("int"), "token")


@query("term_counts", with_views(["ptext_tf"], "SELECT doc_id, term, tf FROM ptext_tf"))
def term_counts(spark, sf_dir):
    """Term counts per post title."""
    return tx.term_counts(_posts_docs(spark, sf_dir), "id", "title")


@query("vocabulary_rank", with_views(["ptext_df"], """
SELECT term, total_count, doc_freq,
       CAST(row_number() OVER (ORDER BY total_count DESC, term) AS BIGINT) AS rank
FROM ptext_df"""))
def vocabulary_rank(spark, sf_dir):
    """The title vocabulary in CountVectorizer order (corpus count desc, term)."""
    return tx.vocabulary(_posts_docs(spark, sf_dir), "id", "title")


@query("idf_weights", with_views(["ptext_idf"], "SELECT term, doc_freq, round(idf, 6) AS idf FROM ptext_idf"))
def idf_weights(spark, sf_dir):
    """E5: IDF of every title term."""
    w = tx.idf_weights(_posts_docs(spark, sf_dir), "id", "title")
    return w.select("term", "doc_freq", F.round("idf", 6).alias("idf"))


@query("tfidf_posts", _tfidf_sql("ptext"))
def tfidf_posts(spark, sf_dir):
    """TF-IDF of post titles (long form)."""
    return _tfidf_out(tx.tfidf(_posts_docs(spark, sf_dir), "id", "title"))


@query("tfidf_articles", _tfidf_sql("atext"))
def tfidf_articles(spark, sf_dir):
    """TF-IDF of article titles."""
    a = q_sources.articles(spark, sf_dir).select(F.col("article_id").alias("doc_id"), "title")
    return _tfidf_out(api.text_features(a, "doc_id", "title"))


@query("tfidf_transcripts", _tfidf_sql("vtext"))
def tfidf_transcripts(spark, sf_dir):
    """TF-IDF of whole video transcripts, counted per segment (no transcript is
    assembled; equal to tokenizing the space-joined text)."""
    docs = q_sources.video_ids(spark, sf_dir).select(F.col("video_id").alias("doc_id"))
    seg = fx.transcript_segments(spark, sf_dir).select(F.col("video_id").alias("doc_id"), "position", "text")
    tf = tx.segment_term_counts(seg, docs)
    return _tfidf_out(tx.tfidf_from_counts(tf, docs.agg(F.count("*")).scalar()))


@query("tfidf_mllib", with_views(["posts", "ptext_idf", "ptext_tf"], """
SELECT p.id AS doc_id, CAST(count(t.w) FILTER (WHERE t.w <> 0) AS INTEGER) AS n_terms, round(coalesce(sum(t.w), 0.0), 4) AS weight_sum
FROM posts p LEFT JOIN (SELECT f.doc_id, f.tf * i.idf AS w FROM ptext_tf f JOIN ptext_idf i USING (term)) t ON t.doc_id = p.id
GROUP BY p.id"""))
def tfidf_mllib(spark, sf_dir):
    """E1–E6 as the Spark ML pipeline counts them: per title, non-zeros and weight sum.

    Summed from the long form: Spark ML holds its whole vocabulary on the driver. Tests hold
    the sums against the vectors of the pipeline."""
    p = fx.posts(spark, sf_dir).select("id", F.coalesce("title", F.lit("")).alias("title"))
    return tx.feature_sums(p, "id", "title").select(
        F.col("id").alias("doc_id"), F.col("n").cast("int").alias("n_terms"),
        F.round("total", 4).alias("weight_sum"))


def _vectors_sql(texts: str, model: str) -> str:
    """What the vectors of the corpus ``texts`` hold, by the vocabulary and IDF of ``model``."""
    return with_views([f"{texts}_tf", f"{texts}_docs", f"{model}_df", f"{model}_idf"], f"""
WITH ranks AS (SELECT term, row_number() OVER (ORDER BY total_count DESC, term) - 1 AS i FROM {model}_df),
w AS (SELECT t.doc_id, r.i, t.tf * d.idf AS w FROM {texts}_tf t JOIN ranks r USING (term) JOIN {model}_idf d USING (term))
SELECT d.doc_id, (SELECT count(*) FROM ranks) AS size, CAST(count(w.i) AS INTEGER) AS n_terms, min(w.i) AS first_index,
       max(w.i) AS last_index, CAST(coalesce(sum(w.i), 0) AS BIGINT) AS index_sum, round(coalesce(sum(w.w), 0.0), 4) AS weight_sum,
       round(sqrt(coalesce(sum(w.w * w.w), 0.0)), 4) AS length
FROM {texts}_docs d LEFT JOIN w ON w.doc_id = d.doc_id GROUP BY d.doc_id""")


@query("feature_vectors", _vectors_sql("ptext", "ptext"))
def feature_vectors(spark, sf_dir):
    """The sparse TF-IDF vector of every title, by a stored model (see ``features``)."""
    p = _posts_docs(spark, sf_dir)
    model = features.fit(p, "id", "title", posts_stream.shared_folder(spark, "feature-model"))
    return features.summary(model.vectors(p, "id", "title"), "id", model.n_terms)


SPLIT = "2024-01-21"
register_view("seen", ("posts",), f"SELECT * FROM posts WHERE created_utc < TIMESTAMP '{SPLIT}'")
register_view("unseen", ("posts",), f"SELECT * FROM posts WHERE created_utc >= TIMESTAMP '{SPLIT}'")
_register_corpus("stext", "seen", "id", "title")
_register_corpus("utext", "unseen", "id", "title")


@query("feature_vectors_unseen", _vectors_sql("utext", "stext"))
def feature_vectors_unseen(spark, sf_dir):
    """Vectors of the posts of the last days by a model of the earlier ones; terms that the
    model has not seen are left out."""
    p = fx.posts(spark, sf_dir).select("id", "title", "created_utc")
    early = F.col("created_utc") < F.lit(SPLIT).cast("timestamp_ntz")
    folder = posts_stream.shared_folder(spark, "feature-model")
    features.fit(p.where(early), "id", "title", folder)
    model = features.FeatureModel(spark, folder)
    return features.summary(model.vectors(p.where(~early), "id", "title"), "id", model.n_terms)


@query("features_sink", _tfidf_sql("atext"))
def features_sink(spark, sf_dir):
    """Article features written to Parquet in the shared folder and read back."""
    a = q_sources.articles(spark, sf_dir).select(F.col("article_id").alias("doc_id"), "title")
    path = posts_stream.shared_folder(spark, "features")
    sinks.write_features(tx.tfidf(a, "doc_id", "title"), path)
    return _tfidf_out(spark.read.parquet(path))


@query("cleaned_text", with_views(["posts", "articles"], f"""
SELECT 'post' AS kind, id AS record_id, {sql_clean('selftext')} AS cleaned FROM posts
UNION ALL
SELECT 'article', CAST(article_id AS VARCHAR), {sql_clean('description')} FROM articles"""))
def cleaned_text(spark, sf_dir):
    """Cleaned post bodies and article descriptions (whole texts)."""
    p = fx.posts(spark, sf_dir).select(F.lit("post").alias("kind"), F.col("id").alias("record_id"),
                                       tx.clean_text(F.col("selftext")).alias("cleaned"))
    a = q_sources.articles(spark, sf_dir).select(
        F.lit("article").alias("kind"), F.col("article_id").cast("string").alias("record_id"),
        tx.clean_text(F.col("description")).alias("cleaned"))
    return p.unionByName(a)
