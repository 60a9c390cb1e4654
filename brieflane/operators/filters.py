"""Predicates (C1, C3–C6): relevance, boolean text query, time range, language."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _nonnull_array(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def is_relevant(title: Column, keywords: Column, companies: Column, word_boundary: bool = False) -> Column:
    """Any keyword inside lower(title), or any ticker inside upper(lower(title)).

    Substring matching (default) over-matches short keys ('ev', 'ore', 'F'), as the
    reproduced behaviour does. ``word_boundary=True`` matches whole tokens instead.
    A null title is never relevant (that row alone is dropped).
    """
    low = F.lower(title)
    up = F.upper(low)
    if word_boundary:
        words = F.split(low, r"[^\p{L}\p{N}]+")
        up_words = F.split(up, r"[^\p{L}\p{N}]+")
        kw = F.exists(_nonnull_array(keywords),
                      lambda k: F.when(F.instr(k, " ") > 0, F.concat(F.lit(" "), low, F.lit(" ")).contains(
                          F.concat(F.lit(" "), k, F.lit(" ")))).otherwise(F.array_contains(words, k)))
        co = F.exists(_nonnull_array(companies), lambda c: F.array_contains(up_words, c))
    else:
        kw = F.exists(_nonnull_array(keywords), lambda k: low.contains(k))
        co = F.exists(_nonnull_array(companies), lambda c: up.contains(c))
    return F.coalesce(kw | co, F.lit(False))


def relevance_filter(df: DataFrame, title: str = "title", keywords: str = "keywords",
                     companies: str = "companies", word_boundary: bool = False) -> DataFrame:
    return df.where(is_relevant(F.col(title), F.col(keywords), F.col(companies), word_boundary))


def matches_cnf(text: Column, cnf: Column) -> Column:
    """Every OR-group has a term contained in lower(text)."""
    low = F.lower(text)
    return F.coalesce(F.forall(cnf, lambda group: F.exists(group, lambda t: low.contains(t))), F.lit(False))


def within_window(ts: Column, cutoff_ts: Column) -> Column:
    """C4: inclusive lower bound on time."""
    return ts >= cutoff_ts


def language_is(lang: Column, code: str = "en") -> Column:
    """C5."""
    return lang == F.lit(code)


GRAM = 3


def text_grams(text: Column) -> Column:
    """Distinct substrings of 1 to GRAM characters, from one pass over the characters."""
    def grams(chars: Column) -> Column:
        def of(n: int) -> Column:
            return F.transform(chars, lambda c, i: F.concat(c, *[F.coalesce(F.get(chars, i + k), F.lit("")) for k in range(1, n)]))
        return F.array_distinct(F.concat(chars, *[of(n) for n in range(2, GRAM + 1)]))

    # bound once as a lambda's variable; a plain expression would be split again for every gram
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.get(F.transform(F.array(chars), grams), 0)


def term_pieces(terms: DataFrame, term_col: str) -> DataFrame:
    """(_term, _piece, _gram) of the distinct non-null terms: a term's longest piece without a space,
    which must lie inside a word of any text that holds the term, and its first characters."""
    pieces = F.split(F.col(term_col), " ")
    longest = F.element_at(F.array_sort(F.transform(pieces, lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), -1)["x"]
    keyed = terms.where(F.col(term_col).isNotNull()).select(F.col(term_col).alias("_term"), longest.alias("_piece")).distinct()
    return keyed.withColumn("_gram", F.substring("_piece", 1, GRAM))


def words_with_pieces(grams: DataFrame, pieces: DataFrame) -> DataFrame:
    """(_word, _term): words of a gram table (_gram, _word) that hold the piece of a term."""
    near = grams.join(pieces.where(F.col("_piece") != ""), "_gram")
    return near.where(F.col("_word").contains(F.col("_piece"))).select("_word", "_term").distinct()


def distinct_words(rows: DataFrame, row_id: str, text: Column, *keep: str) -> DataFrame:
    """(_rid, keep..., _word): the distinct words of every text."""
    words = F.explode(F.array_distinct(F.split(text, " "))).alias("_word")
    return rows.where(text.isNotNull()).select(F.col(row_id).alias("_rid"), *keep, words).where(F.col("_word") != "")


def substring_matches(df: DataFrame, text: Column, terms: DataFrame, term_col: str, row_id: str) -> DataFrame:
    """Rows of ``df`` joined to every row of ``terms`` whose term occurs in ``text`` (compared as
    given; an empty term occurs in every text, a null one in none). ``row_id`` is a unique key
    of ``df``.

    One exact path for any number of terms. A term stands for its longest piece without a
    space, which must occur inside a word of the text. Only the distinct words of all texts
    are looked at: their grams (1 to GRAM characters) meet the first characters of the pieces in
    an equi-join, ``contains`` decides, and the matching words are joined back to their rows. A
    term with a space is then looked for in the text itself, on those rows only. Words that
    very many texts hold make large join partitions, which adaptive execution splits.
    ``word_index`` keeps the words of landed texts, so that they are split only once.
    """
    words = distinct_words(df, row_id, text)
    grams = words.select("_word").distinct().select("_word", F.explode(text_grams(F.col("_word"))).alias("_gram"))
    found = words.join(words_with_pieces(grams, term_pieces(terms, term_col)), "_word").select("_rid", "_term").distinct()
    spaced = F.instr("_term", " ") > 0
    hits = found.where(~spaced).unionByName(
        df.select(F.col(row_id).alias("_rid"), text.alias("_text")).join(found.where(spaced), "_rid")
        .where(F.col("_text").contains(F.col("_term"))).select("_rid", "_term"))
    return rows_of_hits(df, hits, terms, term_col, row_id).unionByName(blank_matches(df, text, terms, term_col, row_id))


def rows_of_hits(df: DataFrame, hits: DataFrame, terms: DataFrame, term_col: str, row_id: str) -> DataFrame:
    """``df`` joined to ``terms`` by (_rid, _term) pairs."""
    by_term = terms.where(F.col(term_col).isNotNull())
    out = hits.join(by_term, F.col("_term") == by_term[term_col]).drop("_term")
    return df.join(out.withColumnRenamed("_rid", row_id), row_id)


def blank_matches(df: DataFrame, text: Column, terms: DataFrame, term_col: str, row_id: str) -> DataFrame:
    """Rows with the terms that are empty or spaces only, which have no piece."""
    blank = terms.where(F.col(term_col).isNotNull() & (F.trim(term_col) == ""))
    return _with_every(df.where(text.isNotNull()), blank, row_id).where(text.contains(F.col(term_col)))


def _with_every(df: DataFrame, few: DataFrame, row_id: str) -> DataFrame:
    """Every row of ``df`` with every row of ``few`` (what a trivially true query returns), as an
    equi-join on a part number. There are as many parts as the session's shuffles have partitions."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = df.withColumn("_part", F.pmod(F.xxhash64(row_id), F.lit(parts)).cast("int"))
    right = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.join(right, "_part").drop("_part")


def cnf_matches(df: DataFrame, row_id: str, text: Column, queries: DataFrame, keys: Sequence[str],
                cnf_col: str = "cnf", match: Callable[..., DataFrame] = substring_matches) -> DataFrame:
    """Rows of ``df`` joined to every query row (``keys`` + CNF) whose CNF holds on ``text``,
    as ``matches_cnf`` has it: terms are looked for in lower(text), no group is always true, an
    empty group never.

    A (row, query) pair matches when every OR-group has a hit; hits come from ``match``
    (``substring_matches``, or a ``word_index`` of the texts).
    """
    low = F.lower(text)
    q = queries.select(*keys, cnf_col).distinct()
    groups = q.select(*keys, F.size(cnf_col).alias("_ng"), F.posexplode(cnf_col).alias("_g", "_grp"))
    terms = groups.select(*keys, "_ng", "_g", F.explode("_grp").alias("_term_of")).distinct()
    hits = match(df.select(row_id, low.alias("_t")), F.col("_t"), terms, "_term_of", row_id)
    n_hit = hits.select(row_id, *keys, "_ng", "_g").distinct().groupBy(row_id, *keys, "_ng").agg(F.count("*").alias("_hit"))
    ok = n_hit.where(F.col("_hit") == F.col("_ng")).select(row_id, *keys)
    every = _with_every(df.where(text.isNotNull()).select(row_id), q.where(F.size(cnf_col) == 0).select(*keys), row_id)
    return df.join(ok.unionByName(every), row_id, "inner")
