"""DuckDB twins of the fixture views and shared steps, for the SQL oracles.

``with_views(names, select)`` prefixes a SELECT with the CTEs it needs (dependencies
first). Only the base parquet tables are assumed to exist as views.
"""

from __future__ import annotations

from brieflane import fixed
from brieflane.sources import fixtures as fx


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(vals) -> str:
    if vals is None:
        return "CAST(NULL AS VARCHAR[])"
    if not vals:
        return "CAST([] AS VARCHAR[])"
    return "[" + ", ".join(lit(v) for v in vals) + "]"


def _values(rows: list[tuple], names: list[str]) -> str:
    body = ",\n    ".join("(" + ", ".join(rows_i) + ")" for rows_i in rows)
    return f"SELECT * FROM (VALUES\n    {body}) AS t({', '.join(names)})"


# ------------------------------------------------------------------ scalar SQL pieces
def sql_window(tf: str) -> str:
    cases = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in fixed.TIMEFRAME_WINDOWS.items())
    return f"(CASE {tf} {cases} ELSE {lit(fixed.DEFAULT_TIMEFRAME_WINDOW)} END)"


def sql_window_days(tf: str, strict_compat: bool = False) -> str:
    key = f"replace(lower({tf}), '1', '')" if strict_compat else sql_window(tf)
    cases = " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in fixed.WINDOW_DAYS.items())
    return f"(CASE {key} {cases} ELSE {fixed.DEFAULT_WINDOW_DAYS} END)"


def sql_gen_subreddits(e: str) -> str:
    base = str_list(fixed.GENERATED_BASE_SUBREDDITS)
    sq = f"replace({e}, ' ', '')"
    return (f"(CASE WHEN regexp_full_match({sq}, '[\\p{{L}}\\p{{N}}]+') "
            f"THEN list_append({base}, {sq}) ELSE {base} END)")


def sql_gen_terms(e: str) -> str:
    return f"list_transform({str_list(fixed.GENERATED_TERM_SUFFIXES)}, lambda s: {e} || ' ' || s)"


def sql_gen_keywords(e: str) -> str:
    return f"list_prepend({e}, {str_list(fixed.GENERATED_EXTRA_KEYWORDS)})"


def sql_relevant(title: str, keywords: str, companies: str) -> str:
    return (f"(len(list_filter(coalesce({keywords}, CAST([] AS VARCHAR[])), lambda k: contains(lower({title}), k))) > 0 "
            f"OR len(list_filter(coalesce({companies}, CAST([] AS VARCHAR[])), lambda c: contains(upper(lower({title})), c))) > 0)")


def sql_epoch_ntz(epoch: str) -> str:
    return f"(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST({epoch} AS BIGINT)))"


def sql_iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"


# ------------------------------------------------------------------------------ views
def _cfg_rows():
    rows = [(k, v) for k, v in fixed.REFERENCE_CONFIGS.items()] + list(fx.FIXTURE_CONFIGS.items())
    return [(lit(k), str_list(v["subreddits"]), str_list(v["search_terms"]),
             str_list(v["companies"]), str_list(v["keywords"])) for k, v in rows]


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "posts_epoch": ((), f"""
  SELECT CAST(doc_id AS VARCHAR) AS id, text AS title, source AS subreddit,
         CAST(n_chars % 1000 AS BIGINT) AS score, CAST((doc_id * 37) % 200 AS BIGINT) AS num_comments,
         CAST({fx.EPOCH_2024} + (doc_id % 30) * 86400 + (doc_id * 7919) % 86400 AS BIGINT) AS created_epoch,
         text AS selftext, lang AS search_term, doc_id AS resp_order
  FROM documents"""),
    "posts": (("posts_epoch",), f"""
  SELECT id, title, subreddit, score, num_comments, {sql_epoch_ntz('created_epoch')} AS created_utc,
         selftext, search_term, resp_order
  FROM posts_epoch"""),
    "entity_config": ((), _values(_cfg_rows(), ["entity", "subreddits", "search_terms", "companies", "keywords"])),
    "analyzed": ((), _values([(lit(e), lit(tf), str(i)) for i, (e, tf) in enumerate(fx.ANALYZED_ENTITIES)],
                             ["entity", "timeframe", "entity_pos"])),
    "cfg_lookup": (("analyzed", "entity_config"), f"""
  SELECT a.entity, a.entity_pos, a.timeframe,
         CASE WHEN c.entity IS NOT NULL THEN c.subreddits ELSE {sql_gen_subreddits('a.entity')} END AS subreddits,
         CASE WHEN c.entity IS NOT NULL THEN c.search_terms ELSE {sql_gen_terms('a.entity')} END AS search_terms,
         CASE WHEN c.entity IS NOT NULL THEN c.companies ELSE {str_list(fixed.GENERATED_COMPANIES)} END AS companies,
         CASE WHEN c.entity IS NOT NULL THEN c.keywords ELSE {sql_gen_keywords('a.entity')} END AS keywords,
         c.entity IS NOT NULL AS configured
  FROM analyzed a LEFT JOIN entity_config c ON lower(a.entity) = c.entity"""),
    "plan_subs": (("cfg_lookup",), """
  SELECT entity, entity_pos, timeframe, keywords, companies, search_terms,
         unnest(subreddits) AS subreddit, CAST(generate_subscripts(subreddits, 1) - 1 AS INTEGER) AS sub_pos
  FROM cfg_lookup"""),
    "plan": (("plan_subs",), """
  SELECT entity, entity_pos, timeframe, keywords, companies, sub_pos, subreddit,
         unnest(search_terms) AS search_term, CAST(generate_subscripts(search_terms, 1) - 1 AS INTEGER) AS term_pos
  FROM plan_subs"""),
    "anchor": (("posts",), "SELECT max(created_utc) AS anchor_ts FROM posts"),
    "fetched": (("posts", "plan", "anchor"), f"""
  SELECT p.id, p.title, p.subreddit, p.score, p.num_comments, p.created_utc, p.selftext,
         p.search_term, p.resp_order, pl.entity, pl.entity_pos, pl.timeframe, pl.keywords,
         pl.companies, pl.sub_pos, pl.term_pos
  FROM posts p JOIN plan pl ON p.subreddit = pl.subreddit AND p.search_term = pl.search_term
  CROSS JOIN anchor a
  WHERE p.created_utc >= a.anchor_ts - to_days(CAST({sql_window_days('pl.timeframe')} AS INTEGER))"""),
    "relevant": (("fetched",), f"""
  SELECT *, CAST(coalesce(score, 0) + coalesce(num_comments, 0) AS BIGINT) AS engagement
  FROM fetched
  WHERE coalesce({sql_relevant('title', 'keywords', 'companies')}, false)"""),
    "best_posts": (("relevant",), """
  SELECT * FROM relevant
  QUALIFY row_number() OVER (PARTITION BY entity_pos, title
                             ORDER BY engagement DESC, sub_pos, term_pos, resp_order) = 1"""),
    "top_posts": (("best_posts",), """
  SELECT *, CAST(row_number() OVER (PARTITION BY entity_pos
                 ORDER BY engagement DESC, sub_pos, term_pos, resp_order) AS BIGINT) AS rank
  FROM best_posts
  QUALIFY rank <= 10"""),
    "top_posts_score": (("fetched",), """
  SELECT *, CAST(row_number() OVER (PARTITION BY entity_pos
                 ORDER BY score DESC, sub_pos, term_pos, resp_order) AS BIGINT) AS rank
  FROM fetched
  QUALIFY rank <= 10"""),
}


def register_view(name: str, deps: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (deps, sql)


def with_views(names, select: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return select
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]}\n)" for n in order)
    body = select.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{select}"
