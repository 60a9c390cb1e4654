"""Literal-row tests for edge cases and compatibility rules."""

import datetime as dt

from pyspark.sql import functions as F

from brieflane import fixed
from brieflane.operators import config as cfgops
from brieflane.operators import filters, market, ranking
from brieflane.operators import text as tx
from brieflane.plans import api
from brieflane.sources import ingest


def test_stop_words_equal_spark_default(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert fixed.ENGLISH_STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_tokenizer_edges_match_ml_tokenizer(spark):
    from pyspark.ml.feature import Tokenizer
    texts = ["", "  ", " x", "A b  c  ", "Price, UP!", "tab\tsep\nline", "\x0bvt", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    ours = {r.id: r.toks for r in df.select("id", tx.tokenize(F.col("t")).alias("toks")).collect()}
    ml = Tokenizer(inputCol="t2", outputCol="w").transform(df.select("id", F.coalesce("t", F.lit("")).alias("t2")))
    theirs = {r.id: r.w for r in ml.collect()}
    assert ours == theirs
    assert ours[0] == [""] and ours[1] == [] and ours[2] == ["", "x"]


def test_relevance_substring_overmatch_and_null_title(spark):
    df = spark.createDataFrame(
        [("Forever young", ["ev"], []), ("Ford news", [], ["F"]), (None, ["ev"], ["F"]), ("nothing", ["zz"], None)],
        "title string, keywords array<string>, companies array<string>")
    got = [r.title for r in filters.relevance_filter(df).collect()]
    assert got == ["Forever young", "Ford news"]
    wb = [r.title for r in filters.relevance_filter(df, word_boundary=True).collect()]
    assert wb == []


def test_generated_config_rules(spark):
    df = spark.createDataFrame([("rare earth",), ("S&P 500",), ("Gold",)], "entity string")
    rows = {r.entity: r for r in cfgops.generate_config(df).collect()}
    assert rows["rare earth"].subreddits[-1] == "rareearth"
    assert rows["S&P 500"].subreddits == fixed.GENERATED_BASE_SUBREDDITS
    assert rows["Gold"].search_terms[0] == "Gold price" and rows["Gold"].keywords[0] == "Gold"
    assert rows["Gold"].companies == ["SPY"]


def test_timeframe_codes(spark):
    codes = ["1d", "1w", "1mo", "3mo", "1y", "day", "1day", "xyz"]
    df = spark.createDataFrame([(c,) for c in codes], "tf string")
    out = {r.tf: (r.w, r.d, r.c) for r in df.select(
        "tf", cfgops.timeframe_window(F.col("tf")).alias("w"), cfgops.window_days(F.col("tf")).alias("d"),
        cfgops.window_days(F.col("tf"), strict_compat=True).alias("c")).collect()}
    assert out["1d"] == ("day", 1, 7)   # compat: "1d" -> "d" misses
    assert out["1w"] == ("week", 7, 7)
    assert out["1mo"] == ("month", 30, 7)   # compat: '1mo' -> 'mo' misses
    assert out["3mo"] == ("year", 365, 7)
    assert out["1y"] == ("year", 365, 7)
    assert out["day"] == ("week", 7, 1)
    assert out["1day"] == ("week", 7, 1)
    assert out["xyz"] == ("week", 7, 7)


def test_keep_best_ties_follow_arrival_order(spark):
    rows = [("e", "T", "a", 5, 1, 0, 2), ("e", "T", "b", 5, 0, 1, 0), ("e", "t", "c", 1, 0, 0, 0)]
    df = spark.createDataFrame(rows, "entity string, title string, id string, engagement long, "
                                     "sub_pos int, term_pos int, resp_order long")
    best = ranking.dedup_best(df, ["entity"], "title", api.engagement_order())
    got = sorted((r.title, r.id) for r in best.collect())
    assert got == [("T", "b"), ("t", "c")]  # same engagement: lower sub_pos wins; case-sensitive titles


def test_truthy_prices_and_volume(spark):
    charts = spark.createDataFrame([
        ("A", 200, '{"chart":{"result":[{"meta":{"regularMarketPrice":10.0,"previousClose":8.0},'
                   '"indicators":{"quote":[{"volume":[5, 1234567]}]}}]}}'),
        ("B", 200, '{"chart":{"result":[{"meta":{"regularMarketPrice":0,"previousClose":8.0},'
                   '"indicators":{"quote":[{"volume":[]}]}}]}}'),
        ("C", 200, '{"chart":{"result":[{"meta":{"regularMarketPrice":3.0},'
                   '"indicators":{"quote":[{"volume":[7, null]}]}}]}}'),
        ("D", 200, '{"chart":{"result":[{"meta":{"regularMarketPrice":2.0,"previousClose":4.0},'
                   '"indicators":{"quote":[{"volume":[7, 0]}]}}]}}'),
        ("E", 200, '{"chart":'),
    ], "symbol string, status int, body string")
    p = {r.symbol: r for r in ingest.parse_charts(charts).collect()}
    assert p["A"].last_volume == 1234567 and p["B"].last_volume is None and p["C"].last_volume is None
    assert p["E"].malformed
    req = spark.createDataFrame([("x", "1mo", i, s) for i, s in enumerate("ABCDEZ")],
                                "entity string, timeframe string, symbol_pos int, symbol string")
    q = {r.symbol: r for r in market.symbol_quotes(req, charts).collect()}
    assert [s for s in "ABCDEZ" if q[s].ok] == ["A", "D"]
    assert q["B"].reason == fixed.MISSING_PRICE and q["Z"].reason == "HTTP 404"
    assert q["E"].reason == fixed.MALFORMED_RESPONSE and q["C"].reason == fixed.MISSING_PRICE
    rep = market.market_reports(market.symbol_quotes(req, charts)).collect()[0]
    assert rep.n_ok == 2 and rep.n_symbols == 6 and rep.data_available
    assert "Volume: 1,234,567" in rep.analysis and "Change: 25.0%" in rep.analysis
    assert "Change: -50.0%" in rep.analysis and "\nError analyzing Z: HTTP 404" in rep.analysis
    assert rep.analysis.index("\nA:") < rep.analysis.index("\nD:")
    assert "Volume: 0" not in rep.analysis


def test_transcript_summary_lengths(spark):
    texts = ["", "x" * 10, "y" * 500, "z" * 501]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = [r.s for r in df.select(api.transcript_summary(F.col("t")).alias("s")).collect()]
    assert out[0] == fixed.NO_TRANSCRIPT
    assert out[1] == "x" * 10 + "..."
    assert out[2] == "y" * 500 + "..."
    assert out[3] == "z" * 500 + "..."


def test_unparsable_published_at_is_null(spark):
    df = spark.createDataFrame([("2024-01-05T10:11:12Z",), ("2024/01/05 10:11",), ("",), (None,)], "s string")
    out = [r.t for r in df.select(ingest.parse_iso_z(F.col("s")).alias("t")).collect()]
    assert out == [dt.datetime(2024, 1, 5, 10, 11, 12), None, None, None]


def test_envelope_edge_cases(spark):
    big = 2 ** 31 + 5
    rows = [
        ("r1", "sub", "t", 200, '{"data":{"children":[{"data":{"id":"a","title":"x","score":%d}},'
                                '{"data":{"id":"b","title":null,"created_utc":0}}]}}' % big),
        ("r2", "sub", "t", 200, "{}"),
        ("r3", "sub", "t", 200, '{"data":{"children":null}}'),
        ("r4", "sub", "t", 200, '{"data":{"children":[{"data":{"id":"c"'),
        ("r5", "sub", "t", 500, "oops"),
    ]
    resp = spark.createDataFrame(rows, "response_id string, subreddit string, search_term string, "
                                       "status int, body string")
    parsed = ingest.parse_post_envelopes(resp)
    posts = {r.id: r for r in ingest.envelope_posts(parsed).collect()}
    assert set(posts) == {"a", "b"}
    assert posts["a"].score == big and posts["a"].num_comments == 0 and posts["a"].selftext == ""
    assert posts["a"].subreddit == "sub" and posts["a"].created_utc == dt.datetime(1970, 1, 1)
    q = {r.record_id: r.reason for r in ingest.envelope_quarantine(parsed).collect()}
    assert q == {"r4": "malformed JSON", "r5": "HTTP 500"}


def test_sinks_write_and_read_back(spark, tmp_path):
    from brieflane import sinks
    df = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "entity string, term string, n long")
    sinks.write_features(df, str(tmp_path / "features"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "features")).collect()) == [("a", "x", 1), ("b", "y", 2)]
    sinks.export_reports(df, str(tmp_path / "reports"))
    back = spark.read.json(str(tmp_path / "reports"))
    assert sorted((r.entity, r.term, r.n) for r in back.collect()) == [("a", "x", 1), ("b", "y", 2)]
    assert all(d.name.startswith("bucket=") for d in (tmp_path / "reports").iterdir() if d.is_dir())


def test_plain_default_config(spark):
    from brieflane.sources import fixtures as fx
    ents = spark.createDataFrame([("Tesla",), ("IRON",)], "entity string")
    rows = {r.entity: r for r in cfgops.config_lookup(ents, fx.config_table(spark), default="plain").collect()}
    assert rows["Tesla"].subreddits == fixed.PLAIN_DEFAULT_SUBREDDITS
    assert rows["Tesla"].search_terms == ["Tesla"] and rows["Tesla"].keywords == ["tesla"]
    assert rows["Tesla"].companies == [] and not rows["Tesla"].configured
    assert rows["IRON"].configured and rows["IRON"].companies == fixed.REFERENCE_CONFIGS["iron"]["companies"]


def test_model_analysis_overrides_fallback(spark):
    from brieflane.plans import q_sources
    from brieflane.sources import fixtures as fx
    sf = "/root/testdata/sf0.001"
    src = api.Sources(posts=fx.posts(spark, sf), articles=q_sources.articles(spark, sf),
                      videos=q_sources.video_cards(spark, sf), config=fx.config_table(spark))
    analyses = spark.createDataFrame([("tion", "model says up")], "entity string, analysis string")
    rows = {r.entity: r for r in api.analyze_entities(src, fx.analyzed_entities(spark), analyses=analyses).collect()}
    assert rows["tion"].analysis == "model says up"
    assert rows["sch"].analysis.startswith(fixed.ERROR_PREFIX)
    assert rows["cryptocurrency"].status == "no_data" and rows["cryptocurrency"].analysis is None


def test_news_query_cnf(spark):
    df = spark.createDataFrame([
        ("iron", "Iron ore prices climb"), ("iron", "Steel market steady"), ("iron", "iron ore shipments"),
        ("Lithium", "lithium demand"), ("Lithium", "LITHIUM!"), ("Lithium", "nickel")],
        "entity string, text string")
    out = [(r.entity, r.text) for r in df.where(filters.matches_cnf(F.col("text"), cfgops.news_query(F.col("entity")))).collect()]
    assert out == [("iron", "Iron ore prices climb"), ("iron", "Steel market steady"),
                   ("Lithium", "lithium demand"), ("Lithium", "LITHIUM!")]


def test_word_boundary_multiword_and_tickers(spark):
    df = spark.createDataFrame(
        [("Rare earth supply", ["rare earth"], []), ("rareearth", ["rare earth"], []),
         ("Buy GM now", [], ["GM"]), ("gmail outage", [], ["GM"])],
        "title string, keywords array<string>, companies array<string>")
    assert [r.title for r in filters.relevance_filter(df, word_boundary=True).collect()] == ["Rare earth supply", "Buy GM now"]
    assert len(filters.relevance_filter(df).collect()) == 3   # substring mode: 'gmail' matches GM


def test_line_formats(spark):
    from brieflane.operators import report as rp
    r = spark.createDataFrame([("s", "T", 3, 4, "q", "N", "d", "C", 1234)],
                              "sub string, title string, score long, com long, term string, src string, "
                              "descr string, ch string, views long").select(
        rp.post_line(F.col("sub"), F.col("title"), F.col("score"), F.col("com"), F.col("term")).alias("p"),
        rp.news_line(F.col("title"), F.col("src")).alias("n"), rp.news_line_plain(F.col("title"), F.col("descr")).alias("np"),
        rp.video_line(F.col("title"), F.col("ch"), F.col("views")).alias("v")).collect()[0]
    assert r.p == "- [s] T (Score: 3, Comments: 4, Search term: q)"
    assert r.n == "- T (Source: N)" and r.np == "- T: d" and r.v == "- T (Channel: C, Views: 1234)"


def test_cut_lineage_uses_shared_checkpoint_folder(spark):
    from brieflane.session import cut_lineage, ensure_checkpoint_dir
    folder = ensure_checkpoint_dir(spark)
    assert folder
    df = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10
    assert "LogicalRDD" in df._jdf.queryExecution().optimizedPlan().toString()


def test_video_enrichment_defaults(spark):
    search = spark.createDataFrame(
        [(("v1",), ("T1", "C1", "2024-01-02T03:04:05Z"), 0), (("v2",), ("T2", "C2", "2024-01-03T00:00:00Z"), 1),
         (("v3",), ("T3", "C3", "bad"), 2), (("v4",), ("T4", "C4", "2024-01-04T00:00:00Z"), 3)],
        "id struct<videoId:string>, snippet struct<title:string,channelTitle:string,publishedAt:string>, search_pos long")
    stats = spark.createDataFrame([("v1", "12"), ("v2", None), ("v3", "abc")], "video_id string, viewCount string")
    tr = ingest.assemble_transcripts(spark.createDataFrame(
        [("v1", 1, "b"), ("v1", 0, "a"), ("v3", 0, "")], "video_id string, position int, text string"))
    v = {r.video_id: r for r in ingest.enrich_videos(search, stats, tr).collect()}
    assert set(v) == {"v1", "v2"}  # no statistics -> no video; a bad date or count -> quarantine
    assert {(r.record_id, r.reason) for r in ingest.videos_quarantine(search, stats).collect()} == {("v3", "unparsable publishedAt")}
    assert v["v1"].view_count == 12 and v["v2"].view_count == 0
    assert v["v1"].transcript_text == "a b" and v["v2"].transcript_text == ""
    assert v["v1"].published_at == dt.datetime(2024, 1, 2, 3, 4, 5)

def test_repeated_statistics_and_charts_count_once(spark):
    search = spark.createDataFrame([(("v1",), ("T", "C", "2024-01-02T03:04:05Z"), 0)],
                                   "id struct<videoId:string>, snippet struct<title:string,channelTitle:string,publishedAt:string>, search_pos long")
    stats = spark.createDataFrame([("v1", "12"), ("v1", "12"), ("v1", None)], "video_id string, viewCount string")
    assert [r.view_count for r in ingest.video_facts(search, stats).collect()] == [12]
    body = '{"chart":{"result":[{"meta":{"regularMarketPrice":2.675,"previousClose":0.125},"indicators":{"quote":[{"volume":[1]}]}}]}}'
    charts = spark.createDataFrame([("A", 200, body), ("A", 200, body), ("A", 503, None), ("B", None, body)], "symbol string, status int, body string")
    req = spark.createDataFrame([("e", "1d", 0, "A"), ("e", "1d", 1, "B"), ("f", "1d", None, None)],
                                "entity string, timeframe string, symbol_pos int, symbol string")
    rows = {r.entity: r for r in market.market_reports(market.symbol_quotes(req, charts)).collect()}
    assert rows["e"].n_symbols == 2 and rows["e"].n_ok == 1
    assert "$2.67\n" in rows["e"].analysis and "$0.12\n" in rows["e"].analysis and "HTTP without status" in rows["e"].analysis
    assert (rows["f"].n_symbols, rows["f"].n_ok, rows["f"].data_available) == (0, 0, False)


def test_decimals_as_python_prints_them(spark):
    import random
    rng = random.Random(4)
    xs = [2.675, 0.125, 2.25, -2.675, -0.04, 0.0, 1e9 + 0.005, 0.005, 1.005, 99.995, 1e-12, 12345678.125]
    xs += [rng.uniform(-500, 500) for _ in range(300)] + [rng.randrange(-99999, 99999) / 1000 for _ in range(600)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select("x", market.fixed_decimals(F.col("x"), 2).alias("two"), market.fixed_decimals(F.col("x"), 1).alias("one")).collect()
    assert [(r.two, r.one) for r in got] == [(f"{r.x:.2f}", f"{r.x:.1f}") for r in got]


def test_every_response_and_child_is_good_or_quarantined(spark):
    body = '{"data":{"children":[{"data":{"id":"a","score":1}},{"data":{"id":"b","score":"x"}},{"data":null},{"data":{"id":"c","created_utc":1e15}}]}}'
    rows = [("r1", 200, body), ("r2", None, body), ("r3", 200, None), ("r4", 200, ""), ("r5", 200, "{"), ("r6", 404, "")]
    df = spark.createDataFrame(rows, "response_id string, status int, body string").selectExpr("*", "'s' AS subreddit", "'t' AS search_term")
    parsed = ingest.parse_post_envelopes(df)
    assert [r.id for r in ingest.envelope_posts(parsed).collect()] == ["a"]
    assert {(r.record_id, r.reason) for r in ingest.envelope_quarantine(parsed).collect()} == {
        ("r2", "HTTP without status"), ("r3", "empty body"), ("r4", "empty body"), ("r5", "malformed JSON"), ("r6", "HTTP 404")}
    assert {(r.record_id, r.reason) for r in ingest.children_quarantine(parsed).collect()} == {
        ("r1#1", "bad score"), ("r1#2", "no data"), ("r1#3", "bad created_utc")}


def test_only_a_literal_z_parses(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05+02",), ("2024-13-02T03:04:05Z",), (None,)], "s string")
    assert [r[0] is not None for r in df.select(ingest.parse_iso_z(F.col("s"))).collect()] == [True, False, False, False]


def test_most_viewed_video_may_be_late_in_search_order(spark):
    vids = spark.createDataFrame([(str(i), f"tion {i}", i, 100 if i == 11 else i) for i in range(15)],
                                 "video_id string, title string, search_pos long, view_count long").withColumn("published_at", F.lit(dt.datetime(2024, 1, 1)))
    ents = spark.createDataFrame([("tion", "1d", 0), ("tion", "1mo", 1)], "entity string, timeframe string, entity_pos int")
    top = api.top_videos(vids, ents).collect()
    assert len(top) == 10 and all(r.video_id == "11" for r in top if r.rank == 1)


def test_per_request_cap_option(spark):
    from brieflane.sources import fixtures as fx
    p = fx.posts(spark, "/root/testdata/sf0.01")
    cfg = cfgops.config_lookup(fx.analyzed_entities(spark), fx.config_table(spark))
    capped = api.fetch_posts(p, cfg, None, per_request_cap=3)
    per_req = capped.groupBy("entity_pos", "subreddit", "search_term").count().collect()
    assert per_req and max(r["count"] for r in per_req) == 3
    assert capped.count() < api.fetch_posts(p, cfg, None).count()


def test_large_and_odd_prices_print_and_kill_no_job(spark):
    import math
    import random
    rng = random.Random(7)
    xs = [1e17, 1e18, 2.0 ** 43 + 0.125, 2.0 ** 52 + 0.5, 2.0 ** 63, 2.0 ** 63 - 1024, -2.0 ** 80, 4.1e37, -1e17, 999.995, 0.999999, -0.0, 5e-324,
          float("inf"), float("-inf"), float("nan")]
    xs += [rng.uniform(0.5, 1) * 2.0 ** rng.randrange(30, 126 - 1) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(market.fixed_decimals(F.col("x"), 2)).collect()]
    assert [g.removeprefix("-") for g in got] == [f"{x:.2f}".removeprefix("-") for x in xs]
    assert [g for g, x in zip(got, xs) if x < 0] == [f"{x:.2f}" for x in xs if x < 0]
    huge = spark.createDataFrame([(1e300,), (-1.7e308,)], "x double").select(market.fixed_decimals(F.col("x"), 1)).collect()
    assert [math.isclose(float(r[0]), x) and r[0].endswith(".0") for r, x in zip(huge, (1e300, -1.7e308))] == [True, True]


def chart(price, previous):
    return ('{"chart":{"result":[{"meta":{"regularMarketPrice":%s,"previousClose":%s},"indicators":{"quote":[{"volume":[1]}]}}]}}'
            % (price, previous))


def test_market_report_of_odd_prices(spark):
    rows = [("A", "1e17", "8.0"), ("B", "Infinity", "8.0"), ("C", "NaN", "8.0"), ("D", "5.0", "1e-300"), ("E", "1.5", "5e-324")]
    charts = spark.createDataFrame([(s, 200, chart(p, q)) for s, p, q in rows], "symbol string, status int, body string")
    req = spark.createDataFrame([("e", "1d", i, s) for i, s in enumerate("ABCDE")], "entity string, timeframe string, symbol_pos int, symbol string")
    r = market.market_reports(market.symbol_quotes(req, charts)).collect()[0]
    assert r.n_ok == 5 and "Current Price: $100000000000000000.00" in r.analysis
    assert "Current Price: $inf" in r.analysis and "Change: inf%" in r.analysis and "Current Price: $nan" in r.analysis


def test_a_truncated_response_never_stands_before_a_good_one(spark):
    good, cut, empty = chart("2.0", "1.0"), chart("2.0", "1.0")[:60], '{"chart":{"result":[]}}'
    for bodies in ([good, cut], [cut, good], [empty, good, cut], [cut + " ", good], [good, empty]):
        charts = spark.createDataFrame([("A", 200, b) for b in bodies] + [("A", 503, None)], "symbol string, status int, body string")
        req = spark.createDataFrame([("e", "1d", 0, "A")], "entity string, timeframe string, symbol_pos int, symbol string")
        assert [r.ok for r in market.symbol_quotes(req, charts).collect()] == [True]


def test_missing_title_and_source_have_their_texts(spark):
    raw = spark.createDataFrame([(1, None, "d", "2024-01-02T03:04:05Z", None, "en"), (2, "t", None, "2024-01-02T03:04:05Z", "n", "en")],
                                "article_id long, title string, description string, publishedAt string, name string, language string")
    a = ingest.articles_good(ingest.typed_articles(raw.withColumn("source", F.struct("name"))))
    from brieflane.operators import report as rp
    lines = a.orderBy("article_id").select(rp.news_line(F.col("title"), F.col("source")), rp.news_line_plain(F.col("title"), F.col("description"))).collect()
    assert [tuple(r) for r in lines] == [("- No title (Source: Unknown)", "- : d"), ("- t (Source: n)", "- t: ")]
    d = {r.article_id: r for r in ingest.article_defaults(a).collect()}
    assert d[1].title == "" and d[1].source == "" and d[2].description == ""
