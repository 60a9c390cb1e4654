"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to a `noop` sink (full execution, nothing collected), $BENCH_RUNS times
(default 3) after one untimed warm-up pass on sf0.001; the median is reported. Prints
ONE JSON line: {"metric", "value" (sum of medians, seconds), "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "top_posts_engagement", "ingest_envelope_posts", "subreddit_discovery", "news_boolean_query",
    "top_videos", "tfidf_posts", "tfidf_transcripts", "market_report", "entity_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from brieflane.plans import registry
    from brieflane.operators import text as tx
    from brieflane.plans import indexes
    from brieflane.session import build_session, sweep
    from brieflane.streaming import posts_stream
    from brieflane.sources import fixtures as fx

    extra = {"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")}
    if os.environ.get("BENCH_EVENT_LOG_DIR"):  # stage/task times without the UI
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG_DIR"]})
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, extra=extra)
    qs = registry.queries()
    # Warm the JVM (class loading, JIT, codegen) by running every headline query once on
    # the smallest tables; not timed, so the timings below are steady-state.
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for name in HEADLINE:
            qs[name](spark, warm).write.format("noop").mode("overwrite").save()

    runs = int(os.environ.get("BENCH_RUNS", "3"))

    def timed(build) -> float:
        """Median wall time of ``runs`` full executions (plan built fresh each time)."""
        samples = []
        for _ in range(runs):
            t0 = time.time()
            build().write.format("noop").mode("overwrite").save()
            samples.append(time.time() - t0)
        return round(statistics.median(samples), 3)

    times: dict[str, float] = {}
    for name in HEADLINE:
        times[name] = timed(lambda: qs[name](spark, sf_dir))

    times["tfidf_documents"] = timed(
        lambda: tx.tfidf(fx.read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text"))

    # The word indexes that discovery and news queries read, built anew (the first query that needs
    # one builds it, so its median above is that of reading it).
    t0 = time.time()
    for name, build in (("posts", indexes.of_posts), ("articles", indexes.of_articles)):
        build(spark, sf_dir, posts_stream.shared_folder(spark, f"bench-index-{name}"))
    times["word_index_build"] = round(time.time() - t0, 3)
    sweep(spark)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
