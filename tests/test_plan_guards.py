"""Guards over every registered query's physical plan: no cartesian products and no
Python UDF evaluation (all work stays in the JVM)."""

import pytest

from conftest import SF_SMALL

from brieflane.plans import api, registry
from brieflane.sources import fixtures as fx

# These run jobs while they are built (streams, sinks, model fit); their outputs are checked elsewhere.
BUILT_BY_RUNNING = {"stream_posts_daily", "stream_top_posts", "stream_windowed_counts", "stream_dead_letters",
                    "quality_classifier", "features_sink", "report_export"}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - BUILT_BY_RUNNING))
def test_plan_has_no_cartesian_product_or_python_udf(spark, name):
    df = registry.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "PythonUDF"):
        assert banned not in plan, f"{name}: {banned}"


def test_analyze_markets_entry_point(spark):
    ents = fx.analyzed_entities(spark)
    rows = {r.entity: r for r in api.analyze_markets(ents, fx.config_table(spark),
                                                      fx.chart_responses(spark, SF_SMALL)).collect()}
    assert set(rows) == {e for e, _ in fx.ANALYZED_ENTITIES}
    assert rows["tion"].n_symbols == 6 and rows["sch"].n_symbols == 1
    assert not rows["iron"].data_available and rows["iron"].error.endswith("VALE, BHP, RIO, MT, CLF")
