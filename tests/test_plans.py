"""Plan-shape checks: pruning and pushdown reach the scans, and no operator
falls back to a cartesian product or an all-pairs nested-loop join."""

from pyspark.sql import functions as F

from territoria.operators import panel as pn
from territoria.operators import places as pl
from territoria.operators import priority as pr
from territoria.sources import roles as rl
from territoria.sources import tables as tb

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_registration_scan_is_pruned(spark):
    df = pn.panel_aggregate(tb.registrations(spark, SF))
    plan = plan_of(df)
    assert "l_shipdate" not in plan and "l_returnflag" not in plan and "o_totalprice" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_supplier_is_an_asset(spark):
    assert tb.assets(spark, SF).count() == tb.read_table(spark, SF, "supplier").count() > 0


def test_scaling_uses_scalar_subquery_not_join(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0)], "k int, v double")
    plan = plan_of(pr.min_max_scale(df, "v", "s"))
    assert "Subquery" in plan and "Join" not in plan


def test_nearest_lookup_has_no_all_pairs_join(spark):
    out = pl.nearest_lookup(rl.embedding_queries(spark, SF), rl.embedding_reference(spark, SF),
                            "vec_id", "x", "y", "x", "y", "valor", "orden")
    plan = plan_of(out)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert out.count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_streaming_daily_panel(spark, tmp_path):
    from territoria.streaming.panel_stream import daily_event_panel_stream
    out = daily_event_panel_stream(spark, SF, "events.parquet", str(tmp_path / "out"), str(tmp_path / "ckpt"))
    ev = spark.read.parquet(f"{SF}/events.parquet")
    assert out.agg(F.sum("eventos")).first()[0] == ev.count()
