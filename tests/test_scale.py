"""Plans: what reaches the scan, what is shuffled, and how hot keys are split."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from seed import CFG

from plantcast import BackwardPlan, ForwardPlan, Sources
from plantcast.operators import demand, inventory, materials
from plantcast.sources.star import STAR_CONFIG, from_star

SF = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    """Adaptive plan after the query has run."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    return execution.executedPlan().toString().split("Initial Plan")[0]


@pytest.fixture
def backward(spark):
    return BackwardPlan(from_star(spark, SF), STAR_CONFIG)


@pytest.fixture
def forward(spark):
    return ForwardPlan(from_star(spark, SF), STAR_CONFIG)


def test_filters_and_columns_reach_the_scan(settings, backward):
    settings(spark__sql__maxMetadataStringLength="1000")
    plan = physical(backward.order_lines)
    assert "GreaterThanOrEqual(o_orderdate,2001-05-02T10:00)" in plan
    assert "struct<o_orderkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz>" in plan
    assert "struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan
    plan = physical(backward.mrp_plan)
    assert "GreaterThanOrEqual(l_shipdate,2001-06-02T00:00), LessThan(l_shipdate,2001-06-09T00:00)" in plan
    assert "GreaterThanOrEqual(ts,2024-01-30T00:00)" in physical(backward.reading_health)


def test_no_cross_joins_and_no_python(backward, forward):
    for plan in (backward, forward):
        for name in ("mrp_plan", "po_summary", "kpis", "snapshot", "plan_totals", "capacity_plan", "demand_compare"):
            text = physical(getattr(plan, name))
            assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|ArrowEval|BatchEval|MapInPandas", text), name


def test_proposals_do_not_read_telemetry(backward):
    assert "user_id" not in physical(backward.po_summary)
    assert "user_id" in physical(backward.kpis)


def test_shuffles_of_the_plan(settings, backward):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    shuffles = re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, ", physical(backward.part_outlook))
    # orders and items by order, products by product, both join sides by product key, bill header
    # and detail by bill, and part demand, stock and incoming by part: projection, plan and
    # summary add none of their own.
    assert sorted(shuffles) == sorted(
        ["order_id", "order_id", "product_id", "product_key", "product_key", "bom_id", "bom_id"] + ["part_no"] * 3
    )


def test_profile_aggregates_before_the_shuffle(backward):
    text = physical(backward.profile)
    assert text.count("Exchange hashpartitioning(product_id") == 1
    assert re.search(r"Exchange hashpartitioning\(product_id.*\n.*partial_sum", text)


def hot_settings(settings):
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20000",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20000",
        spark__sql__shuffle__partitions="8",
    )


def test_hot_order_is_split(spark, settings):
    """One order holds a third of all lines."""
    hot_settings(settings)
    moment = F.lit("2024-01-30 09:00:00").cast("timestamp_ntz")
    orders = spark.range(2000).select(
        F.col("id").cast("int").alias("id"), moment.alias("created_at"), F.lit("completed").alias("status")
    )
    items = spark.range(0, 60000, 1, 8).select(
        F.expr("CAST(CASE WHEN id % 3 = 0 THEN 7 ELSE id % 2000 END AS int) AS order_id"),
        F.expr("CAST(xxhash64(id) % 5000 AS int) AS product_id"),
        F.lit(1).alias("quantity"),
    )
    lines = demand.order_lines(orders, items, CFG)
    assert "skew=true" in final_plan(demand.order_history(lines))
    assert demand.order_history(lines).agg(F.sum("qty")).first()[0] == 60000


def test_hot_product_is_split(spark, settings):
    """One product owns a third of all bill lines; the requirement stays whole."""
    hot_settings(settings)
    lines = spark.range(0, 60000, 1, 8).select(
        F.expr("CAST(CASE WHEN id % 3 = 0 THEN 7 ELSE id % 2000 END AS bigint) AS product_id"),
        F.expr("concat('PART-', xxhash64(id) % 10000) AS part_no"),
        F.lit(1.0).alias("bom_qty"),
    )
    history = spark.range(0, 2000).select(
        F.lit(CFG.history_end).alias("order_date"), F.col("id").alias("product_id"), F.lit(150).alias("qty")
    )
    week = replace(CFG, lookback_days=1, forecast_days=2)
    profile = demand.demand_profile(history, week)
    products = profile.selectExpr("product_id", "array(2L, 3L) AS demand", "array(1L, 2L) AS output")
    need = materials.part_demand(products, lines, week)
    assert "skew=true" in final_plan(need)
    totals = need.agg(F.expr("sum(get(part_demand, 0))"), F.expr("sum(get(output_need, 1))")).first()
    assert tuple(totals) == (120000.0, 120000.0)


def test_projection_inherits_the_part_partitioning(spark, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    days = spark.range(100).selectExpr(
        "concat('P', id) AS part_no", "10.0D AS stock_qty", "5.0D AS safety_qty",
        "array_repeat(1.0D, 7) AS part_demand", "array_repeat(1.0D, 7) AS output_need", "array_repeat(0.0D, 7) AS incoming",
    )
    grid = inventory.sim_grid(days.groupBy("part_no").agg(*[F.first(c).alias(c) for c in days.columns[1:]]), CFG)
    plan = inventory.mrp_plan(inventory.inventory_projection(grid), CFG)
    assert physical(plan).count("Exchange") == 1


def test_snapshot_lists_are_cut_in_every_task(backward):
    """Each task keeps the head of both lists, also beyond the limit up to which Spark cuts windows."""
    cfg = replace(backward.cfg, risk_limit=2000)
    text = physical(BackwardPlan(backward.sources, cfg).snapshot)
    assert "TakeOrderedAndProject(limit=2000" in text and "ROW_NUMBER" not in text.upper()


def test_sources_read_only_what_is_used(spark):
    read = []

    def table(name):
        read.append(name)
        return getattr(from_star(spark, SF), name)

    names = from_star(spark, SF)._tables
    src = Sources(**{n: (lambda n=n: table(n)) for n in names})
    BackwardPlan(src, STAR_CONFIG).capacity_factor.first()
    assert read == ["machine_data"]
    with pytest.raises(AttributeError):
        _ = src.nothing
    with pytest.raises(TypeError):
        Sources(orders=None)
