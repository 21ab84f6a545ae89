"""The shape of physical plans: what must not appear, and what must."""

import re

import pytest

from workweave.operators import accounts as A
from workweave.operators import pages as P
from workweave.plans import registry
from workweave.sources import plan_document as D
from workweave.sources.fixtures import Plan

QUERIES = registry()
CORE = ["f1_occupancy", "g1_conflict_people", "e8_screening", "f3_accounts", "j13_merge", "j17_apply_changes",
        "e8_screened_people", "c1_clean_departments", "e12_cache_lookup", "g13_attempts", "e6_conflicted_entries"]
# elements are found by a fold over tags, in Arrow batches; all else stays in the JVM
FOLDED = ["k21_preset_job", "k13_repeated_records", "k6_tables_nested"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CORE)
def test_no_cross_joins_and_no_python(spark, small, name):
    plan = _plan(QUERIES[name](spark, small))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas"):
        assert unwanted not in plan


@pytest.mark.parametrize("name", FOLDED)
def test_tags_are_folded_in_arrow_batches(spark, small, name):
    plan = _plan(QUERIES[name](spark, small))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "InPandas", "MapInArrow"):
        assert unwanted not in plan
    assert "ArrowEvalPython" in plan


def test_plan_documents_are_cleaned_in_their_row(spark):
    data = spark.createDataFrame([("a", '{"years": {"2024": {"departments": [{"id": "x"}]}}}')], "plan_id string, data string")
    plan = _plan(D.clean_departments(D.years(D.parse_plans(data))))
    assert "Exchange" not in plan and "Join" not in plan


def test_workdays_need_no_shuffle(spark, small):
    p = Plan(spark, small)
    p.calendar  # settled beforehand
    plan = _plan(A.entry_workdays(p.absence, p.calendar).select("absence_id", "year", "workdays"))
    left, _, _ = plan.partition("BroadcastExchange")
    assert "Exchange hashpartitioning" not in left


def test_many_presets_read_the_pages_once(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    plan = _plan(P.extract(pages, list(P.PRESETS)))
    assert plan.count("FileScan parquet") == 1 and "Exchange" not in plan


def test_only_needed_columns_are_read(spark, small):
    plan = _plan(QUERIES["f18_entries_per_person"](spark, small))
    orders = [s for s in re.findall(r"ReadSchema: (struct<[^>]*>)", plan) if "o_custkey" in s]
    assert orders == ["struct<o_custkey:bigint>"]
    plan = _plan(QUERIES["c2_countable"](spark, small))
    assert "o_totalprice" not in plan and "Exchange" not in plan


def test_merge_shuffles_once(spark, small):
    plan = _plan(QUERIES["j13_merge"](spark, small))
    assert plan.count("Exchange hashpartitioning") == 1


def test_equal_records_are_combined_before_the_shuffle(spark, small):
    plan = _plan(QUERIES["i2_distinct_records"](spark, small))
    above, _, below = plan.partition("Exchange hashpartitioning")
    assert "partial_min_by" in below and "partial_min_by" not in above


@pytest.mark.parametrize("name", ["f14_empty_shares", "k18_quality_gate", "c14_remove_records", "h11_summary_sample"])
def test_pages_are_parsed_once(spark, small, name):
    plan = _plan(QUERIES[name](spark, small))
    markup = [s for s in re.findall(r"ReadSchema: (struct<[^>]*>)", plan) if "html" in s]
    assert len(markup) <= 1 and plan.count("ArrowEvalPython") <= 2


def test_records_are_counted_before_the_shuffle(spark, small):
    plan = _plan(QUERIES["f12_job_summary"](spark, small))
    generated = plan.index("Generate")
    shuffled = plan.rindex("Exchange hashpartitioning(page_id", 0, generated)
    assert "partial_count" in plan[shuffled:generated]
