"""Shape of the physical plans."""

import pytest

from marquee import rating_stability, run, top_share, variants
from marquee.operators.credits import explode_credits
from marquee.operators.ranks import nearest_rank, quantiles, values_at_ranks
from marquee.scratch import written

PYTHON_STEPS = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups")


@pytest.fixture(scope="module")
def stored(titles):
    return written(titles)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", variants())
def test_no_python_and_no_cross_join(stored, name):
    plan = plan_of(run(name, stored))
    for step in (*PYTHON_STEPS, "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert step not in plan


def test_top_share_limits_rows_before_the_shuffle(stored):
    plan = plan_of(top_share(stored))
    assert plan.count("WindowGroupLimit") == 2
    assert "Join" not in plan
    assert plan.count("GreaterThan(revenue,0.0)") == 2


def test_only_needed_columns_are_read(stored):
    plan = plan_of(rating_stability(stored))
    schema = plan[plan.index("ReadSchema") :]
    assert "genres:array<struct<id:bigint>>" in schema
    for name in ("original_title", "companies", "revenue", "budget", "name"):
        assert name not in schema


def test_capped_queries_use_top_k(stored):
    for name in ("q3", "q4"):
        assert "TakeOrderedAndProject" in plan_of(run(name, stored))


def test_exploding_filters_first_and_drops_the_list(stored):
    plan = plan_of(explode_credits(stored).where("revenue > 0"))
    generate = plan[plan.index("Generate") :]
    assert "(revenue" in generate[generate.index("Filter") :]
    kept = generate.splitlines()[0].split("[")[1].split("]")[0]
    assert "n_companies" in kept and " companies" not in f" {kept}".replace("n_companies", "")


def test_rank_windows_never_span_a_group(stored):
    found = values_at_ranks(stored, ["period"], "popularity", {0.9: nearest_rank(0.9)})
    plan = plan_of(found)
    window = plan[plan.index("Window ") :].splitlines()[0]
    assert "_slot" in window.split("],")[1]


def test_quantile_summaries_meet_in_two_steps(stored):
    plan = plan_of(quantiles(stored, ["period"], {"popularity": [0.5]}, 1000))
    spread = [line for line in plan.splitlines() if "hashpartitioning(period" in line]
    assert len(spread) == 2 and "kll_merge_agg_double" in plan
    # The lower shuffle is by the period and one of the mergers.
    assert spread[1].split("hashpartitioning(")[1].split(")")[0].count(",") == 2


@pytest.mark.parametrize("name, most", [("q2", 21), ("roi", 12), ("q4", 14), ("hg", 14), ("q1", 0), ("q5", 0)])
def test_jobs_before_the_result(spark, stored, name, most):
    """How many jobs run until the caller has a frame."""
    context = spark.sparkContext
    context.setJobGroup(f"jobs of {name}", "")
    run(name, stored)
    jobs = context.statusTracker().getJobIdsForGroup(f"jobs of {name}")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= most, len(jobs)
