"""Plan-shape checks: the scale properties the design relies on."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from piisift.plans.catalog import REGISTRY

SF = "/root/testdata/sf0.001"
# streams have no batch plan; these run whole jobs before their plan exists
RUN_FIRST = {"stream_findings", "stream_risk_counts", "stream_recent", "stream_files", "stream_file_status",
             "run_lifecycle", "reports_read_back"}


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - RUN_FIRST))
def test_no_cross_products(spark, name):
    p = plan_of(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_run_summary_aggregates_map_side(spark):
    p = plan_of(E.queries()["run_summary"](spark, SF))
    assert "partial_count" in p and "partial_sum" in p
    assert p.count("Exchange hashpartitioning") == 1


def test_recent_is_top_n(spark):
    p = plan_of(E.queries()["findings_recent"](spark, SF))
    assert "TakeOrderedAndProject(limit=200" in p


def test_projection_reaches_the_scan(spark):
    p = plan_of(E.queries()["classify_risk"](spark, SF))
    assert "ReadSchema: struct<text:string>" in p  # documents: only the text column is read
