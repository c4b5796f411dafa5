"""Every query against its SQL, over whole tables at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from auditweave.plans.registry import QUERIES
from compare import differences, oracle_connection

SF = "/root/testdata/sf0.001"
ORACLES = {name: sql for name, sql in entry_points.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, oracle, name):
    assert differences(entry_points.queries()[name](spark, SF), oracle, ORACLES[name]) == []


def test_every_audit_query_has_sql():
    assert set(QUERIES) <= set(ORACLES)


@pytest.mark.parametrize("name", ["dep_findings", "evidence_osv", "evidence_index", "summary_json", "report_markdown", "top_security_risks", "repo_profile"])
def test_building_a_query_reads_schemas_only(spark, name):
    """A job may open a file's footer; none computes rows."""
    group = f"build-{name}"
    spark.sparkContext.setJobGroup(group, name)
    try:
        entry_points.queries()[name](spark, SF)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert all(s is None or s.numTasks == 1 for s in stages) and len(tracker.getJobIdsForGroup(group)) <= 20


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0
