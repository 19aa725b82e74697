"""Building a query starts no job but the reading of schemas."""

import os

import pytest

import __spark_entry__ as entry
from tideglass.registry import QUERIES

SF_DIR = os.environ.get("TIDEGLASS_SF_DIR", "/root/testdata/sf0.001")
#: Queries that drain a stream, write a table or go round by round have jobs of their own before their result can be read.
RUN = ("stream_", "sink_", "graph_", "isolate_", "ml_", "trace_", "signal_use_of_funds")


def jobs(spark, build):
    sc, group = spark.sparkContext, f"build-{build}"
    sc.setJobGroup(group, "")
    try:
        QUERIES[build](spark, SF_DIR)
        tracker = sc.statusTracker()
        stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
        return [n for n in (tracker.getStageInfo(s).name for s in stages) if not n.startswith("parquet at")]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables are not here")
@pytest.mark.parametrize("hot", [None, "15"])
def test_no_job_while_building(spark, hot):
    assert set(QUERIES) <= set(entry.queries())
    if hot:
        spark.conf.set("spark.tideglass.hotRows", hot)
    names = [n for n in sorted(QUERIES) if not n.startswith(RUN)]
    every = 1 if os.environ.get("TIDEGLASS_ALL") else 7 if hot else 4
    try:
        started = {n: found for n in names[::every] if (found := jobs(spark, n))}
    finally:
        spark.conf.unset("spark.tideglass.hotRows")
    assert started == {}
