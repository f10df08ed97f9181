"""What the planner makes of headline queries: Python runs once, ranks need no shuffle, scans read what they use."""

import re

import pytest

from sparkfold import plans

QUERIES = plans.queries()


def plan(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["minhash_signatures", "lsh_bands", "doc_entropy", "codec_roundtrip_zstd", "strategy_ranked", "strategy_candidates"])
def test_python_runs_once(spark, sf_dir, name):
    assert len(re.findall(r"ArrowEvalPython|MapInArrow|PythonMapInArrow", plan(spark, sf_dir, name))) == 1


@pytest.mark.parametrize("name", ["strategy_ranked", "strategy_candidates", "strategy_hints", "doc_entropy", "doc_block_entropy_stats", "cas_recipes", "window_split", "page_components"])
def test_no_shuffle(spark, sf_dir, name):
    p = plan(spark, sf_dir, name)
    assert "Exchange" not in p and p.count("FileScan parquet") == 1


def test_scans_read_what_they_use(spark, sf_dir):
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(spark, sf_dir, "doc_entropy")
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan(spark, sf_dir, "star_cube")
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan(spark, sf_dir, "int_delta") or "Checkpoint" in plan(spark, sf_dir, "int_delta") or "ExistingRDD" in plan(spark, sf_dir, "int_delta")
