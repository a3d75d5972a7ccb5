"""Every registered query against its SQL, on the smallest tables; the rest must give rows."""

import pytest

import wayframe.checks.all  # noqa: F401
from tests.compare import database, difference
from tests.conftest import FOLDER
from tests.plans import unwanted
from wayframe.checks.registry import ORACLES, QUERIES

# Whole route builds take minutes; test_stitch runs them on known networks.
LONG = {"D1_route_build", "D12_overlay_routes"}
LARGER = FOLDER.replace("0.001", "0.01")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    why = difference(spark, con, name, FOLDER)
    if why == "both sides are empty":  # nothing to find in the smallest tables
        why = difference(spark, database(LARGER), name, LARGER)
    assert why is None, why


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - LONG))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert not unwanted(df)
    assert not df.isEmpty() or not QUERIES[name](spark, LARGER).isEmpty()


@pytest.mark.parametrize("name", ["A1_A2_section_measures", "A3_J9_route_figures", "A6_series_median", "J1_nearest_line", "J6_polygon_of_point", "J20_ranked_facilities", "J22_number_verdicts", "O1_numeric_order", "W1_route_ids", "P20_designations"])
def test_no_unwanted_operators(spark, name):
    assert not unwanted(QUERIES[name](spark, FOLDER))


def test_scan_reads_only_what_it_needs(spark):
    plan = QUERIES["A34_drawn_jurisdictions"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint>" in plan
    plan = QUERIES["A25_section_lengths"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,O)" in plan
