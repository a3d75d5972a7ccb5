"""The vertices of road fragments: the same rows as by SQL, from one reading of the orders."""

import struct

import pytest

from tests.conftest import FOLDER
from wayframe.checks.geometry import fragments
from wayframe.checks.inputs import INPUTS
from wayframe.checks.registry import Tables
from wayframe.operators.lines import BLOCK_VERTICES, to_fragments

KEYS = {"vertices": ["seg_id", "i"], "stations": ["station"]}


@pytest.mark.parametrize("name", KEYS)
def test_places_are_those_of_the_sql_to_the_last_bit(spark, con, name):
    rows = lambda found: sorted((*key, struct.pack("dd", lon, lat)) for *key, lon, lat in found)
    cols = [*KEYS[name], "lon", "lat"]
    theirs = con.execute(f"SELECT {', '.join(cols)} FROM ({INPUTS[name]})").fetchall()
    assert rows(getattr(Tables(spark, FOLDER), name).select(*cols).collect()) == rows(theirs)


def test_fragments_read_the_orders_once(spark):
    plan = fragments(Tables(spark, FOLDER))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_blocks_of_a_long_line_meet_at_a_vertex(spark):
    n = 2 * BLOCK_VERTICES + 1
    line = spark.range(n).selectExpr("1 AS line", "id AS seq", "CAST(id AS DOUBLE) AS lon", "0D AS lat")
    blocks = {r["block"]: [c["lon"] for c in r["coords"]] for r in to_fragments(line, ["line"]).collect()}
    assert blocks == {k: [float(i) for i in range(k * BLOCK_VERTICES, (k + 1) * BLOCK_VERTICES + 1)] for k in (0, 1)}
