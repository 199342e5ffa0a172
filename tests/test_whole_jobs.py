"""Queries over all rows see what those over a part of them cannot."""

from __future__ import annotations

from pathlib import Path

import pytest

from tonelake import catalog

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the given tables are not here")


def test_all_parts_are_devices(spark):
    got = {r.selector: (r.device_id, r.error) for r in catalog.queries()["device_lookup_all"](spark, SF).collect()}
    last = spark.read.parquet(f"{SF}/part.parquet").where("p_partkey % 50 = 0 AND p_partkey >= 200").count()
    assert last > 0 and sum(k.isdecimal() and int(k) >= 200 and v == (k, None) for k, v in got.items()) == last
    assert any(k.endswith(" X") and v == (None, "ambiguous") for k, v in got.items()) and got["none"] == (None, "not_found")


def test_grids_are_read_to_their_last_sample(spark):
    got = catalog.queries()["increasing_grids_all"](spark, SF).collect()
    assert not any(r.increasing for r in got if r.take_id % 3) and any(r.increasing for r in got if r.take_id % 3 == 0)


def test_all_measurements_are_judged(spark):
    got = catalog.queries()["solvability_all"](spark, SF).collect()
    cells = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_orderkey % 50 AS a", "l_partkey % 7 AS b").distinct().count()
    assert len(got) == cells and {r.verdict for r in got} == {"insufficient_ranges", "degenerate_geometry", "mirror_ambiguous", "solvable"}
