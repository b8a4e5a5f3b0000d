"""Labelled graphs are drawn from pairs that are found once."""

import os

import pytest

from undertow import queries as Q
from undertow.sources import projections as P

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables here")
def test_crates_read_stored_pairs(spark):
    found = Q._labelled(spark, SF)
    for df, sql in ((found.nodes, P.CRATE_NODES), (found.edges, P.CRATE_EDGES)):
        assert "l_orderkey" not in df._jdf.queryExecution().optimizedPlan().toString()
        want = P.select(spark, SF, sql)
        shared = [c for c in want.columns if c in df.columns]
        assert df.count() and sorted(map(repr, df.select(*shared).collect())) == sorted(map(repr, want.select(*shared).collect()))
