"""Every registered query runs; those with check SQL agree with it on the smallest tables."""

import pytest
from compare import connect, differences

from pollmill.plans import catalog

SF = "/root/testdata/sf0.001"
# Iterative model grids take minutes; their parts are tested on their own.
SLOW = {"cluster_grid", "preprocess_compare", "stability_resample", "stability_summary", "person_consistency", "soft_segment_summary", "bootstrap_indirect"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(catalog.checks()))
def test_check(spark, con, key):
    assert differences(catalog.queries()[key](spark, SF), con, catalog.checks()[key]) == ""


@pytest.mark.parametrize("key", sorted(set(catalog.queries()) - set(catalog.checks()) - SLOW))
def test_runs(spark, key):
    df = catalog.queries()[key](spark, SF)
    assert len(df.columns) > 0 and df.limit(1).count() == 1
