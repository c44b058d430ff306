"""The eddy drift goes forward and back: what is left is the step error."""

from test_oracles import SF

from tidewatch.plans import catalog


def test_drift_comes_back(spark):
    moved = [r["moved_km"] for r in catalog.queries()["d03_eddy_drift"](spark, SF).collect()]
    assert moved and max(moved) < 0.05
