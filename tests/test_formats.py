"""The JSON round trip holds every point."""

from cellgrove.plans import catalog
from cellgrove.sources.views import Views

SMALL = "/root/testdata/sf0.001"


def test_all_points_go_out_and_in(spark):
    got = {tuple(r) for r in catalog.QUERIES["point_formats"](spark, SMALL).collect()}
    assert got == {(r["event_id"], r["event_id"], r["source"]) for r in Views(spark, SMALL).points().collect()}
    assert len(got) == 1000
