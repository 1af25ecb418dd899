import inspect

import pytest

from tallywood.operators import extrapolate, histogram
from tallywood.plans import catalog

SF = "/root/testdata/sf0.01"
HISTS = {"quick_extrap_words": catalog.hist_words, "bootstrap_curve_ci": catalog.hist_words, "gc_extrap_quick": catalog.coverage_hist}


@pytest.mark.parametrize("name", HISTS)
def test_curves_reach_far_beyond_the_sample(spark, name):
    total = histogram.summary(HISTS[name](spark, SF)).first().total
    rows = catalog.QUERIES[name](spark, SF).collect()
    if rows[0].asDict().get("status", "ok") == "ok":
        assert min(r.x for r in rows) < total and max(r.x for r in rows) > 900 * total
    assert name != "bootstrap_curve_ci" or len(rows) > 1000


def test_every_sample_reaches_beyond_its_own_total(spark):
    totals = {r["sample"]: r.total for r in histogram.summary(catalog._keyed(spark, SF), ["sample"]).collect()}
    ends = {}
    for r in catalog.quick_extrap_samples(spark, SF).where("status = 'ok'").collect():
        ends[r["sample"]] = max(ends.get(r["sample"], 0), r.x)
    assert ends and all(900 * totals[s] < end < 1000 * totals[s] for s, end in ends.items())


@pytest.mark.parametrize("name, made", [("bootstrap_curve_ci", "lc_extrap"), ("pop_size_words", "pop_size")])
def test_all_resamples_are_made(spark, monkeypatch, name, made):
    asked = {}
    monkeypatch.setattr(extrapolate, made, lambda *a, **options: asked.update(options))
    catalog.QUERIES[name](spark, SF)
    assert asked.get("replicates", 100) == inspect.signature(extrapolate.bootstrap_curves).parameters["replicates"].default == 100
