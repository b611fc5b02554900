"""The registered model queries fit with published parameters; the search has 20 trials in 5 folds."""

import pytest

import __spark_entry__ as entry_mod
from pitchlens.plans import extra  # noqa: F401
from pitchlens.plans import model as mdl
from pitchlens.plans import search as srch


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", ["fit_uo", "fit_ef", "fit_result", "score_uo", "score_ef", "score_result", "cv_uo", "cv_ef",
                                  "model_roundtrip", "live_predictions_uo", "live_predictions_ef"])
def test_published_trees(spark, sf, monkeypatch, name):
    def boost(table, features, label, classes, fits, path, part=None, **how):
        raise Seen(fits)
    monkeypatch.setattr(mdl.boost, "boost", boost)
    with pytest.raises(Seen) as e:
        entry_mod.queries()[name](spark, sf)
    for fit in e.value.args[0]:
        if name.endswith("result"):  # as the source fixes it
            assert fit.params == {"n_estimators": 2000}
        else:
            grid = mdl.GRID_UO if name.endswith("uo") else mdl.GRID_EF
            assert all(fit.params[k] in values for k, values in grid.items())
    assert len(e.value.args[0]) == (5 if name.startswith("cv_") else 1)


def test_published_search(spark, sf, monkeypatch):
    def search(snapshots, mask, grid, task, decision, trials, cv):
        raise Seen(grid, trials, cv)
    monkeypatch.setattr(srch, "random_search", search)
    with pytest.raises(Seen) as e:
        entry_mod.queries()["random_search_full"](spark, sf)
    assert e.value.args == (mdl.GRID_UO, 20, 5)
