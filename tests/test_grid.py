"""Pure-Python pieces of model selection: seeded grid sampling and parameter mapping."""

from pitchlens.plans import model as mdl


def test_sample_grid_seeded_distinct_and_in_grid():
    a = mdl.sample_grid(mdl.GRID_UO, 20)
    b = mdl.sample_grid(mdl.GRID_UO, 20)
    assert a == b                                   # one seeded draw, repeatable
    assert len({tuple(sorted(d.items())) for d in a}) == 20   # without replacement
    for d in a:
        assert all(d[k] in mdl.GRID_UO[k] for k in mdl.GRID_UO)
    assert mdl.grid_size(mdl.GRID_UO) == 25600
    assert mdl.grid_size(mdl.GRID_EF) == 48000


def test_gbt_param_mapping():
    p = mdl.gbt_params({"learning_rate": 0.1, "n_estimators": 300, "max_depth": 4, "subsample": 0.8,
                        "min_child_weight": 5, "gamma": 0.5, "colsample_bytree": 1.0})
    assert p == {"stepSize": 0.1, "maxIter": 300, "maxDepth": 4, "subsamplingRate": 0.8,
                 "minInstancesPerNode": 5, "minInfoGain": 0.005, "featureSubsetStrategy": "all"}
    assert mdl.gbt_params({"colsample_bytree": 0.6})["featureSubsetStrategy"] == "0.6"
