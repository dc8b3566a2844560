"""Gradients, training and the missing model."""

import numpy as np
import pytest

from fluxwarden.operators import models as M


def vectors(n, seed=5):
    return np.random.default_rng(seed).uniform(0, 1, (n, 45))


def frame(spark, data):
    rows = [(d, i, [float(x) for x in v]) for d, m in data.items() for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "device_mac string, vec_seq long, vector array<double>").repartition(4)


def start(spark, names):
    return M.flat_models(M.layer_table(spark.createDataFrame([(n,) for n in names], "device_mac string")))


def test_gradient_matches_differences(spark):
    params = np.array(start(spark, ["a"]).first().params)
    x = vectors(5)
    g = M.gradients(M.split_layers(params), x)
    rng = np.random.default_rng(1)
    for k in rng.choice(M.PARAMETERS, 25, replace=False):
        up, down = params.copy(), params.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        numeric = (M.reconstruction_error(M.split_layers(up), x).mean() - M.reconstruction_error(M.split_layers(down), x).mean()) / 2e-6
        assert g[k] == pytest.approx(numeric, abs=1e-6)


def test_training_equals_a_plain_loop(spark):
    data = {"a": vectors(50), "b": vectors(33, 6)}
    models = start(spark, data)
    got = {r.device_mac: r for r in M.train_models(frame(spark, data), models).collect()}
    initial = models.first().params
    for name, x in data.items():
        state = M.Adam(initial, [], [], 0)
        for _ in range(M.EPOCHS):
            for i in range(0, len(x), M.BATCH):
                state.step(x[i : i + M.BATCH])
        scores = M.reconstruction_error(M.split_layers(state.params), x)
        hard = x[scores > np.sort(scores)[int(len(x) * 0.6)]]
        for i in range(0, len(hard), M.BATCH):
            state.step(hard[i : i + M.BATCH])
        assert got[name].steps == state.steps
        np.testing.assert_allclose(got[name].params, state.params, atol=1e-9)


def test_scores_do_not_depend_on_parts_and_need_a_model(spark):
    data = {"a": vectors(60), "b": vectors(20, 8), "none": vectors(5, 9)}
    models = start(spark, ["a", "b"])
    for bits in (2, 16):
        got = {(r.device_mac, r.vec_seq): r.score for r in M.score_windows(frame(spark, data), models, bits).collect()}
        layers = M.split_layers(np.array(models.first().params))
        for name, x in data.items():
            for i, s in enumerate(M.reconstruction_error(layers, x)):
                value = got[name, i]
                assert (value is None or np.isnan(value)) if name == "none" else value == pytest.approx(s)
