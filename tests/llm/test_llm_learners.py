"""The byte network against a plain convolution and numeric gradients; language ID of an empty table with a model."""

import numpy as np
import pytest

from visiflow.llm import langid


@pytest.fixture()
def network():
    net = langid.ByteCNN(["a", "b", "c"], filters=3, seed=1)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    rng = np.random.default_rng(2)
    net.params["bias"] = rng.normal(0, 0.1, net.params["bias"].shape)
    return net, rng.integers(0, 256, (5, langid.LENGTH)).astype(np.uint8), rng.integers(0, 3, 5)


def plain_probabilities(net, x):
    out = []
    for row in x:
        hidden = []
        for w in langid.WIDTHS:
            for f in range(net.filters):
                hidden.append(max(sum(net.params[f"w{w}"][j, row[p + j], f] for j in range(w)) for p in range(len(row) - w + 1)))
        hidden = np.maximum(np.array(hidden) + net.params["bias"], 0)
        z = np.exp(hidden @ net.params["out"] + net.params["out_bias"])
        out.append(z / z.sum())
    return np.array(out)


def test_network_equals_a_plain_convolution(network):
    net, x, _ = network
    assert np.allclose(net.probabilities(x), plain_probabilities(net, x), atol=1e-9)


def test_gradients_equal_numeric_ones(network):
    net, x, y = network
    grads = net._gradients(x, y)
    loss = lambda: -np.log(plain_probabilities(net, x)[np.arange(len(y)), y]).mean()
    rng = np.random.default_rng(3)
    for name, g in grads.items():
        p = net.params[name]
        touched = np.argwhere(np.abs(g) > 1e-6)
        for at in [tuple(touched[k]) for k in rng.choice(len(touched), min(4, len(touched)), replace=False)]:
            old, step = p[at], 1e-5
            p[at] = old + step
            up = loss()
            p[at] = old - step
            down = loss()
            p[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-6), (name, at)


def test_ties_and_an_empty_table_with_a_model(spark):
    docs = spark.createDataFrame([(k, t, g) for k, (t, g) in enumerate([("der hund und die katze " * 5, "de"), ("the dog and the cat " * 5, "en")] * 8)],
                                 "doc_id long, text string, lang string")
    model = langid.fit_languages(docs)
    assert langid.predict_languages(docs.limit(0), model).count() == 0
    twice = spark.createDataFrame([(1, "the dog and the cat"), (1, "the dog and the cat"), (2, "123"), (3, None)], "doc_id long, text string")
    rows = sorted((r.doc_id, r.lang_pred, r.score) for r in langid.predict_languages(twice, model).collect())
    assert rows[0] == rows[1] and [r[1] for r in rows[2:]] == ["und", "und"]
