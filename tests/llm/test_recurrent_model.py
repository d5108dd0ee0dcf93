"""The recurrent model against plain loops and numeric gradients."""

import numpy as np

from larkspur.llm import gru

COUNTS = np.array([6, 9, 7, 5, 4, 3, 2, 2, 1, 1, 30.0])


def model(dtype=np.float64):
    shape = gru.Shape(len(COUNTS), 4, gru.class_edges(COUNTS, 4))
    rng = np.random.default_rng(3)
    return shape, {k: (v + rng.normal(0, 0.2, v.shape)).astype(dtype) for k, v in gru.initial(shape, COUNTS).items()}


def plain_log(p, shape, h, y):
    """Log probability of word y after state h, spelled out."""
    c = next(i for i in range(shape.classes) if shape.edges[i] <= y < shape.edges[i + 1])
    kinds = h @ p["wc"] + p["bc"]
    s, e = shape.edges[c], shape.edges[c + 1]
    inner = p["wo"][s:e] @ h + p["bo"][s:e]
    return kinds[c] - np.log(np.exp(kinds).sum()) + inner[y - s] - np.log(np.exp(inner).sum())


def plain_step(p, x, h):
    n = len(h)
    a, c = p["table"][x] + p["b"], h @ p["u"]
    z, r = (1 / (1 + np.exp(-(a[i * n : (i + 1) * n] + c[i * n : (i + 1) * n]))) for i in range(2))
    return (1 - z) * np.tanh(a[2 * n :] + r * c[2 * n :]) + z * h


def plain_score(p, shape, doc):
    h, before, total = np.zeros(shape.hidden), 0, 0.0
    for y in [*doc, 0]:
        h = plain_step(p, before, h)
        total += plain_log(p, shape, h, y)
        before = y
    return total


def test_scores_equal_a_plain_loop():
    shape, p = model()
    rng = np.random.default_rng(5)
    docs = [rng.integers(1, len(COUNTS), n).astype(np.int32) for n in (0, 1, 5, 300, 40, 40, 2)]
    for together, held in ((2, 3), (100, 1 << 14)):
        got = gru.score(p, shape, docs, together=together, held=held)
        assert np.allclose(got, [plain_score(p, shape, d) for d in docs], rtol=1e-4)
    assert len(gru.score(p, shape, [])) == 0


def test_probabilities_of_all_words_sum_to_one_even_for_large_weights():
    shape, p = model()
    for scale in (1.0, 400.0):
        q = p | {"wc": p["wc"] * scale, "wo": p["wo"] * scale}
        h = np.repeat(np.random.default_rng(2).normal(size=(1, 4)), len(COUNTS), 0)
        logs = gru.log_probabilities(q, shape, h, np.arange(len(COUNTS)))[0]
        assert abs(np.exp(logs).sum() - 1) < 1e-9


def test_gradient_through_time_is_right():
    shape, p = model()
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, len(COUNTS), (6, 3)), rng.integers(0, len(COUNTS), (6, 3))
    y[4:, 2] = -1
    h = rng.normal(0, 0.3, (shape.hidden, 3))
    _, grads, _ = gru.window_gradients(p, shape, x, y, h)
    for name, v in p.items():
        for at in [tuple(rng.integers(0, n) for n in v.shape) for _ in range(6)]:
            old, loss = v[at], []
            for step in (1e-5, -1e-5):
                v[at] = old + step
                loss.append(gru.window_gradients(p, shape, x, y, h)[2])
            v[at] = old
            assert abs((loss[0] - loss[1]) / 2e-5 - grads[name][at]) < 1e-4, (name, at)


def test_training_lowers_the_loss():
    shape, p = model(np.float32)
    rng = np.random.default_rng(1)
    docs = [np.tile([1, 2, 3, 4], rng.integers(1, 6)).astype(np.int32) for _ in range(3000)]
    trained, tokens = gru.train(p, shape, docs, streams=8)  # some 150 updates
    assert tokens == sum(len(d) + 1 for d in docs)
    assert gru.score(trained, shape, docs[:50]).sum() > 0.5 * gru.score(p, shape, docs[:50]).sum()
