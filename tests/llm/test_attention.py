"""The quality classifier against loops over numbers: scores, attention weights, gradients by differences, and the query's rows."""

import math
import random

import numpy as np

from paperloom.llm import quality
from tests.llm.test_ops import prose


def looped(model, bag):
    """(score, attention weights) of one bag, number by number."""
    hidden, gate = len(model.be), len(model.w)
    hs, es = [], []
    for passage in bag:
        x = [(float(v) - float(m)) / float(s) for v, m, s in zip(passage, model.shift, model.scale)]
        h = [math.tanh(sum(x[i] * model.we[i][j] for i in range(len(x))) + model.be[j]) for j in range(hidden)]
        e = 0.0
        for k in range(gate):
            t = math.tanh(sum(h[j] * model.v[j][k] for j in range(hidden)))
            g = 1 / (1 + math.exp(-sum(h[j] * model.u[j][k] for j in range(hidden))))
            e += t * g * model.w[k]
        hs.append(h)
        es.append(e)
    total = sum(math.exp(e) for e in es)
    a = [math.exp(e) / total for e in es]
    z = [sum(a[n] * hs[n][j] for n in range(len(hs))) for j in range(hidden)]
    return 1 / (1 + math.exp(-(sum(z[j] * model.c[j] for j in range(hidden)) + float(model.d)))), a


def some_model(seed, width=quality.WIDTH, hidden=5, gate=3):
    r = np.random.default_rng(seed)
    return quality.Model(r.random(width), r.random(width) + 0.5, r.normal(0, 0.3, (width, hidden)), r.normal(0, 0.3, hidden), r.normal(0, 0.5, (hidden, gate)), r.normal(0, 0.5, (hidden, gate)), r.normal(0, 1, gate), r.normal(0, 1, hidden), np.array(0.2))


def test_scores_equal_loops():
    r = np.random.default_rng(1)
    for seed in range(3):
        model, bags = some_model(seed), [r.random((n, quality.WIDTH)) for n in (1, 4, 2, 7)]
        y, a = quality.scores(model, bags)
        want = [looped(model, b) for b in bags]
        assert np.allclose(y, [w[0] for w in want]) and np.allclose(a, [x for w in want for x in w[1]])


def test_gradients_equal_differences():
    r = np.random.default_rng(2)
    width, sizes = 6, [1, 3, 2, 5]
    model = some_model(3, width)
    x, starts = r.normal(0, 1, (sum(sizes), width)), np.cumsum([0, *sizes[:-1]])
    labels, weight = np.array([1.0, 0.0, 1.0, 0.0]), np.array([2.0, 1.0, 2.0, 1.0])

    def loss(parts):
        y = quality._forward(quality.Model(model.shift, model.scale, *parts), x, starts)[-1]
        return float((-weight * (labels * np.log(y) + (1 - labels) * np.log(1 - y))).mean())

    parts = [np.array(p, float) for p in model[2:]]
    for k, grad in enumerate(quality.gradients(model, x, starts, labels, weight)):
        for at in np.ndindex(parts[k].shape):
            moved = []
            for e in (1e-6, -1e-6):
                own = [p.copy() for p in parts]
                own[k][at] += e
                moved.append(loss(own))
            assert math.isclose((moved[0] - moved[1]) / 2e-6, float(np.asarray(grad)[at]), rel_tol=1e-4, abs_tol=1e-7), (k, at)


def test_rows_equal_loops(spark):
    rng = random.Random(4)
    model = some_model(5)
    rows = [(k, rng.choice([None, "", "one", prose(k, rng.randint(1, 600)), prose(k, 30) + "\n\n!!! 123 ???\n" + prose(k + 1, 200)])) for k in range(40)]
    got = {r.doc_id: r for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for k, text in rows:
        score, a = looped(model, quality.bag_of(text))
        assert math.isclose(got[k].score, score, rel_tol=1e-6) and got[k].n_passages == len(a)
        assert math.isclose(got[k].top_weight, max(a), rel_tol=1e-6) and math.isclose(a[got[k].top_passage], max(a), rel_tol=1e-6)
