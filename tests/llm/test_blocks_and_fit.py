"""One block of phrases at a time; the fit of the classifier against plain sums over pairs."""

import numpy as np

from folioscope.llm import decontaminate, quality
from tests.llm.test_pipeline_operators import frame, texts


def test_blocks_do_not_meet_in_one_stage(spark):
    rows = texts(40, 5)
    items = spark.createDataFrame([(i, t) for i, t in rows[20:40]], "item_id long, text string")
    plan = lambda n: decontaminate.search(frame(spark, rows), items, block_bytes=n)._jdf.queryExecution().executedPlan().toString()
    assert plan(200).count("MapInArrow") == plan(1 << 20).count("MapInArrow") == 1


def reference_fit(x, y, s):
    """The same steps, one example and one pair of features at a time, in double precision."""
    rng = np.random.default_rng(s.seed)
    n, d = x.shape
    v = rng.normal(0, 0.02, (d, s.rank)).astype(np.float32).astype(float)
    share = y.mean()
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    params, t = [np.zeros(1), np.zeros(d), v], 0
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for epoch in range(s.epochs):
        step, order = s.step * (1 - epoch / s.epochs) + 1e-4, rng.permutation(n)
        for at in range(0, n, s.batch):
            rows, t = order[at : at + s.batch], t + 1
            grads = [np.zeros(1), s.decay * params[1], s.decay * params[2]]
            for r in rows:
                z = params[0][0] + x[r] @ params[1] + sum(x[r, i] * x[r, j] * (params[2][i] @ params[2][j]) for i in range(d) for j in range(i))
                g = (1 / (1 + np.exp(-z)) - y[r]) * weight[r] / len(rows)
                grads[0] = grads[0] + g
                grads[1] = grads[1] + g * x[r]
                grads[2] = grads[2] + g * np.array([x[r, i] * sum(x[r, j] * params[2][j] for j in range(d) if j != i) for i in range(d)])
            for p, g, (a, b) in zip(params, grads, state, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= step * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return params


def test_fit_against_plain_sums():
    r = np.random.default_rng(5)
    words, dense = r.random((24, 5)).astype(np.float32), r.normal(size=(24, 2))
    y = (words[:, 0] * words[:, 1] > 0.25).astype(np.float32)
    s = quality.Settings(buckets=5, rank=2, epochs=3, batch=8)
    m = quality.fit(words, dense, y, s)
    bias, linear, factors = reference_fit(m.inputs(words, dense).astype(float), y, s)
    assert np.allclose(m.bias, bias[0], atol=2e-3) and np.allclose(m.linear, linear, atol=2e-3) and np.allclose(m.factors, factors, atol=2e-3)
