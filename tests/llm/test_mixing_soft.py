"""Targets of a mix where the text says little about the labels."""

import numpy as np
import pytest

pytest.importorskip("lodestone.llm.registry")


def test_soft_posteriors_meet_the_targets_of_the_pipeline(spark):
    import corpus_pipeline
    from lodestone.llm import mixing

    rng = np.random.default_rng(3)
    p = np.array([0.13, 0.02, 0.75, 0.1]) * np.exp(rng.normal(0, 0.4, (600, 4)))
    p /= p.sum(1, keepdims=True)
    n = rng.integers(20, 400, 600)
    df = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(600)], "doc_id long, n_tokens long, p array<double>").cache()
    w = mixing.rates_of(p, mixing.solve(df, mixing.DOMAINS, multiples=corpus_pipeline.MULTIPLES))
    goal = (n @ p) * np.array([corpus_pipeline.MULTIPLES[d] for d in mixing.DOMAINS])
    assert (w >= 0).all() and np.abs((w * n) @ p - goal).max() <= 1e-4 * goal.sum()
    # of targets that no rates can meet the least-squares rest is left, with a warning
    flat = 0.97 * np.array([0.13, 0.02, 0.75, 0.1]) + 0.03 * p
    df = spark.createDataFrame([(i, int(n[i]), flat[i].tolist()) for i in range(600)], "doc_id long, n_tokens long, p array<double>").cache()
    with pytest.warns(UserWarning, match="no rates meet"):
        w = mixing.rates_of(flat, mixing.solve(df, mixing.DOMAINS, {"q1t1": 1.0}))
    goal, best = n.sum() * np.array([0, 0, 0, 1.0]), np.inf
    for d in flat:  # the nearest point of the cone of posteriors is at least this near
        best = min(best, np.abs(d * (d @ goal) / (d @ d) - goal).max())
    assert np.abs((w * n) @ flat - goal).max() <= 1.01 * best
