"""Greedy selection over all candidates of a group against the same steps in numpy."""

import numpy as np

from lodestone.operators.selection import PRESETS, Preset, mmr_select
from lodestone.plans import registry


def greedy(rows, k, p):
    vec = np.array([r[2] for r in rows])
    rel, size, critical = (np.array([r[i] for r in rows]) for i in (3, 4, 5))
    unit = vec / np.linalg.norm(vec, axis=1)[:, None]
    room, out, used = p.budget * (1 - p.cushion), [], 0.0
    first = np.flatnonzero(critical)
    for i in first:
        if used + size[i] <= 0.8 * p.budget or size[first].sum() <= room:
            out.append((rows[i][1], 1.0))
            used += size[i]
    chosen = [r[1] for r in rows].index
    left = ~critical
    while left.any() and len(out) < k:
        cos = np.stack([unit @ unit[chosen(d)] for d, _ in out]) if out else None
        near = None if cos is None else cos.min(0) if p.diversity == "reference" else cos.max(0)
        score = p.lam * rel + (1 - p.lam) * (1 if near is None else 1 - np.clip(near, 0, 1))
        score = np.where(left & (used + size <= room), score, -np.inf)
        i = int(score.argmax())
        if score[i] == -np.inf:
            break
        out.append((rows[i][1], score[i]))
        used, left[i] = used + size[i], False
    return out


def test_equals_greedy_steps(spark):
    rng = np.random.default_rng(4)
    presets = [PRESETS["balanced"], Preset(0.4, 400, 0.2, "max"), Preset(0.5, 300, 0.1), Preset(0.3, 1000, 0.3)]
    for n, p in enumerate(presets):
        rows = [(q, 100 * q + i, rng.standard_normal(6).tolist(), float(rng.random()), float(rng.integers(1, 90)), bool(rng.random() < 0.1 * n)) for q in range(3) for i in range(60)]
        df = spark.createDataFrame(rows, "query_id long, id long, embedding array<double>, relevance double, tokens double, critical boolean")
        got = mmr_select(df, 7, p).orderBy("query_id", "position").collect()
        for q in range(3):
            want = greedy([r for r in rows if r[0] == q], 7, p)
            mine = [r for r in got if r.query_id == q]
            assert [r.id for r in mine] == [d for d, _ in want] and [r.position for r in mine] == list(range(1, len(want) + 1))
            assert np.allclose([r.score for r in mine], [s for _, s in want], atol=1e-6)


def test_mmr_query_sees_every_candidate_of_a_hot_label(spark, tmp_path):
    """1,100 critical rows of one label are all taken: they hold few tokens."""
    vec = [(i * 50, [1.0, float(i)], 7) for i in range(1100)]
    spark.createDataFrame(vec, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, "word") for i, _, _ in vec], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.QUERIES["mmr_selection"](spark, str(tmp_path)).count() == 1100


def test_metrics_and_similarities(spark):
    from lodestone.operators.selection import mmr_metrics

    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(12)]
    rows = [(1, i, rng.standard_normal(5).tolist(), float(rng.random()), float(rng.integers(1, 50)), i % 9 == 0, f"f{i % 6}", f"t{i % 4}", sorted(rng.choice(words, 5, replace=False).tolist())) for i in range(40)]
    df = spark.createDataFrame(rows, "query_id long, id long, embedding array<double>, relevance double, tokens double, critical boolean, file_path string, chunk_type string, words array<string>")

    def same(a, b, metric):
        cos = np.dot(a[2], b[2]) / np.linalg.norm(a[2]) / np.linalg.norm(b[2])
        over = 0.8 if a[6] == b[6] else 0.6 if a[7] == b[7] else len(set(a[8]) & set(b[8])) / len(set(a[8]) | set(b[8]))
        return {"cosine": cos, "jaccard": over, "semantic": 0.7 * cos + 0.3 * over}[metric]

    for metric in ("cosine", "jaccard", "semantic"):
        p = Preset(0.4, 100_000, 0.2, "reference", metric)
        got = [r.id for r in mmr_select(df, 9, p).orderBy("position").collect()]
        taken = [r for r in rows if r[5]]
        while len(taken) < 9:
            left = [r for r in rows if r not in taken]
            value = lambda r: 0.4 * r[3] + 0.6 * (1 - min(1.0, max(0.0, min(same(r, x, metric) for x in taken))))  # noqa: E731, B023
            taken.append(max(left, key=value))
        assert got == [r[1] for r in taken]
    m = mmr_metrics(spark.createDataFrame([(1, r[1]) for r in taken], "query_id long, id long"), df, 2, p).first()
    pairs = [same(a, b, "cosine") for i, a in enumerate(taken) for b in taken[i + 1 :]]
    assert m.chunks == 9 and abs(m.diversity - (1 - np.mean(pairs))) < 1e-9 and abs(m.utilisation - sum(r[4] for r in taken) / 100_000) < 1e-9
    assert m.raw_coverage == 2.5 and m.coverage == 1.0
