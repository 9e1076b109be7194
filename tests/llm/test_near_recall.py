"""Near duplicates at the operator's own similarity, and short texts."""

import numpy as np

from lodestone.llm import order_minhash as om


def test_op10_recall_at_its_similarity(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijkl"), 7))
    rows = []
    for n, changed in [(80, 16)] * 60 + [(80, 13)] * 60 + [(20, 4)] * 60:
        a = [word() for _ in range(n)]
        b = list(a)
        for p in rng.choice(n, changed, replace=False):
            b[p] = word()
        rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    pairs = len(rows) // 2
    for n in range(5, 10):  # one word replaced, left out or added: all are found
        for kind in range(3):
            for p in range(n):
                a = [word() for _ in range(n)]
                b = [*a[:p], *([word()] if kind == 0 else [] if kind == 1 else [word(), a[p]] if n < 9 else [a[p]]), *a[p + 1 :]]
                rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b) + " !")]
    got = {r.doc_id: r.class_id for r in om.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [got[i] == got[i + 1] for i in range(0, len(rows), 2)]
    assert all(linked[pairs:])
    for k in range(0, pairs, 60):
        assert sum(linked[k : k + 60]) >= 57
    assert all(got[i] in (i, i - 1) for i in got)
