"""The n-gram model against a plain-Python one, and its decisions."""

import math
from collections import Counter, defaultdict

import pytest

llm = pytest.importorskip("lodestone.llm.registry")
from lodestone.llm import kneser_ney as kn  # noqa: E402
from lodestone.session import load  # noqa: E402

SF = "/root/testdata/sf0.001"
ORDER = 4


class Plain:
    """Interpolated modified Kneser-Ney, one dictionary for each order."""

    def __init__(self, texts, order=ORDER):
        self.order, self.n = order, {order: Counter()}
        for t in texts:
            padded = kn.START * (order - 1) + t
            self.n[order].update(padded[i : i + order] for i in range(len(t)))
        for k in range(order - 1, 0, -1):
            self.n[k] = Counter(g[1:] for g in self.n[k + 1])
        self.d, self.after = {}, {}
        for k, n in self.n.items():
            c = Counter(n.values())
            c1, c2, c3, c4 = (c[i] for i in range(1, 5))
            if c1 and c2 and c3 and c4:
                y = c1 / (c1 + 2 * c2)
                raw = (1 - 2 * y * c2 / c1, 2 - 3 * y * c3 / c2, 3 - 4 * y * c4 / c3)
                self.d[k] = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(raw)]
            else:
                self.d[k] = [0.5, 0.75, 0.9]
            self.after[k] = defaultdict(list)
            for g, m in n.items():
                self.after[k][g[:-1]].append(m)

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(self.n[1]) + 1)
        seen = self.after[k].get(gram[:-1])
        if not seen:
            return self.p(gram[1:])
        cut = lambda m: self.d[k][min(m, 3) - 1]
        m = self.n[k].get(gram, 0)
        return ((m - cut(m)) if m else 0) / sum(seen) + sum(map(cut, seen)) / sum(seen) * self.p(gram[1:])

    def score(self, text):
        padded = kn.START * (self.order - 1) + text
        return -sum(math.log(self.p(padded[i : i + self.order])) for i in range(len(text))) / len(text)


def test_op9_equals_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(kn, "SLICE", 700)
    docs = [r.text or "" for r in load(spark, SF, "documents").select("text").orderBy("doc_id").limit(40).collect()]
    train, test = docs[:25], [*docs[20:], "Ünïcode … 中文 \U0001f600", "x", "QQ##", "same", "same", "\x02a\x00b", ""]
    plain = Plain(train)
    model = kn.fit(spark.createDataFrame([(t,) for t in [*train, "", None]], "text string"))
    got = kn.log_perplexity(spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(test)], "doc_id long, text string, lang string, gram int"), model).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(test)))
    for r in got:
        if test[r.doc_id]:
            assert abs(r.log_perplexity - plain.score(test[r.doc_id])) <= 1.001 / kn.GRID
        else:
            assert r.log_perplexity is None
    # a distribution for every context: what was seen and one symbol that was not
    alphabet = [*plain.n[1], "\U0001f601"]
    for context in ["", "e", "th", "qzx", kn.START * 3]:
        assert abs(sum(plain.p(context[-3:] + c) for c in alphabet) - 1) < 1e-9
    assert model.grams[ORDER].count() == len(plain.n[ORDER])


def test_op9_tables_grow_with_the_text(spark):
    rows = [(r.text,) for r in load(spark, SF, "documents").select("text").where("text is not null").collect()]
    some, most = (kn.fit(spark.createDataFrame(rows[:n], "text string")).grams[ORDER].count() for n in (20, 160))
    assert most > 1.5 * some


def test_op9_blocks_do_not_depend_on_batches():
    import pyarrow as pa

    texts = ["a" * 30, "", "b" * 500, None, "c" * 40, "d" * 60, "", "e"] * 3
    whole = pa.record_batch([pa.array(texts)], names=["text"])
    one = [(k, b.column(0).to_pylist()) for k, b in kn.blocks([whole], most=100)]
    many = [(k, b.column(0).to_pylist()) for k, b in kn.blocks([whole.slice(i, 2) for i in range(0, len(texts), 2)], most=100)]
    assert one == many and [t for _, b in one for t in b] == texts
    assert all(sum(len(t or "") for t in b) <= 100 or len([t for t in b if t]) == 1 for _, b in one)


def test_op9_decisions(spark):
    labels = load(spark, SF, "labels")
    got = llm.op9_quality(spark, SF).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].keep.mean() > 0.97 and got[got.quality == 0].keep.mean() < 0.6


def test_op9_edges(spark):
    docs, labels = load(spark, SF, "documents"), load(spark, SF, "labels")
    schema = "doc_id long, text string, lang string, source string, n_chars long, p double, block int"
    rows = [(3, "", "en", "s", 0, 1.0, 1), (1, None, None, None, None, None, None), (4, "the same text here", "en", "s", 5, 1.0, 1), (4, "the same text here", "en", "s", 5, 1.0, 1), (None, "the same text here", "en", "s", 5, 1.0, 1), (6, "the the of and " * 30000, "xx", "s", 5, 1.0, 1)]
    edge = spark.createDataFrame(rows, schema)
    model = kn.fit_quality(docs, labels)
    out = kn.classify(edge, model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 6 and not by[1].keep and not by[3].keep and by[1].log_perplexity is None
    assert len({(r.log_perplexity, r.keep) for r in out if r.doc_id in (4, None)}) == 1
    assert by[6].threshold == model.thresholds[""] and by[6].log_perplexity > 0
    kept = kn.keep_good(edge, model)
    assert kept.columns == edge.columns and kept.count() == sum(r.keep for r in out)
    empty = edge.limit(0)
    assert kn.classify(empty, model).count() == 0 and kn.keep_good(empty, model).count() == 0
    assert kn.fit_quality(empty, labels).thresholds == {} and kn.fit_quality(docs, labels.limit(0)).thresholds == {}
    bare = kn.classify(edge, kn.fit_quality(empty, labels)).collect()
    assert {r.doc_id: r.keep for r in bare} == {1: False, 3: False, 4: True, None: True, 6: True}
    twice = labels.where("quality = 1").unionByName(labels.where("quality = 1").selectExpr("doc_id", "0 as quality", "toxic"))
    assert kn.trusted_ids(twice.selectExpr("doc_id", "cast(quality as int) quality", "toxic")).count() == 0
