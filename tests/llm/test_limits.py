"""What lies beyond former limits, and results against plain versions."""

import json
import warnings

import numpy as np
import pyarrow as pa
import pytest

llm = pytest.importorskip("lodestone.llm.registry")
SF = "/root/testdata/sf0.001"
MESSAGE = "conv_id long, turn long, role string, text string"


def _call(ident, needs=(), **arguments):
    return {"id": ident, "name": "add", "arguments": arguments, "depends_on": list(needs)}


def test_op4_chains_longer_than_a_thousand_calls(spark):
    from lodestone.llm.chat_tools import levels

    n = 1500
    rows = [(1, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(n)]
    rows += [(1, "both", [f"c{n - 1}", "c3"]), (1, "after", ["both"]), (1, "last", ["after", "c7"])]
    rows += [(2, "c1", ["c0"]), (2, "x", ["y"]), (2, "y", ["x"]), (2, "behind", ["x"]), (2, "mixed", ["c1", "x"]), (2, "self", ["self"]), (2, "lone", ["nowhere"]), (None, "c1", ["c0"])]
    got = {(r.conv_id, r.call_id): r.level for r in levels(spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>")).collect()}
    assert got[1, f"c{n - 1}"] == n - 1 and got[1, "c1"] == 1 and (1, "c0") not in got
    assert (got[1, "both"], got[1, "after"], got[1, "last"]) == (n, n + 1, n + 2)
    # in conversation 2 there is no c0: c1 depends on nothing there
    assert {k[1]: v for k, v in got.items() if k[0] == 2} == {"x": None, "y": None, "behind": None, "mixed": None, "self": None}


def test_op4_levels_by_brute_force(spark):
    from lodestone.llm.chat_tools import levels

    rng = np.random.default_rng(4)
    needs = {i: sorted({f"n{x}" for x in rng.integers(0, 60, rng.integers(0, 4)) if x < i or rng.random() < 0.05}) for i in range(60)}

    def level(i, path=()):
        if i in path:
            return None
        below = [level(int(d[1:]), (*path, i)) for d in needs[i]]
        return None if None in below else max((b + 1 for b in below), default=0)

    got = {r.call_id: r.level for r in levels(spark.createDataFrame([(1, f"n{i}", d) for i, d in needs.items()], "conv_id long, call_id string, depends_on array<string>")).collect()}
    assert got == {f"n{i}": level(i) for i in needs if needs[i]}


def test_op4_identifiers_recur_and_results_may_be_surplus(spark):
    from lodestone.llm.chat_tools import Tool, link

    rows = []
    for conv in (1, 2):
        rows += [(conv, 0, "assistant", json.dumps({"tool_calls": [_call("call_1", x=conv)]})), (conv, 1, "tool", json.dumps({"tool_call_id": "call_1", "content": f"of {conv}"}))]
    rows += [(2, 2, "tool", json.dumps({"tool_call_id": "call_1", "content": "again"})), (None, 0, "assistant", json.dumps({"tool_calls": [_call("call_1", x=3)]})), (None, 1, "tool", json.dumps({"tool_call_id": "call_1", "content": "nobody's"}))]
    got = link(spark.createDataFrame(rows, MESSAGE), (Tool("add", (("x", "integer", True),)),)).collect()
    assert sorted((r.conv_id or 0, r.status, json.loads(r.canonical)["result"]) for r in got if r.status != "no_identifier") == [(0, "orphan_result", "nobody's"), (1, "ok", "of 1"), (2, "ok", "of 2"), (2, "surplus_result", "again")]
    assert len(got) == 5


def test_op6_refuses_too_many_domains_and_unmet_targets(spark, monkeypatch):
    from lodestone.llm import mixing
    from lodestone.session import load

    docs, labels = load(spark, SF, "documents"), load(spark, SF, "labels")
    many = labels.selectExpr("doc_id", "cast(doc_id % 1000 as int) quality", "toxic")
    model = mixing.fit(docs, many)
    assert len(model.domains) > 64 and mixing.posteriors(docs.limit(3), model).count() == 3
    with monkeypatch.context() as m, pytest.raises(ValueError, match="pairs of labels"):
        m.setattr(mixing, "MAX_DOMAINS", 5)
        mixing.fit(docs, many)
    with pytest.raises(RuntimeError, match="not met"):
        members = mixing.posteriors(docs, mixing.fit(docs, labels))
        mixing.solve(members, mixing.DOMAINS, {"q0t0": 0.9, "q0t1": 0.04, "q1t0": 0.03, "q1t1": 0.03}, steps=1)


def test_op6_solution_is_the_least_squares_one(spark):
    """Against non-negative least squares by coordinate descent: both meet reachable targets; of unreachable ones both leave the same rest."""
    from lodestone.llm import mixing

    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.5, 0.5, 0.5], 40)
    n = rng.integers(20, 200, 40)
    df = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(40)], "doc_id long, n_tokens long, p array<double>")
    domains = ("a", "b", "c")
    for share in ({"a": 0.2, "b": 0.5, "c": 0.3}, {"a": 0.9, "b": 0.05, "c": 0.05}):
        w = mixing.rates_of(p, mixing.solve(df, domains, share))
        goal = n.sum() * np.array([share[d] for d in domains])
        a = (p * n[:, None]).T
        x = np.ones(40)
        for _ in range(3000):
            for j in range(40):
                x[j] = max(0.0, x[j] - a[:, j] @ (a @ x - goal) / (a[:, j] @ a[:, j]))
        assert (w >= 0).all() and np.abs(a @ w - goal).max() <= max(2e-3 * goal.sum(), 1.05 * np.abs(a @ x - goal).max())


def test_op6_classifier_reaches_the_minimum_of_its_loss():
    from lodestone.llm import mixing

    rng = np.random.default_rng(6)
    x = (rng.random((300, 12)) < 0.3).astype(np.float32)
    y = np.eye(3, dtype=np.float32)[(x[:, 0] + 2 * x[:, 1]).astype(int) % 3]

    def loss(w):
        z = np.concatenate([x, np.ones((300, 1))], 1) @ w
        z -= z.max(1, keepdims=True)
        return -(y * (z - np.log(np.exp(z).sum(1, keepdims=True)))).sum() / 300 + 5e-4 * (w * w).sum()

    w = np.zeros((13, 3))
    x1 = np.concatenate([x, np.ones((300, 1))], 1)
    for _ in range(20000):  # plain gradient descent
        e = np.exp(x1 @ w - (x1 @ w).max(1, keepdims=True))
        w -= 0.3 * (x1.T @ (e / e.sum(1, keepdims=True) - y) / 300 + 1e-3 * w)
    assert loss(mixing._softmax(x, y)) <= loss(w) * 1.05 + 0.01


@pytest.fixture(scope="module")
def model(spark):
    from lodestone.llm import langid
    from lodestone.session import load

    return langid.fit(langid.training_rows(load(spark, SF, "documents")))


def test_op7_letters_follow_unicode(spark, model):
    from lodestone.llm import langid

    texts = ["١٢٣", "१२", "́̂ 12", "☃€", "!?", "ª", "中文", "हिन्दी", "العربية ١"]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred == "und" for i in range(9)] == [True] * 5 + [False] * 4
    assert all(got[i].score == 0 for i in (0, 1, 2, 3, 4, 6, 7, 8))  # no learned language uses these scripts
    mask, letters = langid.letter_mask(np.frombuffer("aहि1".encode(), np.uint8))
    assert mask.tolist() == [True] * 7 + [False] and letters.sum() == 2


def test_op7_gibberish_scores_low_and_language_high(spark, model):
    from lodestone.llm import langid
    from lodestone.session import load

    rng = np.random.default_rng(1)
    rows = [(i, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 10))) for _ in range(80))) for i in range(30)]
    low = [r.score for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()]
    good = load(spark, SF, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    high = [r.score for r in langid.predict(load(spark, SF, "documents").join(good, "doc_id", "left_semi"), model).collect()]
    assert np.mean(np.array(low) < 0.5) >= 0.95 and np.mean(np.array(high) >= 0.5) >= 0.99


def test_op7_spans_of_mixed_texts(spark, model):
    from lodestone.llm import langid
    from lodestone.session import load

    long = {}
    for lang in model.langs[:2]:
        long[lang] = load(spark, SF, "documents").where(f"lang = '{lang}' and length(text) > 900").orderBy("doc_id").first().text.split()[:60]
    a, b = model.langs[:2]
    text = " ".join(long[a] + long[b])
    df = spark.createDataFrame([(1, text), (2, text), (3, ""), (4, None)], "doc_id long, text string")
    rows = langid.spans(df, model).collect()
    mine = sorted((r.first_word, r.n_words, r.lang) for r in rows if r.doc_id == 1)
    assert mine == sorted((r.first_word, r.n_words, r.lang) for r in rows if r.doc_id == 2) and {r.doc_id for r in rows} == {1, 2}
    assert mine[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(mine, mine[1:], strict=False))
    words = sum(n for _, n, _ in mine)
    first, second = ([n for at, n, lang in mine if lang == x] for x in (a, b))
    assert sum(first) >= 0.4 * words and sum(second) >= 0.4 * words and len(mine) <= 12


def test_op7_learns_more_languages_than_two_hundred(spark):
    from lodestone.llm import langid

    rows = [(i, f"l{i % 230:03d}", f"word{chr(97 + i % 23)}{i % 230} text") for i in range(460)]
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert len(m.langs) == 230


def test_op8_suppression_equals_the_quadratic_one():
    import time

    from lodestone.llm.licenses import Rule, stand

    rules = [Rule(f"l{i}", "some words", "some", p, 0.5) for i, p in enumerate((1, 2, 2, 3, 5))]
    rng = np.random.default_rng(3)
    for _ in range(200):
        found = [(int(a), int(a + n), rules[r]) for a, n, r in zip(rng.integers(0, 40, 25), rng.integers(1, 15, 25), rng.integers(0, 5, 25), strict=True)]
        kept = []
        for a, b, rule in sorted(found, key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].label)):
            if not any(x <= a and b <= y for x, y, _ in kept):
                kept.append((a, b, rule))
        assert [(a, b, r.label) for a, b, r in sorted(kept, key=lambda x: (x[0], -x[1], -x[2].priority))] == [(a, b, r.label) for a, b, r in stand(found)]
    began = time.time()
    assert len(stand([(i * 10, i * 10 + 5, rules[0]) for i in range(100_000)])) == 100_000 and time.time() - began < 5


def test_op8_has_hundreds_of_hand_written_signatures_that_match_themselves():
    import re

    from lodestone.llm import licenses

    own = (*licenses._SIGNATURES, *licenses._PERMISSIVE, *licenses._COPYLEFT, *licenses._CONTENT)
    assert len({x[1] for x in own}) >= 250
    for label, words, keyword, _, _ in own:
        text = re.sub(r"\(([^)|]*)[^)]*\)", r"\1", re.sub(r"\[[^\]]*\]", "", words))
        low = " ".join(text.split()).encode()
        keys = set(licenses._prefilter()[0].findall(low)) | ({m.group()} if (m := licenses._prefilter()[1].match(low)) else set())
        assert keyword.encode() in {k[: len(keyword)] for k in keys} or any(keyword.encode().startswith(k) for k in keys), words
        assert licenses.phrase_regex(words) and re.search(licenses.phrase_regex(words), low), words


def test_op3_ids_beyond_sixteen_bits_and_random_access(tmp_path):
    from lodestone.llm.token_files import SequenceWriter, filesystem, id_type, open_tokens

    assert id_type(65_536) is np.uint16 and id_type(65_537) is np.uint32
    fs, path = filesystem(f"file://{tmp_path}")
    ids = np.random.default_rng(0).integers(0, 200_000, 1000)
    with fs.open_output_stream(f"{path}/x.arrow") as f:
        writer = SequenceWriter(f, 16, rows=8, dtype=id_type(200_000))
        for at in range(0, 1000, 37):
            writer.write(ids[at : at + 37])
        writer.close()
    file = open_tokens(fs, f"{path}/x.arrow")
    assert file.get_batch(0).column(0).type == pa.list_(pa.uint32(), 16)
    for i in (0, 9, 61, 62):
        b = file.get_batch(i // 8)
        got = b.column(0).values.to_numpy(zero_copy_only=True)[i % 8 * 16 : i % 8 * 16 + 16]
        real = np.array(b.column(1).values.to_pylist()[i % 8 * 16 : i % 8 * 16 + 16])
        assert (got[real] == ids[i * 16 : i * 16 + 16]).all() and real.sum() == min(16, 1000 - i * 16)


def test_op5_warns_when_patterns_are_not_optimal():
    from lodestone.llm.packing import column_generation

    demand = np.random.default_rng(0).integers(1, 40, 32).astype(float)
    with pytest.warns(UserWarning, match="stopped after 1 step"):
        column_generation(demand, max_steps=1)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        column_generation(demand)


def test_components_in_one_round_and_joined_later(spark, monkeypatch):
    from lodestone.llm import components as cc

    rng = np.random.default_rng(1)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 150, (90, 2))] + [(500, 501), (600, 700 + 0)]
    df = lambda rows: spark.createDataFrame(rows, "u long, v long")
    whole = dict(map(tuple, cc.components(df(e)).collect()))
    once = dict(map(tuple, cc.one_round(df(e)).collect()))
    assert once.keys() <= whole.keys() and all(whole[x] == whole[c] for x, c in once.items())
    for split in (2_000_000, 0):
        monkeypatch.setattr(cc, "SPLIT_EDGES", split)
        got = dict(map(tuple, cc.joined_components(cc.components(df(e[:50])), df(e[50:])).collect()))
        assert {x: c for x, c in got.items() if x in whole} == whole
