import random

from gristmill.llm import leaks

VOCAB = [f"w{i}" for i in range(12)]


def brute(docs, items, window):
    out = set()
    for d, t in docs:
        w = leaks.words(t)
        grams = {tuple(w[i : i + window]) for i in range(len(w) - window + 1)}
        for k, x in items:
            v = leaks.words(x)
            if any(tuple(v[i : i + window]) in grams for i in range(len(v) - window + 1)):
                out.add((d, k))
    return out


def test_words():
    assert leaks.words("Ein <em>Wo​rt</em>&nbsp;mehr, so­weit; <p>A1_b2</p> d<b>i</b>e &amp; STRASSE straße") == ["ein", "wort", "mehr", "soweit", "a1", "b2", "die", "strasse", "strasse"]


def test_search_agrees_with_brute_force():
    rng = random.Random(4)
    for window in (4, 6, 12):
        items = [(i, " ".join(rng.choices(VOCAB, k=rng.randint(0, 25)))) for i in range(30)]
        docs = []
        for d in range(80):
            w = rng.choices(VOCAB, k=rng.randint(0, 60))
            if rng.random() < 0.6:
                v = leaks.words(rng.choice(items)[1])
                a = rng.randint(0, max(0, len(v) - 3))
                w[10:10] = v[a : a + rng.randint(3, 20)]
            docs.append((d, ". ".join(w)))
        t = leaks.Tables(items, window)
        assert {(d, i) for d, x in docs for i in t.find(x)} == brute(docs, items, window)


def test_window_is_exact():
    item = " ".join(f"t{i}" for i in range(20))
    t = leaks.Tables([(7, item)])
    w = item.split()
    assert t.find("x " + " ".join(w[3:15]) + " y") == {7} and t.find("x " + " ".join(w[3:14]) + " y") == set() and t.find(" ".join(w[:8] + ["z"] + w[8:16])) == set()


def test_rows(spark):
    item = " ".join(f"t{i}" for i in range(14))
    docs = spark.createDataFrame([(1, "a " + item.upper()), (2, item), (2, item), (3, None), (4, ""), (5, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(10, item, "s", "test"), (11, item + " more words", "s", "test"), (12, "short", "s", "test"), (13, None, None, None)], "item_id long, text string, suite string, eval_split string")
    want = [(1, 10), (1, 11), (2, 10), (2, 10), (2, 11), (2, 11)]
    assert sorted(map(tuple, leaks.leaks(docs, items).collect())) == want
    assert sorted(map(tuple, leaks.leaks(docs, items, items_at_once=1).collect())) == want  # several passes
    assert {r.item_id: r.documents for r in leaks.leaked_items(leaks.leaks(docs, items).distinct(), items).collect()} == {10: 2, 11: 2, 12: 0, 13: 0}
    assert leaks.leaks(docs.limit(0), items).count() == 0 and leaks.leaks(docs, items.limit(0)).count() == 0
