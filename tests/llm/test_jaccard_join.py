import random

import pytest

from quillstrata.llm import components as C
from quillstrata.llm import jaccard_join as J


def brute(texts, ids):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    label = {}
    for i, d in enumerate(ids):
        label[find(i)] = min(label.get(find(i), d), d)
    return [(d, len(sets[i]), label[find(i)] if sets[i] else d) for i, d in enumerate(ids)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(frame, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") + rng.choice("rstln")
    texts = [None, "", " \n", "one", "One two", "one  TWO", "a b c d e", "A b c d\te", "a b c d e f"]
    hot = [word() for _ in range(40)]
    for size in (60, 150, 400):
        base = [word() for _ in range(size)]
        for edits in [0, 0, 1, 1, 2, 2, 3, 3, 4, 6, 8, 10]:
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            texts.append(" ".join(copy[: len(copy) * 9 // 10]))
    texts += [" ".join([word() for _ in range(rng.randint(5, 60))] + hot) for _ in range(40)]
    ids = [3 * i + 1 for i in range(len(texts))]
    rng.shuffle(ids)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.report(frame(texts, ids)).collect())
    assert got == sorted(brute(texts, ids))


def test_copies_repeated_rows_and_empty_tables(frame):
    texts = ["x y z"] * 6 + ["p q r s t u v"] * 2
    docs = frame([*texts, "x y z"], [9, 8, 7, 6, 5, 4, 3, 2, 4])
    assert sorted((r.doc_id, r.component_id) for r in J.report(docs).collect()) == [(2, 2), (3, 2), (4, 4), (4, 4), (5, 4), (6, 4), (7, 4), (8, 4), (9, 4)]
    kept = J.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4] and kept.columns == docs.columns
    assert J.report(frame([])).count() == 0


def test_one_row_of_each_component_stays(spark):
    a, b = "a b c d e f g h i j k l m n o p q r s t u v w x y z", " ".join(f"w{i}" for i in range(40))
    rows = [(0, a, "x"), (1, a, "x"), (1, b, "x"), (None, a, "x"), (None, b + " y", "x"), (3, "once", "q"), (3, "once", "p"), (4, "", "x"), (4, "", "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row_key string").withColumnRenamed("row_key", "row_key").selectExpr("*", "1 AS gone_id", "2 AS v")
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.row_key) for r in kept.collect()), key=repr) == sorted([(0, a, "x"), (1, b, "x"), (3, "once", "p"), (4, "", "x"), (4, "", "x"), (None, None, "x")], key=repr)


def test_hot_leaders_and_long_lists_are_dealt(frame, monkeypatch):
    monkeypatch.setattr(J, "SHARE", 2)
    monkeypatch.setattr(J, "BLOCK", 2)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    texts = [" ".join([*base, *(f"own{i}x{j}" for j in range(rng.randint(0, 6)))]) for i in range(25)]
    texts += [" ".join(rng.sample(base, 30)) for _ in range(5)]
    ids = list(range(len(texts)))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.report(frame(texts, ids)).collect())
    assert got == sorted(brute(texts, ids))


def test_prefixes_hold_enough_matches():
    import numpy as np

    for n in (1, 5, 30, 200):
        for m in (n, n - n // 10):
            for df in (np.full(m, 2), np.full(m, 10_000), np.arange(2, m + 2)):
                l, p = J.choose(df, n)  # noqa: E741
                assert 1 <= l <= J.least_overlap(n) and p == max(0, min(m, n - J.least_overlap(n) + l - (n - m)))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.v: r.root for r in C.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {v: find(v) for v in root}
